import re
from collections import Counter

from lectern.llm import quality_rules as Q


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n ", "one two three", "a b c d e f g h " * 5, "x " * 4000, "same line\n" * 30, "# * & words " * 20, "é ü " * 40, "WORD!! " * 30,
         " ".join(f"w{i}" for i in range(5000)), " ".join(f"w{i % 9}" for i in range(16)), " nbsp word " * 10, "a b c d e f g h i a b c d e f g h"]


def test_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 9)], "doc_id long, text string, n_words int")
    rows = Q.quality(docs).collect()
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == sorted((i, *brute(t)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = Q.ledger(docs).cache()
    bits = [r.failed_bits for r in ledger.collect()]
    for name, mask in Q.POLICIES.items():
        assert Q.apply_policy(ledger, name).filter("kept").count() == sum(not b & mask for b in bits)
        for r in Q.ablation(ledger, name).collect():
            bit = 1 << Q.RULES.index(r.rule)
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(not b & mask & ~bit for b in bits)


def test_filter_keeps_columns_and_empty(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string")
    out = Q.filter_documents(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r.doc_id for r in Q.quality(docs).filter("kept").collect()}
    assert Q.quality(docs.limit(0)).count() == 0
