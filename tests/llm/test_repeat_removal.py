import hashlib
import random
from collections import Counter

import pytest

from lectern.llm import repeat_removal as R


def brute(rows, length=R.LENGTH):
    data = [(k, (t or "").encode()) for k, t in rows]
    seen = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for k, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    fresh = lambda n: "".join(rng.choice("abcdefghij éß\n") for _ in range(n))
    passages = [fresh(n) for n in (150, 190, 197, 205, 230, 400, 1500)]
    texts = [fresh(rng.randrange(0, 900)) for _ in range(30)]
    for _ in range(50):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.5 else fresh(rng.randrange(1, 300)) for _ in range(rng.randrange(1, 6))))
    cut = [rng.randrange(0, 1200) for _ in range(20)]
    texts += [fresh(50) + passages[6][c : c + rng.randrange(195, 300)] + fresh(60) for c in cut]
    texts += [texts[0], texts[40], texts[40], "a" * 500, "ab" * 300, "ab" * 120, None, "", "short", "short", "é" * 101]
    return list(enumerate(texts))


@pytest.mark.parametrize("meet", [1, 1 << 20])
def test_equals_brute_force(spark, meet, monkeypatch):
    monkeypatch.setattr(R.repeats, "__defaults__", (meet,))
    rows = corpus() + [(5, corpus()[5][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, dk string, g int").repartition(3)
    if meet == 1:  # so many partitions that most shared grams go through the count over all tasks
        spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = sorted((tuple(r) for r in R.removal_rows(df).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows)


def test_long_texts_and_clashing_names(spark):
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choice("abcdefghijkl mnop\n") for _ in range(n))
    shared = fresh(3000)
    rows = [(1, fresh(1_500_000) + shared + fresh(900_000)), (2, shared[500:]), (3, fresh(400))]
    names = ("dk", "dl", "z", "runs", "g", "_text")
    docs = spark.createDataFrame([(*r, *names) for r in rows], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in names)}")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in R.removal_rows(docs).collect()}
    assert got == {1: (2_403_000, 2500, 1), 2: (2500, 2500, 1), 3: (400, 0, 0)}
    kept = {r.doc_id: r for r in R.deduplicated(docs).collect()}
    assert set(kept) == {1, 3} and len(kept[1].text) == 2_400_500 and tuple(kept[3])[2:] == names


def test_deduplicated_rows(spark):
    text = "".join(random.Random(1).choice("abcdefgh ") for _ in range(700))
    docs = spark.createDataFrame([(1, "en", "start " + text, "s", 0), (2, "en", text + " end", "s", 0), (3, "en", text, "s", 0), (4, "en", "", "s", 0), (5, None, "alone", None, None)], "doc_id long, lang string, text string, source string, n_chars long")
    out = R.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "start ", 2: " end", 4: "", 5: "alone"}


def test_large_groups_give_runs(spark):
    """A passage's end, unlike in every text, costs a few rows an occurrence and not one a window."""
    rng = random.Random(4)
    fresh = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = fresh(700)
    texts = [fresh(rng.randrange(0, 200)) + passage[: 500 + i] + fresh(250) for i in range(0, 160, 4)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(k, 0, t) for k, t in rows], "dk long, dl long, text string")
    runs = [(r.dk, r["first"], r["last"]) for r in R.repeats(docs, 4).collect()]
    got = {k: R.spans([(a, b) for d, a, b in runs if d == k]) for k, _ in rows}
    kept = {k: (sum(e - s for s, e in got[k]), len(got[k]), hashlib.sha256(R.keep(t.encode(), got[k])).hexdigest()) for k, t in rows}
    assert sorted(((k, len(t), *kept[k]) for k, t in rows), key=str) == brute(rows)
    assert len(runs) <= 25 * len(rows)


def test_empty(spark):
    assert R.removal_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
