import random
import re

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import quality_model as M
from lectern.llm import toxicity as X
from lectern.llm.transducers import Trie, best_path

DATA = "/root/testdata/sf0.01"


def test_em_finds_accuracies():
    rng = np.random.default_rng(2)
    truth, right = rng.random(40_000) < 0.85, np.array([0.95, 0.9, 0.85, 0.9, 0.8, 0.75])
    votes = np.where(rng.random((len(truth), 6)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = M.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, table, share = M.expectation_maximisation(patterns, counts.astype(float))
    assert abs(share - 0.85) < 0.03
    got = table[1, :, M.GOOD] / (table[1, :, M.GOOD] + table[1, :, M.BAD])
    assert np.abs(got - right).max() < 0.05


def test_quality_on_labels_it_never_saw(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = M.quality_rows(docs).join(labels, "doc_id").filter("quality is not null").collect()
    assert len(rows) > 300 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) >= 0.97


def plain_votes(text):
    """The labellers again, character by character."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, letters = len(words), [c for c in text if c.isalpha()]
    if not n:
        return (2,) * 10
    rule = lambda bad, good: 0 if bad else 1 if good else 2
    symbols = len([c for c in text if c in r"#*$%&|<>{}\~^_=+"])
    upper = len([c for c in letters if c.isupper()]) / max(1, len(letters))
    same = len([i for i in range(1, n) if words[i] == words[i - 1]])
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    ended = len([x for x in lines if x[-1] in ".!?…:;\"')]»”"])
    chars = len("".join(words))
    tails = len([w for w in words if len(w) > 1 and all(not (c.isalnum() or c == "_" or c.isspace()) for c in w[-2:])])
    bare = len([w for w in words if not any(c.isalpha() for c in w)])
    distinct = len({*words})
    return (
        rule(False, n >= 20), rule(symbols > 0.15 * n, symbols <= 0.02 * n), rule(same > 0.2 * n, same <= 0.02 * n), rule(upper > 0.5 and n > 3, upper < 0.2 if letters else False),
        rule(n >= 50 and distinct < 0.2 * n, distinct > 0.4 * n or n < 50), rule(n >= 20 and not ended, ended >= 0.5 * len(lines)), rule(chars > 14 * n, 2 * n <= chars <= 10 * n),
        rule(len(letters) < 0.7 * chars, len(letters) > 0.85 * chars), rule(tails > 0.15 * n, tails <= 0.03 * n), rule(bare > 0.15 * n, bare <= 0.05 * n),
    )


def test_votes_and_scores_equal_plain_ones(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(200).collect()
    extra = ["", "END." + " " * 60, "A B C D!!", "x" * 3000 + "!", "ÀÉ é 12 34 {} __ ..", " \n\t ", "no end\n" * 30, "!! ?? a"]
    texts = [r.text or "" for r in rows] + extra
    votes = M.voter()
    assert [votes(t, M._WORDS(t)) for t in texts] == [plain_votes(t) for t in texts]
    rng = np.random.default_rng(1)
    model = M.Model({}, np.zeros((2, 10, 3)), 0.5, rng.normal(size=M.BUCKETS), 0.25)
    score = model.scorer()
    for t in texts:
        want = 1 / (1 + np.exp(-(sum(model.weights[b] * x for b, x in M.vector(t).items()) + 0.25)))
        assert abs(score(M._WORDS(t)) - want) < 1e-9
    docs = spark.createDataFrame([(i, t, "mine", "too") for i, t in enumerate(texts)], "doc_id long, text string, row_id string, code string")
    codes = {r.doc_id: r.code for r in M.labelled(docs).collect()}
    assert codes == {i: M.vote_code(plain_votes(t)) for i, t in enumerate(texts)}
    assert M.quality_rows(docs).count() == len(texts)


def test_sparse_fit_equals_dense_steps():
    rng = np.random.default_rng(3)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2)
    x = M.Sparse([(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in dense], 40)
    w, e = rng.normal(size=40), rng.normal(size=60)
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.turned_times(e), dense.T @ e)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.1), (3, "a plain sentence. " * 3000, 0.1), (3, "a plain sentence. " * 3000, 0.1), (None, "x", 0.1)], "doc_id long, text string, score double")
    rows = M.quality_rows(docs).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert M.quality_rows(docs.limit(0)).count() == 0


def reading(text, insults={"idiot$": 2.0, "scum": 1.0}):  # noqa: B006
    return X.Grammar(insults).clause(text.lower().split())


def test_grammar_contexts():
    plain, negated, reported, aimed, threat = range(5)
    only = lambda i, w: tuple(w if k == i else 0.0 for k in range(5))
    assert reading("what an idiot") == only(plain, 2.0)
    assert reading("you are an idiot") == reading("an idiot like you") == only(aimed, 2.5)
    assert reading("what an idiot and so I left without you") == only(plain, 2.0)  # too far behind
    assert reading("not an idiot") == only(negated, 0.5) and reading("not one of those poor idiot")[plain] == 2.0
    assert reading("somebody said idiot") == only(reported, 1.0)
    assert reading("idiot and scumbag") == only(plain, 3.0) and not any(reading("idiotic"))
    g = X.Grammar({"idiot$": 2.0, "scum": 1.0})
    assert g.symbol("scumbag") == ("insult", 1.0) and g.symbol("kill") == ("violent", 1.0) and g.symbol("idiotic") == ("word", 1.0)
    assert not any(g.features(None)) and not any(g.features("nothing here"))


def test_threats_take_several_words_in_order():
    for text in ("I will kill you", "I'll soon kill all of you", "kill them all", "ich werde dich töten", "je vais te tuer", "voy a matarte", "you deserve to die", "I hope they all die"):
        assert reading(text)[X.THREAT] == X.MENACE, text
    for text in ("how to kill a process on linux", "he asked them to shoot the scene", "you kill time", "they will kill the process", "I will call you", "the plants will die", "you will see how I shoot photos"):
        assert not any(reading(text)), text
    assert reading("I will not kill you")[X.NEGATED] and not reading("I will not kill you")[X.THREAT]
    assert reading("he said I will kill you")[X.REPORTED] and not reading("he said I will kill you")[X.THREAT]


def all_paths(machine, symbols):
    """(written symbols, summed weights, reached states) of every path, without composition."""
    paths = [((), (), 0)]
    for s in symbols:
        paths = [((*out, o), (*ws, w), t) for out, ws, at in paths for o, w, t in machine.arcs[at].get(s, ())]
    return [(out, ws) for out, ws, at in paths if at in machine.final]


def test_composed_machine_equals_its_parts_one_after_the_other():
    rng = random.Random(8)
    first, second, third = X.negation(), X.reported_speech(), X.patterns()
    for _ in range(300):
        symbols = [(t, rng.choice((1.0, 2.0, 3.5))) for t in rng.choices(X.TAGS, weights=[3, 3, *[1] * (len(X.TAGS) - 2)], k=rng.randrange(0, 8))]
        best = (-1.0, ())
        for marked, _ in all_paths(first, [t for t, _ in symbols]):
            for told, _ in all_paths(second, marked):
                for out, factors in all_paths(third, told):
                    sums = [0.0] * 5
                    for o, f, (_, w) in zip(out, factors, symbols):
                        if o is not None:
                            sums[o] += f * w
                    best = max(best, (round(sum(sums), 9), tuple(sums[::-1])))
        assert best_path(X.composed(), symbols, 5) == best[1][::-1], symbols


def test_trie_equals_prefix_lookup():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abc", k=rng.randrange(1, 7)))
    for _ in range(50):
        entries = {word() + rng.choice(("", "$")): rng.random() for _ in range(12)}
        trie = Trie(entries)
        for _ in range(40):
            w = word()
            assert trie.weight(w) == max([entries.get(f"{w}$", 0.0), *(entries.get(w[:k], 0.0) for k in range(1, len(w)))])


def test_long_toxic_text_and_repeated_ids(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices(["lorem", "ipsum", "dolor"], k=20)) + (" moron." * 2 if i % 2 else "."), "x", "y") for i in range(200)]
    docs += [(1, "other text", "x", "y"), (900, "lorem. " * 200_000 + "you moron. moron. moron", "x", "y")]
    docs = spark.createDataFrame(docs, "doc_id long, text string, half string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    got = [sorted(tuple(r) for r in X.toxicity_rows(d, labels).collect()) for d in (docs, docs.repartition(5))]
    assert got[0] == got[1] and len(got[0]) == 202
    assert [r[3] for r in got[0] if r[0] == 900] == [1]


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    clean = [f"{a}{b}" for a in ("lor", "dol", "sit", "amet", "kon") for b in range(60)]
    bad = ["idiot", "moron", *(f"vequ{x}" for x in ("a", "in", "or", "ul", "em"))]
    rows = []
    for i in range(1200):
        words, toxic = [rng.choice(clean) for _ in range(40)], i % 5 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(bad)
            words[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(5000, None, 0.5), (5001, "", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    got = X.toxicity_rows(docs, labels)
    assert got.count() == 1202
    seen = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(seen) > 200 and sum(r.predicted == r.toxic for r in seen) / len(seen) >= 0.97
    # Held-out labels change nothing.
    other = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(map(tuple, X.toxicity_rows(docs, other).collect())) == sorted(map(tuple, got.collect()))


def test_toxicity_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "I will kill you"), (1, "I will kill you"), (None, "fine"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert X.toxicity_rows(docs, labels).count() == 4 and X.toxicity_rows(docs.limit(0), labels).count() == 0
