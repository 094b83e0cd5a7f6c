import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import minhash_dedup as M


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 32))
def test_banded_distance(a, b, band):
    assert M.distance(a, b, band) == min(plain(a, b), band + 1)


def test_sketch_is_order_sensitive_and_passes_short_passages_over():
    fresh = lambda c, n: [f"{c}{i}" for i in range(n)]
    marks = lambda words: {k for k, _ in M.sketch(M.Hasher()(words))}
    one = fresh("w", 200)
    assert marks(one) == marks(list(one)) and len(marks(one)) > 2 * M.BANDS
    assert len(marks(one) & marks(one[100:] + one[:100])) < len(marks(one)) / 3
    assert not marks(fresh("a", 100) + one[:45] + fresh("b", 100)) & marks(fresh("c", 60) + one[:45] + fresh("d", 140))
    assert marks([]) == set() and len(marks(["a", "b"])) == 1


def test_recall_by_similarity():
    rng, words, n = random.Random(9), [f"v{i}" for i in range(5000)], 200
    hasher = M.Hasher()
    marks = lambda x: {k for k, _ in M.sketch(hasher(x))}
    for similarity, least in ((0.8, 0.88), (0.81, 0.9), (0.85, 0.95), (0.9, 0.99), (0.95, 0.99)):
        met = 0
        for _ in range(300):
            a = rng.choices(words, k=n)
            b = list(a)
            for i in rng.sample(range(n), round(n * (1 - similarity))):
                b[i] = f"other{rng.randrange(10**9)}"
            assert M.alike(a, b)
            met += bool(marks(a) & marks(b))
        assert met >= least * 300, (similarity, met)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        rng.choice([lambda: words.__setitem__(at, "zz"), lambda: words.insert(at, "yy"), lambda: words.pop(at)])()
    return words


def corpus():
    rng = random.Random(4)
    fresh = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    passage, texts = fresh(60), []
    for g in range(40):
        base = fresh(rng.randrange(40, 300))
        texts += [" ".join(edited(rng, base, rng.randrange(0, 1 + len(base) // 60))) for _ in range(1 if g % 3 else rng.randrange(2, 14))]
    texts += [" ".join(fresh(100) + passage + fresh(100)) for _ in range(60)]
    return texts + [texts[0]] * 3 + ["", None, "a b", "a b", "A  B", " "]


def brute(rows):
    words = [M._FIND((t or "").lower()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            near = M.alike(words[i], words[j]) if words[i] and words[j] else (rows[i][1] or "") == (rows[j][1] or "")
            if near:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    return {k: min(least[find(i)]) for i, (k, _) in enumerate(rows)}


def test_classes_equal_brute_force(spark):
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, cls string, band int").repartition(3)
    got = M.near_duplicate_rows(df).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)
    kept = M.deduplicated(df.unionByName(df.limit(5)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept) and kept.columns == df.columns


def shared_passages(n=120, copies=40):
    """Texts of the same six passages in different orders, with near copies of some: all k-mers but a few are shared."""
    rng = random.Random(7)
    passages = [[f"p{i}w{j}" for j in range(40)] for i in range(6)]
    texts = [sum(order, []) for order in rng.sample(list(itertools.permutations(passages)), n)]
    return [" ".join(t) for t in texts] + [" ".join(edited(rng, t, 2)) for t in texts[:copies]]


def test_near_copies_in_crowded_buckets(spark):
    n, copies = 120, 40
    texts = shared_passages(n, copies)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in M.near_duplicate_rows(docs).collect()}
    assert got == {i: i if i < n else i - n for i in range(n + copies)}


def connected(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_blocks_meet_all_pairs(spark):
    rng = random.Random(3)
    words = [rng.choices(range(30), k=rng.randrange(4, 60)) for _ in range(60)]
    words += [edited(rng, w, rng.randrange(1, 4)) for w in words]
    hashes = [M.Hasher()([str(x) for x in w]) for w in words]
    texts = spark.createDataFrame([(i, h.astype("<u4").tobytes()) for i, h in enumerate(hashes)], "id long, h binary")
    size = [len(w) for w in words]
    near = spark.createDataFrame([(5, i, size[i], i + 1, size[i + 1]) for i in range(len(words) - 1)], "bucket long, a long, na int, b long, nb int")
    roots = spark.createDataFrame([(61, 1)], "node long, root long")
    true = {(i, j) for j in range(len(words)) for i in range(j) if M.alike(list(hashes[i]), list(hashes[j]))}
    for block in (7, 1000):
        links = [tuple(r) for r in M.bucket_links(near, texts, roots, block=block).collect()]
        assert {(min(x), max(x)) for x in links} <= true and len(true) > 40
        assert connected(len(words), [*links, (61, 1)]) == connected(len(words), [*true, (61, 1)])
    only = [tuple(r) for r in M.bucket_links(near, texts, roots).collect()]
    assert len(only) < len(words)  # links alone, whatever the number of pairs


def test_clashing_names_and_long_texts(spark):
    rng = random.Random(2)
    long = [f"{rng.choice('abcdefgh')}{rng.randrange(9000)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 50))), (3, " ".join(reversed(long)))]
    extra = ("_cls", "_class", "_id", "cls", "key", "row", "c", "k", "id")
    docs = spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {', '.join(f'`{c}` string' for c in extra)}")
    kept = M.deduplicated(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in kept] == [(*r, *extra) for r in (rows[0], rows[2])]


def test_empty(spark):
    assert M.near_duplicate_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0
