import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def brute(rows, taken):
    """Checks that hold for any right mix; taken lists (key, size, source_size, target, taken)."""
    sizes = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in rows}
    per = defaultdict(int)
    for k, s, _ in rows:
        per[s] += sizes[k]
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([per[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], sum(per.values()))))
    source, got = {k: s for k, s, _ in rows}, defaultdict(int)
    for k, size, source_size, target, words, _ in taken:
        assert size == sizes[k] and source_size == per[source[k]] and target == goal[source[k]]
        assert 0 <= words <= 3 * size
        got[source[k]] += words
    return goal, got


def test_targets_share_the_excess():
    assert mixing.targets([10, 10, 10], [1, 2, 3], 30) == [5, 10, 15]
    assert mixing.targets([1, 100, 100], [1, 1, 1], 201) == [3, 99, 99]
    assert mixing.targets([], [], 0) == []
    assert mixing.targets([0, 5], [1, 2], 5) == [0, 5]


def test_mix_meets_targets(spark):
    rows = [(i, f"s{i % 7}" if i % 3 else "s0", "w " * (i % 90 + 1)) for i in range(900)] + [(900, None, "a b"), (901, "s1", None), (902, "s1", "")]
    docs = spark.createDataFrame([(k, s, t, 1) for k, s, t in rows], "doc_id long, source string, text string, size long")
    taken = [tuple(r) for r in mixing.mixture(docs).collect()]
    assert len(taken) == len(rows)
    goal, got = brute(rows, taken)
    for s, t in goal.items():
        assert abs(got[s] - t) <= 4
    assert sorted(taken, key=str) == sorted((tuple(r) for r in mixing.mixture(docs.repartition(7)).collect()), key=str)


def test_tiny_sources_beside_large_ones(spark):
    rows = [(i, "b", "w " * 100_000) for i in range(100)] + [(200, "t1", "w " * 5), (201, "t2", "w " * 4), (202, "t2", "w " * 7), (203, None, "w " * 7)]
    taken = [tuple(r) for r in mixing.mixture(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()]
    goal, got = brute(rows, taken)
    assert len(taken) == len(rows) and (goal["t1"], goal["t2"], goal[None]) == (15, 33, 21)
    assert got == {s: round(t) for s, t in goal.items()}


def shares(total, *small):
    goal = (total - sum(small), *small)
    return [{"source_no": i, "source": str(i), "source_size": n, "n": 1, "target": float(t)} for i, (n, t) in enumerate(zip((total, 0, 0), goal))]


def test_slots_of_small_sources(spark):
    sources = shares(10**8, 3000, 1000)
    block = mixing.block_words(sources)
    assert block == 1000 // mixing.FINE
    got = mixing.slots_per_source(spark, sources, block)
    assert all(abs(n * block - s["target"]) <= 0.05 * s["target"] for n, s in zip(got, sources))


def test_slots_of_a_millionth():
    sources = shares(10**10, 50_000, 10_000)
    block = mixing.block_words(sources)
    ends, n = mixing._ends(sources), np.zeros(3, np.int64)
    for first in range(0, mixing._slots(sources, block), 1 << 22):
        slots = np.arange(first, min(first + (1 << 22), mixing._slots(sources, block)))
        n += np.bincount(mixing._chosen(slots, ends), minlength=3)
    assert all(abs(k * block - s["target"]) <= 0.05 * s["target"] for k, s in zip(n, sources))


def sequential(rows, order):
    """The mix slot by slot: a plain walk. ``order`` lists each source's rows as they come in its stream."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, _, t in rows}
    names = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total, words = sum(size.values()), {s: sum(size[k] for k in order[s]) for s in names}
    goal = mixing.targets([words[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], total)
    streams = {s: [k for k in order[s] for _ in range(size[k])] * 3 for s in names}
    block = max(1, int(min(t for t in goal if t)) // 128)
    at, taken = dict.fromkeys(names, 0), defaultdict(int)
    for slot in range(-(-total // block)):
        point, edge = slot * 0x9E3779B9 % 2**32 / 2**32, 0.0
        for s, t in zip(names, goal):
            edge += t / total
            if point < edge:
                break
        at[s] += block
    by_slots = defaultdict(int)
    for s, t in zip(names, goal):
        for k in streams[s][: at[s]]:
            by_slots[k] += 1
        for k in streams[s][: int(t + 0.5)]:
            taken[k] += 1
    return {k: (by_slots[k], taken[k]) for k in size}


def test_equals_a_sequential_mix(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 5}", "w " * (i * 37 % 90)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    size = mixing.measured(docs)
    h = {r.key: r.h for r in size.selectExpr("key", "xxhash64('mix', key, size) AS h").collect()}
    order = defaultdict(list)
    for k, s, _ in sorted(rows, key=lambda r: h[r[0]]):  # fewer than a bucket's rows: plain hash order
        order[s].append(k)
    got = {r.doc_id: (r.by_slots, r.taken) for r in mixing.mixture(docs).collect()}
    assert got == sequential(rows, order)


def test_slots_follow_the_shares_throughout(spark):
    sources = [{"source_no": i, "source": str(i), "source_size": 5000, "n": 1, "target": t} for i, t in enumerate((1000.0, 5000.0, 9000.0))]
    slots = sorted(tuple(r) for r in mixing.schedule(spark, sources, 1).collect())
    assert [s[0] for s in slots] == list(range(15000))
    seen = [0, 0, 0]
    for slot, source, rank in slots:
        assert rank == seen[source]
        seen[source] += 1
        assert all(abs(n - (slot + 1) * t / 15000) < 5 for n, t in zip(seen, (1000, 5000, 9000)))


def test_slots_decide_what_is_taken(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"s{i % 2}", "w " * 100) for i in range(600)], "doc_id long, source string, text string")
    words = lambda: {r.target: r.w for r in mixing.mixture(docs).groupBy("target").agg(F.sum("taken").alias("w")).collect()}
    assert words() == {20_000.0: 20_000, 40_000.0: 40_000}
    block, slots = 20_000 // mixing.FINE, mixing.slots_per_source
    monkeypatch.setattr(mixing, "slots_per_source", lambda *a: [0, slots(*a)[1]])
    assert words() == {20_000.0: mixing.SETTLE * block, 40_000.0: 40_000}


def test_rows_of_the_mix(spark):
    docs = spark.createDataFrame([(i, "en", "w " * 50, f"s{i % 3}", i) for i in range(300)] + [(1, "en", "", "s1", 0)], "doc_id long, lang string, text string, source string, n_chars long")
    for c in ("key", "row", "_row", "_copies", "copies", "size", "taken", "target"):
        docs = docs.withColumn(c, F.create_map(F.lit("a"), F.col("doc_id")) if c == "row" else F.lit("mine"))
    out = mixing.mixed_rows(docs)
    assert out.filter("key = 'mine' and _row = 'mine' and _copies = 'mine' and row['a'] = doc_id").count() == out.count()
    assert out.columns == docs.columns
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n == pytest.approx({"s0": 50, "s1": 100, "s2": 150}, abs=1)


def test_long_text(spark):
    docs = spark.createDataFrame([(1, "s", "w " * 3_000_000), (2, "t", "w " * 1_000_000)], "doc_id long, source string, text string")
    assert {r.doc_id: (r.size, r.taken) for r in mixing.mixture(docs).collect()} == {1: (3_000_000, 1_333_333), 2: (1_000_000, 2_666_667)}


def test_empty(spark):
    assert mixing.mixture(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    repeated = spark.createDataFrame([(1, "s", "a b c")] * 4, "doc_id long, source string, text string")
    assert [r.taken for r in mixing.mixture(repeated).collect()] == [3] * 4
