"""Near-duplicates by Order MinHash.

A text's k-mers are its runs of five lower-cased words, each labelled with its occurrence number. Each of
``BANDS`` hash functions samples the ``MINIMA`` least labelled k-mers and puts them back into text order;
every ordered pair of them that lies at least a ``SPREAD`` of the text apart is a bucket of the text. So a
bucket is shared by texts that agree in content and order in places far from each other: a passage that
fills less than a quarter of its texts brings none of them together.

Within a bucket, texts are sorted by a signature of all minima, and neighbours become the first
candidates: texts that are much alike mostly lie side by side. The sort is a range partition over all
buckets at once (a bucket may span partitions; their ends are joined up). Then every other pair of a
bucket is met, unless links have already connected it: large buckets are split by length and into blocks
that meet each other in tasks of their own, and a pair is passed over only where lengths or the words in
common rule out the similarity (an edit takes away one word at most), or where the task has connected it
by then. The task aligns the rest on the spot, so pairs are never listed: links alone leave it, fewer than
it has texts. No pair of a bucket is dropped, however large the bucket. Comparing bags of words is what
grows with the square of a bucket, for texts that share passages at both ends without being alike.

Candidates are verified by a banded, bit-parallel alignment over words: a link needs an edit
similarity, 1 - distance / length of the longer text, of ``SIMILARITY``. The alignment compares 32-bit
hashes of words: two unlike words count as equal once in 4 billion comparisons. Classes are the
components of links.

Recall is a matter of the bands. Texts of 200 words with random substitutions share a bucket in about
0.94 of the cases at an edit similarity of 0.81, 0.99 at 0.85 and nearly always from 0.9 (a test holds
it to 0.9). Texts under eight words need a whole k-mer in common.

Defined cases: null and empty texts are equal, a class of their own; exact copies are folded before
anything else; texts under five words are one k-mer; texts are read whole; repeated rows share a
class; classes are named by their least doc_id, nulls aside; an empty table gives no rows; extra
columns are ignored or, in ``deduplicated``, kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, checkpointed, hot_keys, map_rows, spread_join, text_of
from lectern.llm.components import components, forest

K, BANDS, MINIMA, SPREAD, SIMILARITY = 5, 16, 4, 0.25, 0.8
#: Texts and words of a block where a bucket's pairs are met, about: they bound a task's memory.
BLOCK, WORDS = 1_024, 1 << 20
_I, _J = np.triu_indices(MINIMA, 1)
_FIND = re.compile(WORD).findall
_ODD = np.array([int.from_bytes(hashlib.blake2b(f"band {i}".encode(), digest_size=8).digest()) | 1 for i in range(BANDS)], np.uint64)[:, None]
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Hasher:
    """64-bit word hashes, remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        self._known, self._bound = {}, bound

    def __call__(self, words: Sequence[str]) -> np.ndarray:
        known = self._known
        if len(known) > self._bound:
            known.clear()
        out = []
        for w in words:
            if (h := known.get(w)) is None:
                known[w] = h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest())
            out.append(h)
        return np.array(out, np.uint64)


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Occurrence-labelled k-mer hashes in text order."""
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _U(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    same = np.r_[False, out[order][1:] == out[order][:-1]]
    if same.any():
        at = np.arange(len(out))
        first = np.maximum.accumulate(np.where(same, 0, at))
        out[order] += _mix((at - first).astype(np.uint64)) * same
    return out


def sketch(h: np.ndarray) -> list[tuple[int, int]]:
    """(bucket, order within the bucket) of each spread pair of minima."""
    if not len(h):
        return []
    marks = kmers(h)
    n = len(marks)
    if n < MINIMA:
        return [(int(x), 0) for x in np.unique(_mix(marks).view(np.int64))]
    values = _mix(marks[None] * _ODD + (_ODD >> _U(7)))
    at = np.sort(np.argpartition(values, MINIMA - 1, axis=1)[:, :MINIMA], axis=1)  # back in text order
    low = np.take_along_axis(values, at, 1)
    buckets = _mix(low[:, _I] * _U(0xD1342543DE82EF95) + low[:, _J]).view(np.int64)
    far = at[:, _J] - at[:, _I] >= SPREAD * n
    deep = np.zeros(BANDS, np.uint64)
    for c in np.sort(low, axis=1).T:
        deep = deep << _U(8) | c >> _U(56)
    bands, pairs = np.nonzero(far)
    found = dict(zip(buckets[bands, pairs].tolist(), deep.astype(np.uint32).view(np.int32)[bands].tolist()))
    return list(found.items())


def distance(a: Sequence, b: Sequence, band: int) -> int:
    """Edit distance of two sequences, ``band + 1`` if it is larger than ``band``.

    Differences of neighbouring cells are bits; each column holds the rows within ``band`` of the
    diagonal, entering rows as one more than the row above, left ones as one less than to the left.
    """
    lead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[lead:], b[lead:]
    tail = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), min(len(a), len(b)))
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    m, n = len(a), len(b)
    if abs(m - n) > band or max(m, n) - (Counter(a) & Counter(b)).total() > band:
        return band + 1
    if not m or not n:
        return max(m, n)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    base, top = 0, min(m, band)
    plus, minus, score = (1 << top) - 1, 0, top
    for j, x in enumerate(b, 1):
        if top < min(m, j + band):
            plus |= 1 << (top - base)
            top, score = top + 1, score + 1
        if base < j - 1 - band:
            plus, minus, base = plus >> 1, minus >> 1, base + 1
        width = top - base
        if width <= 0:
            return band + 1
        mask = (1 << width) - 1
        equal = where.get(x, 0) >> base & mask
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | ~(across | plus) & mask, plus & across
        score += (up >> (width - 1) & 1) - (down >> (width - 1) & 1)
        up, down = (up << 1 | 1) & mask, down << 1 & mask
        plus, minus = (down | ~(vertical | up)) & mask, up & vertical
    return min(score, band + 1)


def alike(a: Sequence, b: Sequence, similarity: float = SIMILARITY) -> bool:
    longer = max(len(a), len(b))
    band = int((1 - similarity) * longer + 1e-9)
    return distance(a, b, band) <= band


_NEAR = pa.schema([("part", pa.int32()), ("end", pa.int32()), ("bucket", pa.int64()), ("a", pa.int64()), ("na", pa.int32()), ("b", pa.int64()), ("nb", pa.int32())])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, order, id): neighbours of one bucket, and the partition's ends."""
    from pyspark import TaskContext

    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        bucket, node, n = (batch.column(c).to_numpy() for c in ("bucket", "id", "n"))
        if not len(bucket):
            continue
        if first is None:
            first = bucket[0], node[0], n[0]
        else:
            bucket, node, n = (np.r_[x, y] for x, y in zip(last, (bucket, node, n)))
        last = bucket[-1], node[-1], n[-1]
        at = np.flatnonzero(bucket[1:] == bucket[:-1])
        if len(at):
            same = np.full(len(at), part, np.int32), np.zeros(len(at), np.int32)
            cols = [*same, bucket[at], node[at], n[at], node[at + 1], n[at + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NEAR)], schema=_NEAR)
    if first is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_NEAR.names, (part, e, int(x[0]), int(x[1]), int(x[2]), None, None))) for e, x in ((1, first), (2, last))], schema=_NEAR)


def neighbours(sketches: DataFrame) -> DataFrame:
    """(bucket, a, na, b, nb): neighbours within the buckets of ``sketches(bucket, deep, id, n)``, ids with their numbers of words."""
    n = int(sketches.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sketches.repartitionByRange(n, "bucket", "deep", "id").sortWithinPartitions("bucket", "deep", "id")
    met = checkpointed(dealt.select("bucket", "id", "n").mapInArrow(_neighbours, "part int, end int, bucket long, a long, na int, b long, nb int"))
    # Two rows a partition: where a bucket goes on in the next partition, its last text meets the first there.
    order = Window.orderBy("part", "end")
    ends = met.filter("end > 0").select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in ("end", "bucket", "a", "na")))
    seam = ends.filter("end = 2 and next_end = 1 and bucket = next_bucket and a <> next_a").select("bucket", "a", "na", F.col("next_a").alias("b"), F.col("next_na").alias("nb"))
    return met.filter("end = 0").select("bucket", "a", "na", "b", "nb").unionByName(seam)


def candidates(near: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) with a < b, once a pair, of the neighbours whose lengths allow the similarity."""
    fits = F.least("na", "nb") >= F.greatest("na", "nb") - F.floor((1 - similarity) * F.greatest("na", "nb") + 1e-9)
    return near.filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def possible(words: list[np.ndarray], root: np.ndarray, home: np.ndarray, block: np.ndarray, two: bool, similarity: float = SIMILARITY) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j < i) of texts sorted by length that may be alike, given as word hashes.

    A text shares all its words, repeats told apart, with one that is alike, but for one an edit. Left out
    are pairs of one root, pairs away from home (met elsewhere) and, between ``two`` blocks, pairs within one.
    """
    n = np.array([len(w) for w in words])
    band = ((1 - similarity) * n + 1e-9).astype(np.int64)
    ends = np.r_[0, np.cumsum(n)]
    _, bag = np.unique(np.concatenate([kmers(w.astype(np.uint64), 1) if len(w) else w.astype(np.uint64) for w in words]), return_inverse=True)
    held = np.zeros(bag.max(initial=0) + 1, np.int32)
    first = np.searchsorted(n, n - band)
    for i in range(len(n)):
        at = slice(first[i], i)
        met = (root[at] != root[i]) & (home[at] | home[i])
        if two:
            met &= block[at] != block[i]
        j = first[i] + np.flatnonzero(met)
        if len(j):
            own = bag[ends[i] : ends[i + 1]]
            held[own] = 1
            shared = np.r_[0, np.cumsum(held[bag[ends[j[0]] : ends[i]]])]
            held[own] = 0
            j = j[shared[ends[j + 1] - ends[j[0]]] - shared[ends[j] - ends[j[0]]] >= n[i] - band[i]]
            if len(j):
                yield i, j


def bucket_links(near: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, then: Callable | None = None) -> DataFrame:
    """(u, v): links that connect what is alike in the neighbours' buckets and has two roots.

    Where a bucket is larger than a block it is cut into strata of length, which are never alike if they
    aren't neighbours: a text is at home in its stratum and a guest in the next. Each stratum's texts are
    dealt into blocks by hash; two blocks meet in one group. ``then`` takes the links on within the worker.
    """
    members = near.select("bucket", F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("na").alias("n")), F.struct(F.col("b").alias("id"), F.col("nb").alias("n")))).alias("m")).select("bucket", "m.*")
    rooted = members.distinct().join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # Two texts of a bucket are neighbours, and texts of one root are done.
    many = rooted.groupBy("bucket").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.sum("n").alias("w")).filter("m > 2 and low < high").select("bucket", ((F.col("m") > block) | (F.col("w") > WORDS)).alias("large"))
    own = F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / F.log(F.lit(1.05 / similarity))).cast("int")
    placed = rooted.join(many, "bucket").withColumn("own", F.when(F.col("large"), own).otherwise(0))
    strata = F.when(F.col("large"), F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    placed = checkpointed(placed.withColumn("stratum", F.explode(strata)).withColumn("home", F.col("own") == F.col("stratum")).drop("own", "large"))
    cell = ["bucket", "stratum"]
    cells = placed.groupBy(cell).agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("home").alias("any"), F.sum("n").alias("w"))
    cells = cells.filter("low < high and any").select(*cell, F.ceil(F.greatest(F.col("m") / block, F.col("w") / WORDS)).alias("parts"))
    dealt = placed.join(cells, cell).withColumn("block", F.pmod(F.xxhash64("id"), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    dealt = dealt.join(texts, "id").withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    group = [*cell, "p", "q"]
    parts = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group, "n", "id").select(*group, "block", "id", "root", "home", "h")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def joined(rows: list[tuple]) -> list[tuple]:
        blocks, ids, root, home, h = zip(*(r[4:] for r in rows))
        if len(set(root)) == 1:
            return []
        words, over, links = [np.frombuffer(w, "<u4") for w in h], {}, []

        def top(r: int) -> int:
            while (p := over.get(r, r)) != r:
                r = p
            return r

        for i, js in possible(words, np.array(root), np.array(home), np.array(blocks), rows[0][2] != rows[0][3], similarity):
            own = words[i].tolist()
            for j in js:
                if (a := top(root[i])) != (b := top(root[j])) and alike(words[j].tolist(), own, similarity):
                    over[max(a, b)] = min(a, b)
                    links.append((ids[i], ids[j]))
        return links

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def stream():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))
            yield None

        for r in stream():
            if rows and (r is None or r[:4] != rows[0][:4]):
                if links := joined(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=schema)
                rows = []
            if r is not None:
                rows.append(r)

    return dealt.mapInArrow((lambda batches: then(meet(batches))) if then else meet, "u long, v long")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, then: Callable | None = None) -> DataFrame:
    """(u, v): pairs (a, b) whose texts are alike. ``texts(id, h)`` holds word hashes as bytes; ``then`` takes the pairs on within the worker."""
    hot = [hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side) for side in ("a", "b")]
    one = spread_join(pairs.select("a", "b"), texts.select(F.col("id").alias("a"), F.col("h").alias("x")), "a", hot[0])
    both = spread_join(one, texts.select(F.col("id").alias("b"), F.col("h").alias("y")), "b", hot[1])

    def make():
        read = lambda v: np.frombuffer(v, "<u4").tolist()
        return lambda a, b, x, y: ((a, b),) if alike(read(x), read(y), similarity) else ()

    return map_rows(both.select("a", "b", "x", "y"), make, "u long, v long", flat=True, then=then)


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame, list]:
    """(key, cls) of every row; (cls, class_cls, class_id): classes of the distinct texts; texts with very many copies."""
    source = docs.select(F.col(id_column).alias("key"), text_of(text_column).alias("text")).withColumn("cls", F.md5("text"))

    def sketches():
        hasher = Hasher()

        def row(cls, key, text):
            h = hasher(_FIND(text.lower()))
            return cls, key, len(h), sketch(h)

        return row

    kind = dict(docs.dtypes)[id_column]
    made = map_rows(source.select("cls", "key", "text"), sketches, f"cls string, key {kind}, n int, buckets array<struct<bucket:bigint,deep:int>>")
    folded = checkpointed(made.groupBy("cls").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("buckets").alias("buckets")))
    # Written rows have a fixed order, so their numbers are fixed as well.
    nodes = folded.select(F.monotonically_increasing_id().alias("id"), "cls", "least", "copies", "n", "buckets")
    near = neighbours(nodes.select("id", "n", F.inline("buckets")))
    pairs = checkpointed(candidates(near, similarity))
    wanted = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def word_hashes():
        hasher = Hasher()

        return lambda node, text: (node, hasher(_FIND(text.lower())).astype("<u4").tobytes())

    # One copy of each text that has a candidate, as 32-bit word hashes.
    chosen = nodes.select("id", F.col("cls").alias("_c"), F.col("least").alias("_k")).join(wanted, "id")
    one = source.join(chosen, (F.col("cls") == F.col("_c")) & F.col("key").eqNullSafe(F.col("_k")))
    texts = checkpointed(map_rows(one.select("id", "text"), word_hashes, "id long, h binary").groupBy("id").agg(F.first("h").alias("h")))
    roots = components(verified(pairs, texts, similarity, then=forest), forests=True)
    # All other pairs of the buckets, where links haven't joined them yet.
    more = bucket_links(near, texts, roots, similarity, then=forest)
    roots = components(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))), forests=True)
    named = nodes.select("id", "cls", "least").join(roots, F.col("id") == F.col("node"), "left")
    placed = checkpointed(named.select("cls", "least", F.coalesce("root", "id").alias("root")))
    sizes = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("class_id"), F.min(F.struct(F.col("least").isNull(), "least", "cls"))["cls"].alias("class_cls"))
    found = spread_join(placed.select("cls", "root"), sizes.drop("n"), "root", hot_keys(sizes.select("root", "n"), "root"))
    return source.select("key", "cls"), found.select("cls", "class_cls", "class_id"), hot_keys(folded.select("cls", F.col("copies").alias("n")), "cls")


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, kept``: one document of each class is kept, the one of least id."""
    keys, found, hot = classes(docs)
    return spread_join(keys, found, "cls", hot).select(F.col("key").alias("doc_id"), "class_id", F.coalesce(F.col("key") == F.col("class_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class, with the columns of ``docs``; of rows with the class's least id and text, any one."""
    _, found, _ = classes(docs)
    chosen = found.filter("cls = class_cls").select(F.col("cls").alias("c"), F.col("class_id").alias("k"))
    whole = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select(F.md5(text_of()).alias("cls"), F.col("doc_id").alias("key"), whole)
    rows = rows.join(chosen, (F.col("cls") == F.col("c")) & F.col("key").eqNullSafe(F.col("k"))).dropDuplicates(["c"])
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns))
