"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal-token slots. Slot ``s`` takes its source from the golden-ratio point
``frac(s * phi)`` among the cumulative target shares, so every stretch of the schedule is near the
targets. The r-th slot of a source takes the r-th block of that source's token stream: its documents
in hash order, end to end, up to ``MAX_EPOCHS`` times over. A source's ranks run from 0 without gaps, so
the join of blocks to slots is a comparison of a block's number with the source's number of slots. What
slots are short of, or beyond, a source's target (a few blocks) is settled at the end: its stream ends
at the target, rounded to a word.

A block holds a ``FINE``-th of the least target, so small sources get slots of their own; only where
that makes more than ``MAX_SLOTS`` slots are blocks larger, and the settlement alone decides for sources
of less than a block: no size of corpus or source moves a target.

Positions in a stream are prefix sums by two levels (hash buckets, then rows within a bucket), and slot
ranks likewise (stretches of slots, then slots within a stretch), so no task sees a whole source. Only
one row per source comes to the driver.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own
and comes last; repeated rows are rows of their own; an empty table gives an empty mix; reruns agree,
since order comes from hashes only; texts are counted whole; extra columns are ignored or, in
``mixed_rows``, kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import WORD, checkpointed, row_key, text_of

MAX_EPOCHS, MAX_SLOTS, FINE, WEIGHTS = 3, 1 << 27, 128, (1, 2, 3)
#: Blocks that the settlement adds to a source's slots, or takes from them, at most.
SETTLE = FINE // 2
#: Rows of a prefix-sum bucket and slots of a stretch, about.
BUCKET_ROWS, STRETCH = 2_000, 4_096
#: The golden ratio's fraction as a 32-bit number: slot s lies at s * GOLDEN modulo 2 ** 32.
GOLDEN, CIRCLE = 0x9E3779B9, 1 << 32


def targets(sizes: Sequence[int], weights: Sequence[int], total: float, epochs: int = MAX_EPOCHS) -> list[float]:
    """Shares of ``total`` by weight, none above ``epochs`` times its size; the excess is shared anew."""
    got, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while free:
        unit = rest / sum(weights[i] for i in free)
        above = [i for i in free if weights[i] * unit > epochs * sizes[i]]
        if not above:
            for i in free:
                got[i] = weights[i] * unit
            break
        for i in above:
            got[i] = float(epochs * sizes[i])
            rest -= got[i]
        free = [i for i in free if i not in set(above)]
    return got


def measured(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Row keys with sources and sizes, materialised: everything else works on this small table."""
    size = F.regexp_count(text_of(text), F.lit(WORD)).cast("long")
    return checkpointed(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size")))


def plan(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> list[dict]:
    """One entry per source, in mixing order: its number, size, rows and target. Sources come to the driver; rows don't."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    goal = targets([r["size"] for r in rows], [weights[i % len(weights)] for i in range(len(rows))], sum(r["size"] for r in rows), epochs)
    return [{"source_no": i, "source": r.source, "source_size": r["size"], "n": r["n"], "target": t} for i, (r, t) in enumerate(zip(rows, goal))]


def block_words(sources: list[dict], most: int = MAX_SLOTS) -> int:
    """Words of a block: a share of the least target, or what ``most`` slots need."""
    total, least = sum(s["source_size"] for s in sources), min((s["target"] for s in sources if s["target"] > 0), default=0)
    return max(1, int(least) // FINE, -(-total // most))


def _ends(sources: list[dict]) -> np.ndarray:
    return np.round(np.cumsum([s["target"] for s in sources]) / max(sum(s["source_size"] for s in sources), 1) * CIRCLE).astype(np.int64)


def _chosen(slot: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.minimum(np.searchsorted(ends, slot * GOLDEN % CIRCLE, "right"), len(ends) - 1).astype(np.int32)


def _slots(sources: list[dict], block: int) -> int:
    return -(-sum(s["source_size"] for s in sources) // block)


def slots_per_source(spark: SparkSession, sources: list[dict], block: int) -> list[int]:
    """How many slots each source gets: one past its last rank."""
    ends = _ends(sources)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.bincount(_chosen(b.column(0).to_numpy(), ends), minlength=len(ends))
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], ["source_no", "n"])

    out = [0] * len(sources)
    if sources:
        for r in spark.range(_slots(sources, block)).mapInArrow(count, "source_no int, n long").groupBy("source_no").agg(F.sum("n").alias("n")).collect():
            out[r.source_no] = r.n
    return out


def schedule(spark: SparkSession, sources: list[dict], block: int | None = None) -> DataFrame:
    """(slot, source_no, rank): the mix, slot by slot."""
    n, ends = _slots(sources, block or block_words(sources)), _ends(sources)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(_chosen(slot, ends))], ["slot", "source_no"])

    stretch = F.floor(F.col("slot") / STRETCH)
    slots = spark.range(n).toDF("slot").mapInArrow(choose, "slot long, source_no int").withColumn("stretch", stretch)
    counts = slots.groupBy("source_no", "stretch").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "stretch").orderBy("slot")
    ranked = slots.withColumn("nth", F.row_number().over(within)).join(counts, ["source_no", "stretch"])
    return ranked.select("slot", "source_no", (F.col("base") + F.col("nth") - 1).alias("rank"))


def stream(sizes: DataFrame, sources: list[dict]) -> DataFrame:
    """Rows with ``at``, their first token's place in their source's shuffled stream, the words that the slots of their source hold and those that the settlement may move."""
    spark = sizes.sparkSession
    head = pa.schema([("source_no", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("n", pa.int64()), ("target", pa.float64()), ("scheduled", pa.int64())])
    block = block_words(sources)
    slots = slots_per_source(spark, sources, block)
    # As an Arrow table: a list of rows would start Python workers of another kind on every executor.
    table = spark.createDataFrame(pa.Table.from_pylist([s | {"scheduled": block * n} for s, n in zip(sources, slots)], head))
    rows = sizes.join(table.select("source_no", F.col("source").alias("_s"), "source_size", "n", "target", "scheduled"), F.col("source").eqNullSafe(F.col("_s")))
    rows = rows.withColumn("h", F.xxhash64(F.lit("mix"), "key", "size"))
    rows = rows.withColumn("bucket", F.pmod("h", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_ROWS))))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("h", "key", "size")
    rows = rows.withColumn("nth", F.row_number().over(within))
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(sums, ["source_no", "bucket"])
    return rows.select("key", "size", "source_no", "source_size", "target", "scheduled", F.lit(SETTLE * block).alias("reach"), (F.col("base") + F.col("inside")).alias("at"))


def overlap(start: Column, end: Column, epochs: int = MAX_EPOCHS) -> Column:
    """The words that a row of ``stream`` has from ``start`` to ``end`` of its source's stream, over all epochs."""
    at = lambda e: F.col("at") + F.col("source_size") * e
    return reduce(Column.__add__, [F.greatest(F.lit(0), F.least(at(e) + F.col("size"), end) - F.greatest(at(e), start)) for e in range(epochs)])


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Every row's ``key, size, source_size, target, by_slots, taken``: the words that the mix takes from it.

    ``by_slots`` is what the slots' blocks hold of it; ``taken`` has the settlement at the end of its
    source's stream as well.
    """
    sizes = measured(docs, key, source, text)
    sources = plan(sizes, weights, epochs)
    if not sources:
        return sizes.select("key", "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("by_slots"), F.col("size").alias("taken"))
    goal, zero = F.least(F.greatest(F.round("target").cast("long"), F.col("scheduled") - F.col("reach")), F.col("scheduled") + F.col("reach")), F.lit(0).cast("long")
    got = overlap(zero, F.col("scheduled"), epochs)
    short = overlap(F.col("scheduled"), goal, epochs)  # what the slots don't reach, at most a few blocks a source
    over = overlap(goal, F.col("scheduled"), epochs)  # and what they go beyond
    return stream(sizes, sources).select("key", "size", "source_size", "target", got.alias("by_slots"), (got + short - over).alias("taken"))


def mixed_rows(docs: DataFrame, source: str = "source", text: str = "text", weights: Sequence[int] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix as rows of ``docs``: each as often as its words are taken, rounded to whole texts, never cut.

    Rows of size 0 are left out. At most one row per source is taken in part, so rounding moves a source
    by less than one text. Rows go by 128-bit hashes.
    """
    kinds = dict(docs.dtypes)
    key = row_key(*(F.to_json(F.struct(F.col(c))) if "map<" in kinds[c] else F.col(c) for c in docs.columns)).alias("key")
    taken = mix(docs.select(key, F.col(source).alias("source"), F.col(text).alias("text")), "key", "source", "text", weights, epochs).filter("size > 0")
    copies = taken.groupBy("key").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(key, F.struct(*(F.col(c) for c in docs.columns)).alias("row")).dropDuplicates(["key"]).join(copies, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def mixture(docs: DataFrame) -> DataFrame:
    """The contract's rows, and the words by slots alone."""
    return mix(docs).select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken", "by_slots")
