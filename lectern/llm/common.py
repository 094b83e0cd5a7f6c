"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the size and quality contracts: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults: rows hold whole texts.
BATCH_ROWS, BATCH_KEY, DEFAULT_ROWS = 1_000, "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
BATCH_BYTES, BYTES_KEY = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Executors keep idle Python workers for later tasks; with these they give freed memory back to the system, where the session sets nothing else.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "4194304", "MALLOC_ARENA_MAX": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def importable(spark: SparkSession) -> None:
    """Let Python workers on machines that hold this package at the driver's path import it; keep batches small.

    Elsewhere the package travels by ``--py-files`` or ``addPyFile`` as usual.
    """
    if spark.conf.get(BATCH_KEY, DEFAULT_ROWS) == DEFAULT_ROWS:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)
    if spark.conf.get(BYTES_KEY, None) is None:
        spark.conf.set(BYTES_KEY, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment
    for k, v in WORKER_MEMORY.items():
        known.setdefault(k, v)
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple | Iterable[tuple]]], schema: str, flat: bool = False, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """Apply a row function in Arrow batches.

    ``make`` runs once per task and returns the row function, which takes the columns of ``df`` by
    position and returns a tuple for ``schema`` (an iterable of tuples if ``flat``). No batch outlives
    its own output, so memory is bounded by one Arrow batch. ``then`` takes the batches of ``schema`` on to
    others of it within the same worker: each further ``mapInArrow`` of a stage is another worker a core.
    """
    importable(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                args = zip(*(c.to_pylist() for c in part.columns))
                rows = [x for a in args for x in row(*a)] if flat else [row(*a) for a in args]
                if rows:
                    cols = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.mapInArrow((lambda batches: then(run(batches))) if then else run, out)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder that ``spark.checkpoint.dir`` names.

    A session on one machine that leaves the setting unset (tests) gets a local folder; on a cluster a
    local folder would go with its executor, so there the setting is required. Files stay until the
    folder is emptied or, with ``spark.cleaner.referenceTracking.cleanCheckpoints``, until the table is
    no longer referenced.
    """
    sc = df.sparkSession.sparkContext
    importable(df.sparkSession)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints/lectern")
    return df.checkpoint(eager=True)


#: A key is hot if it holds more than one in ``SHARE`` of all rows: fewer than ``SHARE`` keys ever are.
SHARE = 256


def hot_keys(counted: DataFrame, key: str, n: str = "n") -> list:
    """The hot keys of ``counted(key, n)``, one row a key, for the driver: fewer than ``SHARE`` values."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counted.filter((F.col(n) > 1) & (F.col(n) * SHARE > total)).select(key).collect()]


def spread_join(many: DataFrame, one: DataFrame, keys: str | list[str], hot: list, how: str = "inner") -> DataFrame:
    """``many.join(one, keys)`` with the rows of hot values of the first key dealt over all partitions.

    Each hot row of ``many`` gets a salt from its other columns; the rows of ``one`` with a hot key, which
    hold each key once or a few times, are repeated for every salt.
    """
    keys = [keys] if isinstance(keys, str) else keys
    if not hot:
        return many.join(one, keys, how)
    pieces = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = F.col(keys[0]).isin(hot)
    own = F.pmod(F.xxhash64(F.lit("salt"), *(F.col(c) for c in many.columns if c not in keys)), F.lit(pieces)).cast("int")
    left = many.withColumn("_salt", F.when(is_hot, own).otherwise(0))
    every = F.when(is_hot, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    return left.join(one.withColumn("_salt", F.explode(every)), [*keys, "_salt"], how).drop("_salt")


def row_key(*columns: Column) -> Column:
    """128 bits of the columns' values as text: enough for any number of rows."""
    return F.concat_ws("-", F.hex(F.xxhash64(F.lit(0), *columns)), F.hex(F.xxhash64(F.lit(1), *columns)))


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
