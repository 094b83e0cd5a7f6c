"""Corpus pipeline: rules, near-duplicates, repeated passages, mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns the next
stage's documents. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, minhash_dedup, mixing, quality_rules, repeat_removal
from lectern.llm.common import checkpointed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the current policy.

    A null or empty text has no words and goes; long texts are measured whole; repeated rows are judged
    alike; an empty table stays empty; further columns are kept, whatever their names.
    """
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one of least doc_id (nulls last).

    Null and empty texts are one class; long texts are compared whole; of repeated rows, or rows that share
    id and text, one stays, with its own further columns; an empty table stays empty; further columns are
    kept, whatever their names.
    """
    return minhash_dedup.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that start anywhere else; documents with nothing left go.

    A null text becomes an empty one and stays, as texts under 200 bytes do; long texts are cut whole;
    repeated rows repeat each other and go; an empty table stays empty; ``n_chars`` follows the text, further
    columns are kept, whatever their names.
    """
    cut = repeat_removal.deduplicated(docs)
    return cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Rows without a word aren't taken; a null source is a source and comes last; equal rows count one by one;
    an empty table stays empty; further columns are kept, whatever their names.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix.

    A null text counts as empty; long texts are cut into chunks and stitched; repeated rows give repeated
    rows; an empty table gives no rows; further columns are left out.
    """
    return byte_bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: Sketches, components and byte windows can't be told in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
