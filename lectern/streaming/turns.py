"""Turn-local analysis of a stream of turns.

Claims, references and fallacies need nothing but their own turn, so they run on streams as they are;
counts by event-time windows carry a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import claims as C


def stream_claims(turns: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Claims of streamed turns ``transcript_id, turn_index, speaker, text, span, ts``; repeated turns within the watermark count once."""
    once = turns.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["transcript_id", "turn_index"])
    rows = C.candidates(C.sentences(C.segments(once)))
    return rows.withColumn("c", C.classification(F.col("text"))).select("transcript_id", "turn_index", "speaker", "text", "span", "c.claim_type", "c.confidence")


def windowed_counts(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    return events.withWatermark(ts, watermark).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
