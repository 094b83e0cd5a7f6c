"""Sinks: analysis documents, labelled text, subtitles and saved files.

Documents are built per transcript as JSON strings, so writing them is a plain distributed write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def _listed(rows: DataFrame, name: str, order: tuple[str, ...], **fields) -> DataFrame:
    entry = F.struct(*(F.col(o).alias(f"_{i}") for i, o in enumerate(order)), F.struct(*(c.alias(n) for n, c in fields.items())).alias("e"))
    return rows.groupBy("transcript_id").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias(name))


def analysis_documents(claims: DataFrame, frames: DataFrame, fact_checks: DataFrame | None, stats: DataFrame) -> DataFrame:
    """(transcript_id, document): claims, frames, fact checks and counts as one JSON object."""
    c = F.col
    span = F.array("span.start", "span.end")
    parts = [
        _listed(claims, "claims", ("turn_index", "segment_index", "sentence_index"), id=c("claim_id"), text=c("text"), claim_type=c("claim_type"), speaker=c("speaker"), confidence=c("confidence"), span=span),
        _listed(frames, "frames", ("turn_index",), id=c("frame_id"), frame_type=c("frame_type"), speaker=c("speaker"), summary=c("summary"), child_claims=c("child_claim_ids"), parent_frame=c("parent_frame_id")),
    ]
    if fact_checks is not None:
        parts.append(_listed(fact_checks, "fact_checks", ("claim_id",), claim_id=c("claim_id"), status=c("status"), confidence=c("confidence"), summary=c("summary"), sources=c("sources")))
    counts = stats.select("transcript_id", F.struct("tasks_executed", "claims_count", "frames_count", "fact_checks_count", F.when(c("llm_calls") > 0, c("llm_calls")).alias("llm_calls")).alias("stats"))
    rows = counts
    for p in parts:
        rows = rows.join(p, "transcript_id", "left")
    lists = [n for n in ("claims", "frames", "fact_checks") if n in rows.columns]
    whole = F.struct(*(F.coalesce(c(n), F.array().cast(dict(rows.dtypes)[n])).alias(n) for n in lists), "stats")
    return rows.select("transcript_id", F.to_json(whole).alias("document"))


def labelled_text(utterances: DataFrame) -> DataFrame:
    """(transcript_id, text): ``SPEAKER: text`` blocks with blank lines between."""
    line = F.struct("turn_index", F.concat_ws(": ", "speaker", "text").alias("l"))
    return utterances.groupBy("transcript_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["l"]), "\n\n").alias("text"))


def subtitles(utterances: DataFrame) -> DataFrame:
    """(transcript_id, srt) from utterances with ``start_ms`` and ``end_ms``."""
    block = F.concat(F.lit("\n"), T.srt_time(F.col("start_ms")), F.lit(" --> "), T.srt_time(F.col("end_ms")), F.lit("\n["), "speaker", F.lit("] "), "text", F.lit("\n"))
    listed = F.sort_array(F.collect_list(F.struct("turn_index", block.alias("b"))))
    return utterances.groupBy("transcript_id").agg(F.array_join(F.transform(listed, lambda x, i: F.concat((i + 1).cast("string"), x["b"])), "\n").alias("srt"))


def speech_documents(utterances: DataFrame, summary: DataFrame) -> DataFrame:
    """(transcript_id, document): recognised speech with its metadata as JSON."""
    c = F.col
    listed = _listed(utterances, "utterances", ("turn_index",), speaker=c("speaker"), text=c("text"), start_ms=c("start_ms"), end_ms=c("end_ms"), confidence=c("confidence"))
    full = _listed(utterances, "said", ("turn_index",), text=c("text")).select("transcript_id", F.array_join(F.col("said.text"), " ").alias("full_text"))
    rows = summary.join(listed, "transcript_id", "left").join(full, "transcript_id", "left")
    metadata = F.struct(F.col("duration_ms").alias("audio_duration_ms"), "speaker_count", "language", "utterance_count").alias("metadata")
    return rows.select("transcript_id", F.to_json(F.struct(metadata, "utterances", "full_text")).alias("document"))


def saved_analyses(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows to save: id, time, input and result."""
    rows = texts.join(documents, "transcript_id", "left")
    result = F.struct(F.col("document").isNotNull().alias("success"), F.col("document").alias("result"), F.when(F.col("document").isNull(), "no result").alias("error"))
    return rows.select(F.col("transcript_id").cast("string").alias("id"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("text").alias("input_text"), F.length("text").cast("long").alias("input_length"), result.alias("analysis_result"))


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_documents(documents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document a line."""
    documents.select(F.col("document").alias("value")).write.mode(mode).text(path)
