"""Segments, sentences, claims and frames: the turn-local part of the engine.

From turns to claims everything is a narrow projection (split, explode, filter); windows and groups
appear only where claims of a turn are listed or frames look at the turn before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T

# Discourse markers, claim indicators, relation markers, claim types.
SEGMENT_MARKERS = ("but", "however", "on the other hand", "pushes back", "disagrees", "counters", "although", "nevertheless", "yet")
INDICATORS = (
    r"\b\d+%", r"\b\d{4}\b", r"\b\d+\s*(milliseconds?|seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b", r"\b\d+\s*(percent|million|billion|thousand)\b",
    r"\bstud(?:y|ies)\b", r"\bresearch\b", r"\bdata\b", r"\bevidence\b", r"\bshows?\b", r"\bproves?\b", r"\bdemonstrates?\b", r"\bfound\b", r"\bmeasured?\b", r"\bprecedes?\b", r"\bcauses?\b", r"\baffects?\b",
)
VERBS = ("is", "are", "was", "were", "has", "have", "shows", "proves")
REBUTTALS = (r"^\s*but\b", r"^\s*however\b", r"\bhowever,", r"\byet\b", r"\balthough\b", r"\bdisagrees?\b", r"\bwrong\b", r"\bincorrect\b", r"\bthat's not\b", r"\bthat argument\b", r"\bignores?\b")
SUPPORTS = (r"\bbecause\b", r"\btherefore\b", r"\bthus\b", r"\bproves?\s+that\b", r"\bshows?\s+that\b", r"\bevidence\s+(that|for)\b", r"\bdemonstrates?\b", r"\bsince\b")
NUMERIC = r"\b\d+%|\b\d+\s*(percent|million|billion|thousand)"
RULES = (
    ("methodological", 0.8, "contains methodology keywords", ("methodology", "sample", "controlled", "experiment", "study design")),
    ("empirical", 0.75, "contains empirical keywords", ("study", "research", "data", "evidence", "found", "measured")),
    ("normative", 0.8, "contains normative language", ("should", "ought", "must", "wrong", "right")),
    ("philosophical", 0.85, "contains philosophical keywords", ("free will", "consciousness", "determinism", "existence", "meaning")),
)
FIRST_PERSON = r"^i (think|believe|feel|know)"
FUTURE = ("will", "going to", "might", "probably")
CLAIM_TYPES = ("empirical", "methodological", "normative", "conceptual", "introspective", "predictive", "philosophical", "unclassified")
CHECKABLE = ("empirical", "methodological", "predictive")
CLAIM_PATH = ("DecomposeTranscript", "ProcessTurn", "ExtractClaimsFromSegment", "ExtractAtomicClaim")
FRAME_PATH = ("DecomposeTranscript", "ProcessTurn", "BuildArgumentFrame")
MIN_SEGMENT, MIN_CLAIM = 10, 5


def path(steps: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, steps))


def any_of(patterns: tuple[str, ...]) -> str:
    return "(?U)" + "|".join(f"(?:{p})" for p in patterns)


def segments(turns: DataFrame) -> DataFrame:
    """Turns cut before every discourse marker; a segment's span covers its unstripped piece."""
    marker = rf"(?i)(?U)(?=\b(?:{'|'.join(SEGMENT_MARKERS)})\b)"
    pieces = T.with_starts(F.split("text", marker))
    each = turns.select("transcript_id", "turn_index", "speaker", "span", F.posexplode(pieces).alias("position", "p"), (F.size(F.split("text", marker)) == 1).alias("alone"))
    each = each.withColumn("piece", F.col("p.piece")).withColumn("start", F.col("span.start") + F.col("p.start")).withColumn("segment", T.strip(F.col("piece")))
    each = each.filter((F.col("segment") != "") | F.col("alone"))
    end = F.when(F.col("alone"), F.col("span.end")).otherwise(F.col("start") + F.length("piece"))
    return each.select("transcript_id", "turn_index", "speaker", F.col("position").alias("segment_index"), F.col("segment").alias("text"), F.struct(F.col("start").cast("int").alias("start"), end.cast("int").alias("end")).alias("span"))


def sentences(segmented: DataFrame) -> DataFrame:
    """Sentences of the segments that are long enough, with spans counted from the segment's start."""
    pieces = T.with_starts(F.split("text", r"(?U)(?<=[.!?])(?=\s+[A-Z])"))
    rows = segmented.filter(F.length("text") > MIN_SEGMENT)
    each = rows.select("transcript_id", "turn_index", "speaker", "segment_index", "span", F.posexplode(pieces).alias("sentence_index", "p")).withColumn("piece", F.col("p.piece"))
    lead = F.length("piece") - F.length(F.regexp_replace("piece", r"(?U)^\s+", ""))
    each = each.withColumn("start", F.col("span.start") + F.col("p.start") + lead).withColumn("sentence", T.strip(F.col("piece"))).filter("sentence <> ''")
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.length("sentence")).cast("int").alias("end"))
    return each.select("transcript_id", "turn_index", "speaker", "segment_index", "sentence_index", F.col("sentence").alias("text"), span.alias("span"))


def looks_like_claim(text: Column) -> Column:
    low = F.lower(text)
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    return F.regexp_like(low, F.lit(any_of(INDICATORS))) | ((words >= 5) & F.regexp_like(low, F.lit(f" (?:{'|'.join(VERBS)}) ")))


def candidates(sentenced: DataFrame) -> DataFrame:
    return sentenced.filter(looks_like_claim(F.col("text")))


def classification(text: Column) -> Column:
    """Struct (claim_type, confidence, reason): the first rule that matches."""
    low = F.lower(text)
    holds = lambda keys: F.regexp_like(low, F.lit("|".join(keys)))
    told = lambda t, c, r: F.struct(F.lit(t).alias("claim_type"), F.lit(c).alias("confidence"), F.lit(r).alias("reason"))
    chain = F.when(F.regexp_like(low, F.lit(f"(?U){NUMERIC}")), told("empirical", 0.85, "contains numeric/statistical data"))
    for kind, confidence, reason, keys in RULES:
        chain = chain.when(holds(keys), told(kind, confidence, reason))
    chain = chain.when(F.regexp_like(low, F.lit(FIRST_PERSON)), told("introspective", 0.9, "first-person mental state"))
    chain = chain.when(holds(FUTURE), told("predictive", 0.7, "contains predictive language"))
    return chain.otherwise(told("unclassified", 0.3, "no strong pattern match"))


def claims(turns: DataFrame) -> DataFrame:
    """Atomic claims with type, confidence and reasons; equal text at one span is one claim."""
    rows = candidates(sentences(segments(turns))).filter(F.length("text") > MIN_CLAIM)
    rows = rows.withColumn("claim_id", T.claim_key(F.col("text"), F.col("span.start"), F.col("span.end"))).withColumn("c", classification(F.col("text")))
    return rows.select(
        "transcript_id", "turn_index", "segment_index", "sentence_index", "claim_id", "text", "speaker", "span", "c.claim_type", "c.confidence",
        F.array("c.reason").alias("confidence_reasons"), path(CLAIM_PATH).alias("method_path"), F.concat(F.lit("turn_"), F.col("turn_index")).alias("scope_id"),
        F.lit(True).alias("requires_review"), ((F.col("c.claim_type") == "unclassified") | (F.col("c.confidence") < 0.6)).alias("review_flag"), F.col("c.claim_type").isin(*CHECKABLE).alias("checkable"),
    ).dropDuplicates(["transcript_id", "claim_id"])


def claim_order() -> list[Column]:
    return [F.col("turn_index"), F.col("segment_index"), F.col("sentence_index")]


def with_answers(found: DataFrame, answers: DataFrame, budget: int = 100) -> DataFrame:
    """Types from an answer table ``text, claim_type, confidence, reasoning`` override the rules.

    Answers count against the budget of their transcript in claim order; an unknown type counts, but
    the rules' result stays. Of a text's several answers the least by type, confidence and reasoning counts.
    """
    known = answers.select(F.col("text").alias("_text"), F.lower("claim_type").alias("_type"), F.col("confidence").alias("_confidence"), F.col("reasoning").alias("_reasoning"))
    one = known.groupBy("_text").agg(F.min(F.struct("_type", "_confidence", "_reasoning")).alias("_a")).select("_text", "_a.*")
    rows = found.join(one, F.col("text") == F.col("_text"), "left")
    nth = F.count("_text").over(Window.partitionBy("transcript_id").orderBy(*claim_order()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_nth", nth).withColumn("llm_used", F.col("_text").isNotNull() & (F.col("_nth") <= budget))
    use = F.col("llm_used") & F.col("_type").isin(*CLAIM_TYPES)
    reason = F.array(F.concat(F.lit("LLM classification: "), F.coalesce("_reasoning", F.lit("no reason"))))
    rows = rows.withColumn("claim_type", F.when(use, F.col("_type")).otherwise(F.col("claim_type"))).withColumn("confidence", F.when(use, F.coalesce("_confidence", F.lit(0.85))).otherwise(F.col("confidence")))
    return rows.withColumn("confidence_reasons", F.when(use, reason).otherwise(F.col("confidence_reasons"))).drop("_text", "_type", "_confidence", "_reasoning", "_nth")


def relation(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.regexp_like(low, F.lit(any_of(REBUTTALS))), "REBUTTAL").when(F.regexp_like(low, F.lit(any_of(SUPPORTS))), "SUPPORT")


def frames(turns: DataFrame, found: DataFrame) -> DataFrame:
    """One frame a turn: its relation to the turn before, its claims in order."""
    listed = found.groupBy("transcript_id", "turn_index").agg(F.sort_array(F.collect_list(F.struct("segment_index", "sentence_index", "claim_id"))).alias("c"))
    told = F.when(F.col("turn_index") > 0, relation(F.col("text")))
    rows = turns.withColumn("relation", told).join(listed, ["transcript_id", "turn_index"], "left")
    ids = F.coalesce(F.transform("c", lambda x: x["claim_id"]), F.array().cast("array<string>"))
    parent = F.when(F.col("relation").isNotNull(), F.concat(F.lit("frame_"), F.col("turn_index") - 1))
    confidence = F.when(F.col("relation") == "REBUTTAL", 0.8).otherwise(0.7)
    return rows.select(
        "transcript_id", "turn_index", F.concat(F.lit("frame_"), F.col("turn_index")).alias("frame_id"), F.concat("speaker", F.lit("'s argument")).alias("summary"), F.coalesce("relation", F.lit("CLAIM")).alias("frame_type"),
        "speaker", "span", parent.alias("parent_frame_id"), ids.alias("child_claim_ids"), confidence.alias("confidence"), path(FRAME_PATH).alias("method_path"),
    )
