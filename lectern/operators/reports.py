"""Filters, lookups, summaries, chunks and clusters of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import rhetoric as H

# What each filter takes out, on lower-cased text. The patterns are this engine's own.
FILTERS = {
    "conversational": r"^(?:\W*\b(?:yeah|yes|no|right|mhm|uh|um|okay|ok|sure|well|so|exactly|wow|hmm|i see|you know|that's the thing)\b\W*)+(?:there)?\W*$",
    "question": r"\?\s*$|^(?:who|what|when|where|why|how|do|does|did|is|are|was|were|can|could|would|will|should|have|has)\b[^.!]*\?",
    "hypothetical": r"\b(?:suppose|imagine|let's say|what if|for example|for instance|hypothetically|assume that|say you)\b",
    "sponsor": r"\b(?:sponsor(?:ed|s)?|promo code|discount|use code|free trial|sign up (?:at|for)|today's episode is brought|check out our|link in the description)\b",
    "metadata": r"^(?:chapter|part|episode|section|title|speaker|transcript|\[[^\]]*\]|\([^)]*\)|[a-z]+:)\s*\S{0,12}\s*$",
    "minimum_content": r"^\W*(?:\w+\W+){0,2}\w*\W*$",
    "pleasantry": r"\b(?:welcome (?:back|to)|thanks? (?:you )?for (?:having|joining|listening|watching|coming)|good (?:morning|evening|afternoon)|nice to (?:meet|see) you|my pleasure|see you next)\b",
    "biographical": r"^(?:when )?i (?:was|grew|went|had|met|remember|used to|lived|worked|studied)\b|\bmy (?:mother|father|wife|husband|son|daughter|childhood|family)\b",
    "truncation": r"(?:\.\.\.|…|-{1,2}|,|\b(?:and|or|but|the|a|an|of|to|with|because|that))\s*$",
    "vague_pronoun": r"^(?:it|this|that|they|these|those|he|she)(?:'s|'re)?\s+(?:is|are|was|were|does|do|did|has|had)?\s*(?:\w+\W*){0,2}$",
    "discourse": r"^(?:and|but|so|because|or|like|i mean|you know|anyway|by the way)\b\W*(?:\w+\W*){0,3}$",
    "mangled": r"\b\w{30,}\b|[^\w\s]{5,}",
}
NOTES = {
    "conversational": "conversational filler", "question": "question", "hypothetical": "hypothetical scenario", "sponsor": "promotion", "metadata": "title or label", "minimum_content": "fragment without content",
    "pleasantry": "greeting or farewell", "biographical": "personal anecdote", "truncation": "truncated sentence", "vague_pronoun": "sentence about an unnamed subject", "discourse": "connecting phrase", "mangled": "corrupted text",
}
# Kinds of claims that rest on facts, and words of a stance.
EMPIRICAL_TYPES = ("empirical", "methodological", "predictive", "statistical", "causal", "comparative", "historical", "factual")
FOR, AGAINST = ("because", "therefore", "thus", "proves", "shows", "agree", "support"), ("not", "but", "however", "wrong", "never", "disagree", "against")


def filter_reasons(text: Column) -> Column:
    """Names of the filters that take a text out, in the order of their definition."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(F.regexp_like(low, F.lit(f"(?U){p}")), name) for name, p in FILTERS.items())))


def filtered(claims: DataFrame, names: tuple[str, ...] = tuple(FILTERS)) -> DataFrame:
    """Claims that no named filter takes out."""
    return claims.filter(~F.arrays_overlap(filter_reasons(F.col("text")), F.array(*map(F.lit, names))))


def filter_counts(claims: DataFrame) -> DataFrame:
    """``filter, n``: how many claims each filter takes out; one claim may count for several."""
    return claims.select(F.explode(filter_reasons(F.col("text"))).alias("filter")).groupBy("filter").agg(F.count("*").alias("n"))


def category(claim_type: Column) -> Column:
    return F.when(F.lower(claim_type).isin(*EMPIRICAL_TYPES), "empirical").otherwise("narrative")


def _counts(rows: DataFrame, column: str, name: str) -> DataFrame:
    per = rows.groupBy("transcript_id", column).agg(F.count("*").alias("n"))
    return per.groupBy("transcript_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(column, "n")))).alias(name))


def claim_summary(claims: DataFrame) -> DataFrame:
    """``transcript_id, total, by_type, by_category``."""
    rows = claims.withColumn("category", category(F.col("claim_type")))
    total = rows.groupBy("transcript_id").agg(F.count("*").alias("total"))
    return total.join(_counts(rows, "claim_type", "by_type"), "transcript_id").join(_counts(rows, "category", "by_category"), "transcript_id")


def severity_summary(fallacies: DataFrame) -> DataFrame:
    """``transcript_id, by_severity, confidence_distribution`` with every band, zeros included."""
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low")
    each = lambda c: F.create_map(*(x for b in ("high", "medium", "low") for x in (F.lit(b), F.sum((c == b).cast("long")))))
    return fallacies.withColumn("_band", band).groupBy("transcript_id").agg(each(F.col("severity")).alias("by_severity"), each(F.col("_band")).alias("confidence_distribution"))


def overview(turns: DataFrame, claims: DataFrame, fallacies: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """What a results page counts: claims, speakers, fallacies, characters, and checks by status."""
    rows = turns.groupBy("transcript_id").agg(F.count_distinct(F.when(F.col("speaker") != T.UNKNOWN, F.col("speaker"))).alias("speakers"), F.max("span.end").cast("long").alias("characters"))
    for part, name in ((claims, "claims"), (fallacies, "fallacies")):
        rows = rows.join(part.groupBy("transcript_id").agg(F.count("*").alias(name)), "transcript_id", "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    return rows if checks is None else rows.join(_counts(checks, "status", "verification_summary"), "transcript_id", "left")


def checked_claims(claims: DataFrame, checks: DataFrame) -> DataFrame:
    """Claims with their checks and a sentence that explains them."""
    told = checks.select("transcript_id", "claim_id", "status", F.col("confidence").alias("check_confidence"), "summary")
    rows = claims.join(told, ["transcript_id", "claim_id"], "left")
    return rows.withColumn("explanation", explanation(F.col("text"), F.col("status"), F.col("summary")))


def explanation(text: Column, status: Column, source: Column) -> Column:
    """A plain sentence on a check; a text that a filter would take out says so first."""
    why = F.get(filter_reasons(text), F.lit(0))
    notes = F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair))
    by = F.when(source.isNotNull(), F.concat(F.lit(" Source: "), source, F.lit("."))).otherwise("")
    return (
        F.when(why.isNotNull(), F.concat(F.lit("This appears to be a "), notes[why], F.lit(" rather than a factual claim.")))
        .when(status == "verified", F.concat(F.lit("This claim is TRUE."), by)).when(status == "false", F.concat(F.lit("This claim is FALSE."), by))
        .when(status == "disputed", F.concat(F.lit("This claim has MIXED EVIDENCE."), by)).otherwise("This claim could NOT BE VERIFIED.")
    )


def entity_named(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The first registered entity whose canonical name or alias a name equals, case and outer space aside: ``transcript_id, name, entity_id``."""
    forms = F.array_distinct(F.transform(F.concat(F.array("canonical"), "aliases"), lambda x: T.strip(F.lower(x))))
    known = entities.select("transcript_id", "entity_id", "registered", F.explode(forms).alias("_form"))
    asked = names.select("transcript_id", "name", T.strip(F.lower("name")).alias("_form"))
    return asked.join(known, ["transcript_id", "_form"]).groupBy("transcript_id", "name").agg(F.min_by("entity_id", F.struct("registered", "entity_id")).alias("entity_id"))


def matches(name: Column, canonical: Column, aliases: Column) -> Column:
    """Whether a name is an entity's: canonical or an alias, case and outer space aside."""
    low = T.strip(F.lower(name))
    return (low == T.strip(F.lower(canonical))) | F.exists(aliases, lambda x: T.strip(F.lower(x)) == low)


def by_id(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is asked for: ``ids(transcript_id, column)``."""
    return rows.join(ids.select("transcript_id", column).distinct(), ["transcript_id", column], "left_semi")


def static_claims(blocks: DataFrame, responses: DataFrame) -> DataFrame:
    """Prepared claims of text blocks ``block_id, text``: by the exact text, else by the first pattern it contains.

    ``responses(pattern, pattern_order, claim, confidence)`` may hold several claims a pattern. Patterns come
    in their order; the containment test meets a pattern's first gram in the texts, as fact checks do.
    """
    from lectern.operators.facts import first_responses

    exact = blocks.select("block_id", T.strip(F.col("text")).alias("pattern")).join(responses.select("pattern").distinct(), "pattern")
    rest = blocks.join(exact.select("block_id"), "block_id", "left_anti").select(F.lit(0).alias("transcript_id"), F.col("block_id").alias("claim_id"), T.strip(F.col("text")).alias("text"))
    keys = responses.groupBy("pattern").agg(F.min("pattern_order").alias("key_order")).select(F.col("pattern").alias("key"), "key_order", F.col("pattern").alias("status"), F.lit(0.0).alias("confidence"), F.lit("").alias("source"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<string>").alias("urls"))
    found = first_responses(rest, keys).select(F.col("claim_id").alias("block_id"), F.col("response.status").alias("pattern"))
    return exact.select("block_id", "pattern").unionByName(found).join(responses, "pattern").select("block_id", "pattern", "claim", "confidence")


def chunks(turns: DataFrame, size: int = 1500) -> DataFrame:
    """``transcript_id, chunk, first_turn, last_turn, n_chars, speakers``: runs of whole turns that begin within ``size`` characters."""
    rows = turns.withColumn("chunk", F.floor(F.col("span.start") / size).cast("int"))
    return rows.groupBy("transcript_id", "chunk").agg(F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.array_sort(F.collect_set("speaker")).alias("speakers"))


def stance(text: Column) -> Column:
    low = F.lower(text)
    has = lambda ws: F.regexp_like(low, F.lit(rf"(?U)\b(?:{'|'.join(ws)})\b"))
    return F.when(has(AGAINST), "against").when(has(FOR), "for").otherwise("neutral")


def kind_of(text: Column) -> Column:
    """The kind of claim of highest score; the first of equals, factual without any."""
    scores = H.claim_scores(text)
    kinds = ("statistical", "causal", "comparative", "historical", "factual")
    best = F.greatest(*(scores[k] for k in kinds))
    out = F.when(best == 0, "factual")
    for k in kinds:
        out = out.when(scores[k] == best, k)
    return out


def clusters(claims: DataFrame) -> DataFrame:
    """``transcript_id, cluster, type, stance, claims_count, primary_claim``: claims of one kind and stance; the surest, earliest one speaks for them."""
    rows = claims.withColumn("type", kind_of(F.col("text"))).withColumn("stance", stance(F.col("text")))
    order = F.struct(-F.col("confidence"), "turn_index", "segment_index", "sentence_index")
    found = rows.groupBy("transcript_id", "type", "stance").agg(F.count("*").alias("claims_count"), F.min_by("text", order).alias("primary_claim"))
    number = F.row_number().over(Window.partitionBy("transcript_id").orderBy(F.desc("claims_count"), "type", "stance")) - 1
    return found.select("transcript_id", number.alias("cluster"), "type", "stance", "claims_count", "primary_claim")
