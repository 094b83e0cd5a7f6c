"""Fallacies and claim scores by language patterns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Language patterns of each fallacy, in the order of their definition.
FALLACIES = {
    "ad_hominem": (
        r"\b(?:you|he|she|they)\s+(?:are|is)\s+(?:a|an|just|nothing but|always)\s+\w+",
        r"\b(?:typical|classic)\s+\w+\s+(?:response|answer|behavior)",
        r"\bcoming from (?:you|him|her|them|someone who)",
        r"\b(?:hypocrite|liar|fraud|corrupt|dishonest)\b",
        r"\bwhat (?:do you|does he|does she) know about",
    ),
    "straw_man": (
        r"\bso (?:you're|he's|she's|they're) saying\b",
        r"\bwhat (?:you|he|she|they) (?:want|believe|think) is\b",
        r"\b(?:you|he|she|they) (?:want to|would) (?:destroy|eliminate|ban|get rid of)\b",
        r"\baccording to (?:you|him|her|them), (?:we should|everyone should)\b",
    ),
    "false_dilemma": (
        r"\beither\s+.+\s+or\s+.+",
        r"\bonly (?:two|2) (?:choices|options|ways)\b",
        r"\b(?:you're|it's) either\s+.+\s+or\s+.+",
        r"\bthere are only (?:two|2) (?:options|choices|possibilities)\b",
        r"\bif (?:you're not|we don't).+then (?:you're|we're|you must be)\b",
    ),
    "appeal_to_authority": (
        r"\baccording to (?:many|most|all) (?:experts|scientists|doctors)\b",
        r"\b(?:everyone|everybody) (?:knows|agrees|says)\b",
        r"\ba (?:famous|well-known|prominent) \w+ said\b",
        r"\bstudies show\b(?! (?:specific|clear|detailed))",
        r"\bit's (?:common knowledge|widely known|obvious) that\b",
    ),
    "slippery_slope": (
        r"\bif we (?:allow|permit|do) this.+(?:then|next).+(?:will|would)\b",
        r"\bthis (?:will|would) lead to\b",
        r"\b(?:before you know it|next thing you know|soon)\b",
        r"\bonce we start.+(?:where does it end|there's no stopping)\b",
        r"\bthis is (?:just the beginning|the first step) (?:of|to|toward)\b",
    ),
    "red_herring": (
        r"\bbut what about\b",
        r"\bspeaking of\b(?! (?:which|this|that))",
        r"\bthat reminds me\b",
        r"\bwhile we're (?:on the topic|talking about)\b",
        r"\bthat's not the real (?:issue|problem|question)\b",
    ),
    "appeal_to_emotion": (
        r"\bthink (?:of|about) the (?:children|families|victims)\b",
        r"\b(?:imagine|picture) if (?:this|that) were your\b",
        r"\bwe (?:can't|cannot) allow (?:this|that) to (?:happen|continue)\b",
        r"\bthe (?:future|safety|security) of (?:our|America|democracy) (?:depends|hangs)\b",
        r"\b(?:dangerous|scary|terrifying|devastating) (?:consequences|results|effects)\b",
    ),
}
# Words of the claim scores.
STATISTICAL = ("data", "statistics", "survey", "poll", "study", "research", "analysis", "report", "findings", "rate")
CAUSAL, STRONG_CAUSAL = ("because", "due to", "caused by", "leads to", "results in"), ("directly caused", "primary cause", "root cause")
COMPARATIVE = (r"\b(?:more|less) than\b", r"\b(?:better|worse) than\b", r"\bcompared to\b", r"\b(?:superior|inferior) to\b", r"\b(?:exceeds|surpasses)\b")
TIMES, PAST = (r"\bin \d{4}\b", r"\bduring the \d{4}s\b", r"\bdecades ago\b"), ("happened", "occurred", "established", "founded")
UNCERTAIN = ("might", "may", "could", "would", "should", "possibly", "probably", "believes", "thinks")
CERTAIN = ("is", "are", "was", "were", "has", "have", "will", "facts", "evidence", "proof", "confirmed")
#: Below this a score means no claim of that kind.
LEAST = 0.3


def literals(pattern: str) -> tuple[str, ...]:
    """Lower-case strings one of which every match of a pattern holds; none if the pattern doesn't tell."""
    ahead = re.sub(r"\(\?![^()]*(?:\([^()]*\)[^()]*)*\)", "\0", pattern)  # what must not follow says nothing
    groups = re.findall(r"\(\?:([^()]*)\)(?![?*])", ahead)
    bare = re.sub(r"\([^()]*\)[?*+]?", "\0", ahead)
    runs = [x for x in re.split(r"\\[a-zA-Z]\+?|\.[+*]?|[\0?*+|\[\]{}]", bare) if len(x.strip()) >= 4]
    if runs:
        return (max(runs, key=len).lower(),)
    plain = [tuple(g.lower().split("|")) for g in groups if re.fullmatch(r"[\w' -]+(?:\|[\w' -]+)*", g)]
    return max((g for g in plain if min(map(len, g)) >= 4), key=lambda g: min(map(len, g)), default=())


def fallacies(texts: DataFrame, keys: tuple[str, ...] = ("transcript_id", "turn_index", "speaker")) -> DataFrame:
    """One row per fallacy found in a row's text: patterns matched, confidence and severity.

    One pattern scores 0.6, each further one 0.2 more, at most 1; severity follows the bands 0.8 and 0.5.
    A pattern runs only where the lower-cased text holds one of its literals.
    """
    texts = texts.withColumn("_low", F.lower("text"))

    def hit(p: str) -> Column:
        told = F.regexp_like(F.col("text"), F.lit(f"(?iU){p}")).cast("int")
        held = [F.contains("_low", F.lit(x)) for x in literals(p)]
        return F.when(F.col("text").isNotNull(), F.when(reduce(Column.__or__, held), told).otherwise(0)) if held else told

    hits = lambda ps: reduce(Column.__add__, map(hit, ps))
    each = F.array(*(F.struct(F.lit(kind).alias("fallacy_type"), hits(ps).alias("patterns_matched")) for kind, ps in FALLACIES.items()))
    rows = texts.select(*keys, "text", F.inline(F.filter(each, lambda x: x["patterns_matched"] > 0)))
    confidence = F.least(F.lit(1.0), F.round(0.4 + 0.2 * F.col("patterns_matched"), 6))
    return rows.withColumn("confidence", confidence).withColumn("severity", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))


def fallacy_summary(found: DataFrame) -> DataFrame:
    """Counts and mean confidence per transcript, by type and by speaker."""
    per = lambda c: found.groupBy("transcript_id", c).agg(F.count("*").alias("n")).groupBy("transcript_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    total = found.groupBy("transcript_id").agg(F.count("*").alias("total_fallacies"), F.round(F.avg("confidence"), 6).alias("average_confidence"))
    return total.join(per("fallacy_type"), "transcript_id").join(per("speaker"), "transcript_id").withColumnsRenamed({"by_fallacy_type": "by_type"})


def claim_scores(text: Column) -> Column:
    """Scores of five kinds of claim; a kind without evidence scores 0."""
    low = F.lower(text)
    words = lambda ws: reduce(Column.__add__, (F.regexp_like(low, F.lit(rf"(?U)\b{w}\b")).cast("int") for w in ws))
    matches = lambda ps: reduce(Column.__add__, (F.regexp_like(low, F.lit(f"(?U){p}")).cast("int") for p in ps))
    capped = lambda c: F.round(F.least(F.lit(1.0), c), 6)
    number = F.regexp_like(low, F.lit(r"(?U)\d+(?:\.\d+)?\s*(?:%|percent|million|billion|thousand)"))
    causal, strong, compared, times, past = words(CAUSAL), words(STRONG_CAUSAL), matches(COMPARATIVE), matches(TIMES), words(PAST)
    factual = 0.4 - 0.1 * words(UNCERTAIN) + 0.05 * words(CERTAIN)
    return F.struct(
        F.when(number, F.when(words(STATISTICAL) > 0, 0.8).otherwise(0.6)).otherwise(0.0).alias("statistical"),
        F.when(causal + strong > 0, capped(0.5 + 0.1 * causal + 0.2 * strong)).otherwise(0.0).alias("causal"),
        F.when(compared > 0, capped(0.5 + 0.15 * compared)).otherwise(0.0).alias("comparative"),
        F.when((times > 0) | (past >= 2), capped(0.4 + 0.2 * times + 0.1 * past)).otherwise(0.0).alias("historical"),
        F.when(factual >= LEAST, capped(factual)).otherwise(0.0).alias("factual"),
    )


def rating(score: Column) -> Column:
    """Fixed bands of a debate score."""
    return F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.55, "average").when(score >= 0.4, "poor").otherwise("very poor")
