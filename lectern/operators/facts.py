"""Fact checks, budgets and run statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.operators import claims as C
from lectern.operators import tasks as K

# The states of a check.
STATUSES = ("verified", "unverified", "disputed", "false", "no_data")
FACT_PATH = ("DecomposeTranscript", "ProcessTurn", "FactCheckTurnClaims", "FactCheckClaim")
GRAM = 3
#: Grams of response keys that go to every task; with more, the texts' grams meet them in a join.
KNOWN_GRAMS = 10_000


@dataclass(frozen=True)
class Budgets:
    """Limits per transcript. With ``strict`` they act: tasks beyond them, and what those would find, are cut."""

    max_tasks: int = 1000
    max_depth: int = 12
    max_children: int = 50
    max_llm_calls: int = 100
    fact_check_budget: int = 100
    backtracks: int = 20
    strict: bool = False


def first_responses(checked: DataFrame, responses: DataFrame, known: int = KNOWN_GRAMS) -> DataFrame:
    """The first response whose key a claim's text contains, case aside; no match leaves nulls.

    A containment join by grams: a key is looked up under its first ``GRAM`` characters, or all if it is
    shorter, among the grams of each text, then compared in full. Of a text's grams only those that some
    key has are listed, which is told from a checked number of them, or from a join on grams alone.
    """
    keys = responses.select(F.lower("key").alias("_key"), "key_order", *(F.col(c) for c in ("status", "confidence", "source", "sources", "urls"))).filter("_key is not null")
    keys = keys.withColumn("gram", F.substring("_key", 1, GRAM))
    low = F.lower("text")
    grams = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(low) - n + 1)), lambda i: F.substring(low, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    listed = F.array_distinct(F.concat(F.array(F.lit("")), *(grams(n) for n in range(1, GRAM + 1))))
    held = [r.gram for r in keys.select("gram").distinct().limit(known + 1).collect()]
    own = ["transcript_id", "claim_id"]
    if len(held) <= known:
        some = F.array(*map(F.lit, held)) if held else F.array().cast("array<string>")
        met = checked.select(*own, low.alias("low"), F.explode(F.array_intersect(some, listed)).alias("gram")).join(keys, "gram")
    else:
        met = checked.select(*own, F.explode(listed).alias("gram")).join(keys, "gram").join(checked.select(*own, low.alias("low")), own)
    answer = F.struct("status", "confidence", "source", "sources", "urls")
    return met.filter(F.contains("low", F.col("_key"))).groupBy(*own).agg(F.min_by(answer, F.struct("key_order", "_key")).alias("response"))


def checkable_in_order(claims: DataFrame) -> DataFrame:
    order = Window.partitionBy("transcript_id").orderBy(*C.claim_order())
    return claims.filter("claim_type = 'empirical'").withColumn("nth", F.row_number().over(order))


def fact_checks(claims: DataFrame, responses: DataFrame, budget: int = 100) -> DataFrame:
    """Results for the first ``budget`` empirical claims of every transcript."""
    within = checkable_in_order(claims).filter(F.col("nth") <= budget)
    rows = within.join(first_responses(within, responses), ["transcript_id", "claim_id"], "left")
    r = F.col("response")
    told = F.lower(r["status"])
    status = F.when(told.isin(*STATUSES), told).otherwise("no_data")
    empty = F.array().cast("array<string>")
    return rows.select(
        "transcript_id", F.concat(F.lit("factcheck_"), "claim_id").alias("fact_check_id"), "claim_id", F.col("text").alias("claim_text"), status.alias("status"), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"),
        r["source"].alias("summary"), F.coalesce(r["sources"], empty).alias("sources"), F.coalesce(r["urls"], empty).alias("source_urls"), F.to_json("response").alias("raw_response"), C.path(FACT_PATH).alias("method_path"),
    )


def stats(cut: DataFrame, turns: DataFrame, claims: DataFrame, budgets: Budgets = Budgets(), fact_check_rows: DataFrame | None = None) -> DataFrame:
    """Counts per transcript: tasks, claims, frames, fact checks, calls, failed compounds, success.

    ``cut`` are the tasks of ``tasks.within``; without ``strict`` all tasks count and only success knows the limit.
    """
    ran = K.stats(cut if budgets.strict else cut.withColumn("kept", F.lit(True)))
    llm = [F.sum(F.col("llm_used").cast("int")).alias("llm_calls")] if "llm_used" in claims.columns else []
    counted = [(turns, "frames_count", []), (claims, "claims_count", llm)] + ([] if fact_check_rows is None else [(fact_check_rows, "fact_checks_count", [])])
    rows = ran
    for part, name, more in counted:
        rows = rows.join(part.groupBy("transcript_id").agg(F.count("*").alias(name), *more), "transcript_id", "left")
    zero = lambda c: (F.coalesce(c, F.lit(0)) if c in rows.columns else F.lit(0)).cast("long").alias(c)
    return rows.select("transcript_id", "tasks_executed", zero("claims_count"), zero("frames_count"), zero("fact_checks_count"), zero("llm_calls"), "backtracks", "success")


def verification_score(credibility, evidence, consensus, recency):
    """Weighted verification score and its band."""
    total = F.round(0.4 * credibility + 0.3 * evidence + 0.2 * consensus + 0.1 * recency, 12)
    band = F.when(total >= 0.9, "verified true").when(total >= 0.7, "likely true").when(total >= 0.4, "mixed").when(total >= 0.2, "likely false").otherwise("verified false")
    return F.struct(total.alias("score"), band.alias("band"))


def answers_by(claims: DataFrame, client, answer: str, schema: str) -> DataFrame:
    """Answers of a callable client for the distinct texts of claims, as a table.

    ``client()`` makes, once a task, a function from a text to a tuple for ``schema`` or None; its first
    column is named ``answer`` and holds the text.
    """
    from pyspark.sql.types import StructType

    shape: StructType = claims.sparkSession.createDataFrame([], f"{answer} string, {schema}").schema

    def ask(batches):
        import pandas as pd

        call = client()
        for batch in batches:
            got = [(t, *a) for t in batch["text"] if (a := call(t)) is not None]
            yield pd.DataFrame(got, columns=shape.names)

    return claims.select("text").distinct().mapInPandas(ask, shape)
