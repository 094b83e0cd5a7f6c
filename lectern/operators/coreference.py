"""Entities and references.

Salience is a short running list. A speaker comes to its head when a turn begins; a turn's claims come
before everything else, later ones first, while the turn lasts, and go to the list's head in their order
once it is over. Only the ``SALIENT`` most recent entities have a rank that counts, and people are
candidates however long ago they spoke, so no more than these are kept while a transcript's rows stream
by in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators.claims import path

# Reference words, scores and, below, the reasons that go with them.
PRONOUNS = ("he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs", "it", "its")
DEMONSTRATIVES = ("this", "that", "these", "those")
COMMITTED, TENTATIVE, SALIENT, RANKED, LISTED = 0.85, 0.5, 10, 5, 5
RESOLUTION_PATH = ("DecomposeTranscript", "ProcessTurn", "DetectReferences", "ResolveReference")


def references(turns: DataFrame) -> DataFrame:
    """Pronouns and demonstratives of every turn with their spans."""
    words = "|".join((*PRONOUNS, *DEMONSTRATIVES))
    pieces = T.with_starts(F.split("text", rf"(?i)(?U)(?=\b(?:{words})\b)"))
    each = turns.filter(F.length("text") > 0).select("transcript_id", "turn_index", "speaker", "span", F.explode(pieces).alias("p"))
    each = each.withColumn("surface", F.regexp_extract("p.piece", rf"(?i)(?U)^({words})\b", 1)).withColumn("start", (F.col("span.start") + F.col("p.start")).cast("int")).filter("surface <> ''")
    end = (F.col("start") + F.length("surface")).alias("end")
    kind = F.when(F.lower("surface").isin(*PRONOUNS), "PRONOUN").otherwise("DEMONSTRATIVE")
    ref_id = F.concat_ws("_", F.lit("ref"), F.col("start"), F.col("start") + F.length("surface"))
    return each.select("transcript_id", "turn_index", "speaker", ref_id.alias("ref_id"), F.col("surface").alias("surface_form"), kind.alias("ref_type"), F.struct("start", end).alias("span"))


def mentions(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """Registrations in order: known speakers once a turn, claims one by one."""
    people = turns.filter(F.col("speaker").isNotNull() & (F.col("speaker") != T.UNKNOWN))
    people = people.select("transcript_id", "turn_index", F.lit(0).alias("kind"), F.lit(0).alias("position"), F.col("speaker").alias("canonical"), F.lit("PERSON").alias("entity_type"), "span", "speaker", F.array(F.lower("speaker"), F.upper("speaker")).alias("names"))
    nth = F.row_number().over(Window.partitionBy("transcript_id", "turn_index").orderBy("segment_index", "sentence_index"))
    said = claims.select("transcript_id", "turn_index", F.lit(1).alias("kind"), nth.alias("position"), T.shortened(F.col("text")).alias("canonical"), F.lit("CLAIM").alias("entity_type"), "span", "speaker", F.array().cast("array<string>").alias("names"))
    return people.unionByName(said).withColumn("entity_id", T.entity_key(F.col("canonical")))


def entities(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per entity: first mention's name, type and span, all spans, all names."""
    order = F.struct("turn_index", "kind", "position")
    first = F.min_by(F.struct("canonical", "entity_type", "span", "speaker", order.alias("order")), order).alias("f")
    spans = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), "span"))), lambda x: x["span"])
    rows = mentions(turns, claims).groupBy("transcript_id", "entity_id").agg(first, spans.alias("mention_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("aliases"))
    # A known speaker's later turns only boost; they add no mention.
    spans = F.when(F.col("f.entity_type") == "PERSON", F.slice("mention_spans", 1, 1)).otherwise(F.col("mention_spans"))
    return rows.select("transcript_id", "entity_id", "f.canonical", "f.entity_type", F.col("f.span").alias("first_mention_span"), F.col("f.speaker").alias("introducing_speaker"), F.col("f.order.turn_index").alias("first_turn"), F.col("f.order").alias("registered"), spans.alias("mention_spans"), "aliases")


def _ranked(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of boosts and places in order of transcript, turn and position: the entities known at each place."""
    at, turn, recent, people, now, silent, out = None, None, [], {}, {}, False, []

    def turn_over():
        own = sorted(now, key=now.get, reverse=silent and turn == 0)
        recent[:] = [*own, *(e for e in recent if e not in now)][:SALIENT]
        now.clear()

    for batch in batches:
        for key, place, kind, entity, position, quiet, asked in zip(*(c.to_pylist() for c in batch.columns)):
            if key != at:
                at, turn, recent, people, now, silent = key, place, [], {}, {}, quiet
            elif place != turn:
                turn_over()
                turn = place
            if asked:
                order = [*sorted(now, key=now.get, reverse=True), *(e for e in recent if e not in now)][:SALIENT]
                out += [(at, place, e, r) for r, e in enumerate(order)]
                out += [(at, place, e, SALIENT) for e in people if e not in order]
            elif kind == 0:
                recent[:] = [entity, *(e for e in recent if e != entity)][:SALIENT]
                people[entity] = True
            else:
                now[entity] = position
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []


def salience(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """(transcript_id, turn_index, entity_id, rank): entities known when a turn's references are read.

    Ranks from ``SALIENT`` on aren't told apart: people who come later have that rank, claims aren't listed.
    """
    # A claim that a turn repeats counts where it came last.
    boosts = mentions(turns, claims).groupBy("transcript_id", "turn_index", "kind", "entity_id").agg(F.max("position").cast("int").alias("position"))
    silent = turns.groupBy("transcript_id").agg(F.min_by((F.coalesce("speaker", F.lit(T.UNKNOWN)) == T.UNKNOWN), "turn_index").alias("silent"))
    # Only turns that hold a reference need an order; they are asked for after their own boosts.
    places = references(turns).select("transcript_id", "turn_index").distinct()
    asked = places.select("transcript_id", "turn_index", F.lit(2).alias("kind"), F.lit("").alias("entity_id"), F.lit(0).alias("position"))
    order = ["transcript_id", "turn_index", "kind", "position", "entity_id"]
    rows = boosts.select(*asked.columns).unionByName(asked).join(silent, "transcript_id").withColumn("asked", F.col("kind") == 2)
    rows = rows.select("transcript_id", "turn_index", "kind", "entity_id", "position", "silent", "asked").repartition("transcript_id").sortWithinPartitions(*order)
    kinds = dict(turns.dtypes)
    shape = turns.sparkSession.createDataFrame([], f"transcript_id {kinds['transcript_id']}, turn_index {kinds['turn_index']}, entity_id string, rank int").schema
    schema = to_arrow_schema(shape)
    return rows.mapInArrow(lambda batches: _ranked(batches, schema), shape)


def scored(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """Every reference with every candidate that may be meant, and its score."""
    known = entities(turns, claims)
    ranks = salience(turns, claims).join(known.select("transcript_id", "entity_id", "canonical", "entity_type", "first_mention_span", "registered"), ["transcript_id", "entity_id"])
    length = turns.groupBy("transcript_id").agg(F.greatest(F.lit(1), F.max_by(F.col("span.end"), "turn_index")).alias("length"))
    ranks = ranks.join(length, "transcript_id")
    listed = Window.partitionBy("transcript_id", "turn_index").orderBy(F.col("rank") >= SALIENT, F.when(F.col("rank") < SALIENT, F.col("rank")), "registered")
    ranks = ranks.withColumn("place", F.row_number().over(listed)).filter((F.col("rank") < SALIENT) | (F.col("entity_type") == "PERSON"))
    rows = references(turns).join(ranks, ["transcript_id", "turn_index"]).filter((F.col("rank") < SALIENT) | (F.col("ref_type") == "PRONOUN"))
    inside = (F.col("first_mention_span.start") <= F.col("span.start")) & (F.col("span.end") <= F.col("first_mention_span.end"))
    person, pronoun = F.col("entity_type") == "PERSON", F.col("ref_type") == "PRONOUN"
    other = F.col("canonical") != F.col("speaker")
    claimed = (F.col("ref_type") == "DEMONSTRATIVE") & F.col("entity_type").isin("CLAIM", "CONCEPT")
    recency = F.col("first_mention_span.start") / F.col("length")
    total = F.when(F.col("rank") < RANKED, 0.3 * (1 - F.col("rank") / RANKED)).otherwise(0.0)
    total = total + F.when(pronoun & person & other, 0.6).when(pronoun & person, -0.2).otherwise(0.0) + F.when(claimed, 0.4).otherwise(0.0) + 0.2 * recency + 0.1
    reasons = F.array_compact(F.array(
        F.when(F.col("rank") < RANKED, F.format_string("salient (rank %d)", F.col("rank") + 1)),
        F.when(pronoun & person & other, F.lit("other speaker (pronoun target)")).when(pronoun & person, F.lit("same speaker (unlikely)")),
        F.when(claimed, F.lit("claim/concept (demonstrative target)")), F.format_string("recency (%.2f)", recency), F.lit("candidate"),
    ))
    rows = rows.filter(~inside).withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).withColumn("reasons", reasons)
    return rows.select("transcript_id", "turn_index", "ref_id", "surface_form", "ref_type", "span", "speaker", "entity_id", "canonical", "entity_type", "rank", "place", "score", "reasons")


def resolutions(turns: DataFrame, claims: DataFrame) -> DataFrame:
    """One row per reference: status, winner, confidence, best candidates. Repeated scores keep candidate order."""
    rows = scored(turns, claims)
    best = F.sort_array(F.collect_list(F.struct((-F.round("score", 12)).alias("o"), "place", "entity_id", "score", "reasons", "canonical")))
    top = rows.groupBy("transcript_id", "turn_index", "ref_id").agg(F.slice(best, 1, LISTED).alias("best"))
    first = mentions(turns, claims).groupBy("transcript_id").agg(F.min("turn_index").alias("first"))
    all_refs = references(turns).join(top, ["transcript_id", "turn_index", "ref_id"], "left").join(first, "transcript_id", "left").withColumn("anyone", F.col("first") <= F.col("turn_index"))
    win = F.get("best", F.lit(0))
    score = F.coalesce(win["score"], F.lit(0.0))
    status = F.when(win.isNull(), "UNRESOLVED").when(score >= COMMITTED - 1e-12, "COMMITTED").when(score >= TENTATIVE - 1e-12, "TENTATIVE").otherwise("AMBIGUOUS")
    reason = F.when(win.isNotNull(), F.array_join(win["reasons"], "; ")).when(F.col("anyone"), "All candidates filtered (self-reference)").otherwise("No candidates found in scope")
    listed = F.coalesce(F.transform("best", lambda x: F.struct(x["entity_id"].alias("entity_id"), x["score"].alias("score"), x["reasons"].alias("reasons"))), F.array().cast("array<struct<entity_id:string,score:double,reasons:array<string>>>"))
    features = F.when(win.isNotNull(), F.create_map(F.lit("top_score"), score)).otherwise(F.create_map().cast("map<string,double>"))
    commit = (status == "TENTATIVE") & (score >= COMMITTED)
    return all_refs.select(
        "transcript_id", "turn_index", "ref_id", F.col("surface_form").alias("source_text"), "ref_type", "span", status.alias("status"), win["entity_id"].alias("winner"), win["canonical"].alias("winner_name"),
        score.alias("confidence"), listed.alias("candidates"), features.alias("scoring_features"), reason.alias("reason"), commit.alias("should_commit"), path(RESOLUTION_PATH).alias("method_path"),
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.filter("status = 'UNRESOLVED'")
