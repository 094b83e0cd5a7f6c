"""Registered queries of the transcript engine and their SQL twins.

``conversations`` give turns, ``documents`` raw transcripts; what neither table holds (labels, markers,
responses) comes from small inline tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import claims as C
from lectern.operators import coreference as R
from lectern.operators import documents as D
from lectern.operators import facts as K
from lectern.operators import rhetoric as H
from lectern.operators import tasks as Q
from lectern.sources import transcripts as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("transcript_id"), "text")


def inline(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names})"


# SQL twins share a chain of common tables.
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_Q = lambda s: s.replace("'", "''")
_ANY = lambda ps: _Q("|".join(f"(?:{p})" for p in ps))
_MARK = "|".join(C.SEGMENT_MARKERS)
_REF = "|".join((*R.PRONOUNS, *R.DEMONSTRATIVES))
_CANON = lambda c: f"regexp_replace(regexp_replace({_STRIP(f'lower({c})')}, '\\s+', ' ', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g')"
_CASES = " ".join(f"WHEN regexp_matches(lo, '{'|'.join(keys)}') THEN {{'t': '{kind}', 'c': {conf}, 'r': '{reason}'}}" for kind, conf, reason, keys in C.RULES)
_CLASS = f"""CASE WHEN regexp_matches(lo, '{_Q(C.NUMERIC)}') THEN {{'t': 'empirical', 'c': 0.85, 'r': 'contains numeric/statistical data'}} {_CASES}
  WHEN regexp_matches(lo, '{C.FIRST_PERSON}') THEN {{'t': 'introspective', 'c': 0.9, 'r': 'first-person mental state'}}
  WHEN regexp_matches(lo, '{'|'.join(C.FUTURE)}') THEN {{'t': 'predictive', 'c': 0.7, 'r': 'contains predictive language'}}
  ELSE {{'t': 'unclassified', 'c': 0.3, 'r': 'no strong pattern match'}} END"""


def chain(source: str = "conversations") -> str:
    """WITH list up to claims; ``source`` is a table or a bracketed query of conv_id, turn, role, text."""
    return f"""
WITH t0 AS (
  SELECT conv_id AS transcript_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_index, upper({_STRIP('role')}) AS speaker, {_STRIP("coalesce(text, '')")} AS text FROM {source}
), turns AS (
  SELECT *, s0::INT AS s, (s0 + length(text))::INT AS e FROM (
    SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY transcript_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM t0)
), seg0 AS (
  SELECT * EXCLUDE (text), unnest(ps) AS piece, generate_subscripts(ps, 1) AS i, len(ps) AS n FROM (
    SELECT *, string_split(regexp_replace(text, '(?i)(\\b(?:{_MARK})\\b)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM turns)
), seg1 AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY transcript_id, turn_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM seg0
), segments AS (
  SELECT transcript_id, turn_index, speaker, i AS segment_index, {_STRIP('piece')} AS text, (s + before)::INT AS s, (s + before + length(piece))::INT AS e FROM seg1 WHERE {_STRIP('piece')} <> '' OR n = 1
), sen0 AS (
  SELECT * EXCLUDE (text, e), unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
    SELECT *, string_split(regexp_replace(text, '([.!?])(\\s+[A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ps FROM segments WHERE length(text) > {C.MIN_SEGMENT})
), sen1 AS (
  SELECT *, {_STRIP('piece')} AS text, coalesce(sum(length(piece)) OVER (PARTITION BY transcript_id, turn_index, segment_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS before FROM sen0
), sentences AS (
  SELECT transcript_id, turn_index, speaker, segment_index, i AS sentence_index, text, (s + before)::INT AS s, (s + before + length(text))::INT AS e, lower(text) AS lo FROM sen1 WHERE text <> ''
), candidates AS (
  SELECT * FROM sentences WHERE regexp_matches(lo, '{_ANY(C.INDICATORS)}')
    OR (len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) >= 5 AND regexp_matches(lo, ' (?:{'|'.join(C.VERBS)}) '))
), claims AS (
  SELECT *, 'claim_' || substr(sha256(sha256({_CANON('text')}) || ':' || s || ':' || e), 1, 24) AS claim_id, {_CLASS} AS k FROM candidates WHERE length(text) > {C.MIN_CLAIM}
), refs0 AS (
  SELECT * EXCLUDE (text), unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM (
    SELECT *, string_split(regexp_replace(text, '(?i)(\\b(?:{_REF})\\b)', chr(1) || '\\1', 'g'), chr(1)) AS ps FROM turns)
), refs1 AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY transcript_id, turn_index ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM refs0
), refs AS (
  SELECT transcript_id, turn_index, speaker, regexp_extract(piece, '(?i)^({_REF})\\b', 1) AS surface_form, (s + before)::INT AS rs, (s + before + length(regexp_extract(piece, '(?i)^({_REF})\\b', 1)))::INT AS re,
    CASE WHEN lower(regexp_extract(piece, '(?i)^({_REF})\\b', 1)) IN ({', '.join(f"'{w}'" for w in R.PRONOUNS)}) THEN 'PRONOUN' ELSE 'DEMONSTRATIVE' END AS ref_type
  FROM refs1 WHERE i > 1 AND regexp_extract(piece, '(?i)^({_REF})\\b', 1) <> ''
), relations AS (
  SELECT *, CASE WHEN turn_index = 0 THEN NULL WHEN regexp_matches(lower(text), '{_ANY(C.REBUTTALS)}') THEN 'REBUTTAL' WHEN regexp_matches(lower(text), '{_ANY(C.SUPPORTS)}') THEN 'SUPPORT' END AS relation FROM turns
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY transcript_id, turn_index ORDER BY segment_index, sentence_index) AS position FROM claims
), mentions AS (
  SELECT transcript_id, turn_index, 0 AS kind, 0 AS position, speaker AS canonical, 'PERSON' AS entity_type, s, e FROM turns WHERE speaker <> 'UNKNOWN'
  UNION ALL SELECT transcript_id, turn_index, 1, position, CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END, 'CLAIM', s, e FROM nth
), keyed AS (
  SELECT *, substr(sha256({_CANON('canonical')}), 1, 24) AS entity_id, turn_index * 1000000 + kind * 100000 + position AS o FROM mentions
), entities AS (
  SELECT transcript_id, entity_id, arg_min(canonical, o) AS canonical, arg_min(entity_type, o) AS entity_type, arg_min(s, o) AS fs, arg_min(e, o) AS fe, arg_min(turn_index, o) AS first_turn, min(o) AS registered FROM keyed GROUP BY ALL
), boosts AS (
  SELECT transcript_id, turn_index AS boosted, kind, entity_id, max(position) AS position FROM keyed GROUP BY ALL
), silent AS (
  SELECT transcript_id, speaker = 'UNKNOWN' AS silent FROM turns WHERE turn_index = 0
), places AS (
  SELECT DISTINCT transcript_id, turn_index FROM refs
), last_boost AS (
  SELECT p.transcript_id, p.turn_index, b.entity_id, max(CASE WHEN b.boosted = p.turn_index AND kind = 1 THEN 1000000000000 + position
    ELSE boosted * 1000000 + kind * 400000 + CASE WHEN kind = 0 OR (silent AND boosted = 0) THEN position ELSE -position END END) AS key
  FROM places p JOIN boosts b ON p.transcript_id = b.transcript_id AND b.boosted <= p.turn_index JOIN silent z ON z.transcript_id = p.transcript_id GROUP BY ALL
), salience AS (
  SELECT *, row_number() OVER (PARTITION BY transcript_id, turn_index ORDER BY key DESC) - 1 AS rank FROM last_boost
), ranked AS (
  SELECT s.*, n.canonical, n.entity_type, n.fs, n.fe, n.registered FROM salience s JOIN entities n USING (transcript_id, entity_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY transcript_id, turn_index ORDER BY rank >= {R.SALIENT}, CASE WHEN rank < {R.SALIENT} THEN rank END, registered) AS place FROM ranked
), ends AS (
  SELECT transcript_id, greatest(1, arg_max(e, turn_index)) AS length FROM turns GROUP BY ALL
), scored AS (
  SELECT r.*, p.entity_id, p.canonical, p.place, least(1.0, greatest(0.0,
      CASE WHEN rank < {R.RANKED} THEN 0.3::DOUBLE * (1 - rank::DOUBLE / {R.RANKED}) ELSE 0 END
      + CASE WHEN ref_type = 'PRONOUN' AND entity_type = 'PERSON' THEN CASE WHEN canonical <> speaker THEN 0.6::DOUBLE ELSE -0.2::DOUBLE END ELSE 0 END
      + CASE WHEN ref_type = 'DEMONSTRATIVE' AND entity_type = 'CLAIM' THEN 0.4::DOUBLE ELSE 0 END + 0.2::DOUBLE * (fs::DOUBLE / length) + 0.1::DOUBLE)) AS score
  FROM refs r JOIN placed p USING (transcript_id, turn_index) JOIN ends USING (transcript_id)
  WHERE (rank < {R.SALIENT} OR (entity_type = 'PERSON' AND ref_type = 'PRONOUN')) AND NOT (fs <= rs AND re <= fe)
), winners AS (
  SELECT transcript_id, turn_index, rs, arg_min(canonical, (-round(score, 12), place)) AS winner_name, max(score) AS score FROM scored GROUP BY ALL
), resolutions AS (
  SELECT r.transcript_id, r.turn_index, r.surface_form, r.ref_type, r.rs, w.winner_name, coalesce(w.score, 0) AS confidence,
    CASE WHEN w.score IS NULL THEN 'UNRESOLVED' WHEN w.score >= 0.85 - 1e-12 THEN 'COMMITTED' WHEN w.score >= 0.5 - 1e-12 THEN 'TENTATIVE' ELSE 'AMBIGUOUS' END AS status
  FROM refs r LEFT JOIN winners w ON w.transcript_id = r.transcript_id AND w.turn_index = r.turn_index AND w.rs = r.rs
)
"""


CHAIN = chain()


@query(CHAIN + "SELECT transcript_id, turn_index, speaker, text, s AS start, e AS \"end\" FROM turns")
def turn_spans(spark, sf_dir):
    return conversation_turns(spark, sf_dir).select("transcript_id", F.col("turn_index").cast("long"), "speaker", "text", "span.start", "span.end")


@query(CHAIN + "SELECT transcript_id, turn_index, text, s AS start, e AS \"end\" FROM segments")
def segments(spark, sf_dir):
    return C.segments(conversation_turns(spark, sf_dir)).select("transcript_id", F.col("turn_index").cast("long"), "text", "span.start", "span.end")


@query(CHAIN + "SELECT transcript_id, turn_index, text, s AS start, e AS \"end\" FROM sentences")
def sentences(spark, sf_dir):
    return C.sentences(C.segments(conversation_turns(spark, sf_dir))).select("transcript_id", F.col("turn_index").cast("long"), "text", "span.start", "span.end")


@query(CHAIN + "SELECT transcript_id, count(*) AS n FROM candidates GROUP BY ALL")
def claim_candidates(spark, sf_dir):
    return C.candidates(C.sentences(C.segments(conversation_turns(spark, sf_dir)))).groupBy("transcript_id").agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT transcript_id, claim_id, text, speaker, k.t AS claim_type, k.c::DOUBLE AS confidence, k.r AS reason, s AS start, e AS \"end\" FROM claims")
def claims(spark, sf_dir):
    rows = C.claims(conversation_turns(spark, sf_dir))
    return rows.select("transcript_id", "claim_id", "text", "speaker", "claim_type", "confidence", F.col("confidence_reasons")[0].alias("reason"), "span.start", "span.end")


@query(CHAIN + "SELECT speaker, k.t AS claim_type, count(*) AS n_claims, round(avg(k.c::DOUBLE), 6) AS avg_confidence FROM claims GROUP BY ALL")
def claims_by_speaker(spark, sf_dir):
    rows = C.claims(conversation_turns(spark, sf_dir))
    return rows.groupBy("speaker", "claim_type").agg(F.count("*").alias("n_claims"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


@query(CHAIN + "SELECT transcript_id, claim_id FROM claims WHERE k.c > 0.6")
def confident_claims(spark, sf_dir):
    return C.claims(conversation_turns(spark, sf_dir)).filter("confidence > 0.6").select("transcript_id", "claim_id")


@query(CHAIN + "SELECT count(*) AS n, count(*) FILTER (WHERE k.t IN ('empirical', 'methodological', 'predictive')) AS checkable, count(*) FILTER (WHERE k.t = 'unclassified' OR k.c < 0.6) AS flagged FROM claims")
def claim_flags(spark, sf_dir):
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias
    return C.claims(conversation_turns(spark, sf_dir)).agg(F.count("*").alias("n"), n("checkable")("checkable"), n("review_flag")("flagged"))


@query(CHAIN + """, listed AS (SELECT transcript_id, turn_index, string_agg(claim_id, ',' ORDER BY segment_index, sentence_index) AS ids FROM claims GROUP BY ALL)
SELECT r.transcript_id, 'frame_' || r.turn_index AS frame_id, coalesce(relation, 'CLAIM') AS frame_type, speaker, speaker || '''s argument' AS summary, CASE WHEN relation IS NOT NULL THEN 'frame_' || (r.turn_index - 1) END AS parent_frame_id,
  coalesce(ids, '') AS child_claims, CASE WHEN relation = 'REBUTTAL' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM relations r LEFT JOIN listed USING (transcript_id, turn_index)""")
def frames(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    rows = C.frames(turns, C.claims(turns))
    return rows.select("transcript_id", "frame_id", "frame_type", "speaker", "summary", "parent_frame_id", F.array_join("child_claim_ids", ",").alias("child_claims"), "confidence")


@query(CHAIN + "SELECT coalesce(relation, 'CLAIM') AS frame_type, count(*) AS n FROM relations GROUP BY ALL")
def dialectic_counts(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return turns.select(F.coalesce(F.when(F.col("turn_index") > 0, C.relation(F.col("text"))), F.lit("CLAIM")).alias("frame_type")).groupBy("frame_type").agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT transcript_id, turn_index, surface_form, ref_type, rs AS start, re AS \"end\" FROM refs")
def references(spark, sf_dir):
    return R.references(conversation_turns(spark, sf_dir)).select("transcript_id", F.col("turn_index").cast("long"), "surface_form", "ref_type", "span.start", "span.end")


@query(CHAIN + "SELECT transcript_id, entity_id, canonical, entity_type, first_turn, fs AS start, fe AS \"end\" FROM entities")
def entities(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    rows = R.entities(turns, C.claims(turns))
    return rows.select("transcript_id", "entity_id", "canonical", "entity_type", F.col("first_turn").cast("long"), "first_mention_span.start", "first_mention_span.end")


@query(CHAIN + "SELECT transcript_id, turn_index, entity_id, rank FROM salience WHERE rank < 5")
def salience_top5(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return R.salience(turns, C.claims(turns)).filter("rank < 5").select("transcript_id", F.col("turn_index").cast("long"), "entity_id", F.col("rank").cast("long"))


@query(CHAIN + "SELECT transcript_id, turn_index, surface_form AS source_text, ref_type, rs AS start, status, winner_name, round(confidence, 6) AS confidence FROM resolutions")
def resolutions(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    rows = R.resolutions(turns, C.claims(turns))
    return rows.select("transcript_id", F.col("turn_index").cast("long"), "source_text", "ref_type", "span.start", "status", "winner_name", F.round("confidence", 6).alias("confidence"))


@query(CHAIN + "SELECT status, ref_type, count(*) AS n FROM resolutions GROUP BY ALL")
def resolution_status(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return R.resolutions(turns, C.claims(turns)).groupBy("status", "ref_type").agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT transcript_id, turn_index, rs AS start FROM resolutions WHERE status = 'UNRESOLVED'")
def unresolved_references(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return R.unresolved(R.resolutions(turns, C.claims(turns))).select("transcript_id", F.col("turn_index").cast("long"), "span.start")


@query(CHAIN + f""", per AS (SELECT transcript_id, 1 + sum(6 + (speaker <> 'UNKNOWN')::INT + (turn_index > 0)::INT + (text <> '')::INT) AS n, count(*) AS f FROM turns GROUP BY ALL),
long AS (SELECT transcript_id, count(*) AS n FROM segments WHERE length(text) > {C.MIN_SEGMENT} GROUP BY ALL), said AS (SELECT transcript_id, count(*) AS n FROM claims GROUP BY ALL), rs AS (SELECT transcript_id, count(*) AS n FROM refs GROUP BY ALL)
SELECT transcript_id, (per.n + coalesce(long.n, 0) + coalesce(said.n, 0) + coalesce(rs.n, 0))::BIGINT AS tasks_executed, coalesce(said.n, 0)::BIGINT AS claims_count, f::BIGINT AS frames_count
FROM per LEFT JOIN long USING (transcript_id) LEFT JOIN said USING (transcript_id) LEFT JOIN rs USING (transcript_id)""")
def task_stats(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return K.stats(Q.within(Q.tasks(turns), 2**30, 2**30, 2**30), turns, C.claims(turns)).select("transcript_id", "tasks_executed", "claims_count", "frames_count")


# Inline debate with labels, markers and figures.
DEBATE = [
    (1, 0, "HARRIS", "Free will is an illusion. My studies prove this conclusively."),
    (1, 1, "PETERSON", "His methodology is fundamentally flawed."),
    (2, 0, "HARRIS", "Brain activity precedes conscious decision by 300 milliseconds. This proves free will is illusory."),
    (2, 1, "PETERSON", "But that ignores the subjective experience of choice."),
    (3, 0, "MODERATOR", "Research shows 70% of people agree. Free will is real, however the data suggests that 25% of studies are wrong."),
    (3, 1, "GUEST", "I think that's not true because evidence for it is missing. They will probably change. 15%."),
    (4, 0, "CANDIDATE A", "Everyone knows taxes are bad. So you're saying we should ban cars? Either we act or we lose."),
    (4, 1, "CANDIDATE B", "You are just a liar. Unemployment rate fell to 4 percent in 2019 because of trade, more than before."),
]
RESPONSES = [("70%", 1, "verified", 0.9, "Survey office"), ("25% of", 2, "DISPUTED", 0.4, "Journal"), ("4 percent", 3, "odd", 0.5, None), ("people", 4, "false", 0.1, "Other")]
ANSWERS = [("Research shows 70% of people agree.", "NORMATIVE", 0.66, "sounds normative"), ("You are just a liar.", "nonsense", 0.9, None), ("His methodology is fundamentally flawed.", "EMPIRICAL", None, None)]
DEBATE_CHAIN = chain(f"(SELECT * FROM {sql_values(DEBATE, 'conv_id, turn, role, text')})")


def debate_turns(spark: SparkSession) -> DataFrame:
    rows = inline(spark, DEBATE, "transcript_id long, turn_index int, speaker string, text string")
    return S.with_spans(rows)


def _checked(spark: SparkSession, turns: DataFrame) -> DataFrame:
    rows = inline(spark, RESPONSES, "key string, key_order int, status string, confidence double, source string")
    none = F.array().cast("array<string>")
    checked = K.fact_checks(C.claims(turns), rows.withColumn("sources", none).withColumn("urls", none), budget=3)
    return checked.select("transcript_id", "claim_id", "status", "confidence", "summary")


def _answered(spark: SparkSession, turns: DataFrame) -> DataFrame:
    answers = inline(spark, ANSWERS, "text string, claim_type string, confidence double, reasoning string")
    return C.with_answers(C.claims(turns), answers).select("transcript_id", "claim_id", "claim_type", "confidence")


@query(DEBATE_CHAIN + "SELECT transcript_id, turn_index, text, s AS start, e AS \"end\", k.t AS claim_type, k.c::DOUBLE AS confidence FROM claims")
def debate_claims(spark, sf_dir):
    return C.claims(debate_turns(spark)).select("transcript_id", F.col("turn_index").cast("long"), "text", "span.start", "span.end", "claim_type", "confidence")


@query(DEBATE_CHAIN + "SELECT transcript_id, turn_index, coalesce(relation, 'CLAIM') AS frame_type FROM relations")
def debate_frames(spark, sf_dir):
    turns = debate_turns(spark)
    return C.frames(turns, C.claims(turns)).select("transcript_id", F.col("turn_index").cast("long"), "frame_type")


@query(DEBATE_CHAIN + "SELECT transcript_id, turn_index, surface_form AS source_text, rs AS start, status, winner_name, round(confidence, 6) AS confidence FROM resolutions")
def debate_resolutions(spark, sf_dir):
    turns = debate_turns(spark)
    return R.resolutions(turns, C.claims(turns)).select("transcript_id", F.col("turn_index").cast("long"), "source_text", "span.start", "status", "winner_name", F.round("confidence", 6).alias("confidence"))


@query(DEBATE_CHAIN + f""", ranked_claims AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn_index, segment_index, sentence_index) AS place FROM claims WHERE k.t = 'empirical'),
met AS (SELECT claim_id, c.transcript_id, arg_min({{'s': lower(v.status), 'c': v.confidence, 'o': v.source}}, v.key_order) AS r FROM ranked_claims c JOIN {sql_values(RESPONSES, 'key, key_order, status, confidence, source')} ON contains(lower(c.text), lower(v.key)) WHERE place <= 3 GROUP BY ALL)
SELECT c.transcript_id, c.claim_id, CASE WHEN r.s IN ('verified', 'unverified', 'disputed', 'false', 'no_data') THEN r.s ELSE 'no_data' END AS status, coalesce(r.c, 0)::DOUBLE AS confidence, r.o AS summary FROM ranked_claims c LEFT JOIN met USING (transcript_id, claim_id) WHERE place <= 3""")
def fact_checks(spark, sf_dir):
    return _checked(spark, debate_turns(spark))


@query(ORACLES["fact_checks"].replace(DEBATE_CHAIN, CHAIN))
def conversation_fact_checks(spark, sf_dir):
    return _checked(spark, conversation_turns(spark, sf_dir))


@query(DEBATE_CHAIN + f"""SELECT transcript_id, claim_id, CASE WHEN lower(v.claim_type) IN ({', '.join(f"'{t}'" for t in C.CLAIM_TYPES)}) THEN lower(v.claim_type) ELSE k.t END AS claim_type,
CASE WHEN lower(v.claim_type) IN ({', '.join(f"'{t}'" for t in C.CLAIM_TYPES)}) THEN coalesce(v.confidence, 0.85) ELSE k.c END::DOUBLE AS confidence FROM claims LEFT JOIN {sql_values(ANSWERS, 'answer, claim_type, confidence, reasoning')} ON v.answer = claims.text""")
def classifier_answers(spark, sf_dir):
    return _answered(spark, debate_turns(spark))


@query(ORACLES["classifier_answers"].replace(DEBATE_CHAIN, CHAIN))
def conversation_classifier_answers(spark, sf_dir):
    return _answered(spark, conversation_turns(spark, sf_dir))


def _fallacy_sql(source: str) -> str:
    # The engine of the twin knows no look-ahead: the patterns that end in one are told apart by hand.
    def hit(p: str) -> str:
        if "(?!" in p:
            plain, _, rest = p.partition("(?!")
            words = rest.rstrip(")").lstrip(" ").strip("()?:").split("|")
            return f"(CASE WHEN regexp_matches(regexp_replace(text, '(?i){_Q(plain)} (?:{'|'.join(words)})', ' ', 'g'), '(?i){_Q(plain)}') THEN 1 ELSE 0 END)"
        return f"(CASE WHEN regexp_matches(text, '(?i){_Q(p)}') THEN 1 ELSE 0 END)"

    parts = " UNION ALL ".join(f"SELECT transcript_id, turn_index, speaker, '{kind}' AS fallacy_type, {' + '.join(map(hit, ps))} AS n FROM {source}" for kind, ps in H.FALLACIES.items())
    return f"SELECT transcript_id, turn_index, speaker, fallacy_type, n AS patterns_matched, least(1.0, round(0.4 + 0.2 * n, 6))::DOUBLE AS confidence FROM ({parts}) WHERE n > 0"


@query(DEBATE_CHAIN + _fallacy_sql("turns"))
def debate_fallacies(spark, sf_dir):
    return H.fallacies(debate_turns(spark)).select("transcript_id", F.col("turn_index").cast("long"), "speaker", "fallacy_type", "patterns_matched", "confidence")


@query(DEBATE_CHAIN + f", f AS ({_fallacy_sql('turns')}) SELECT transcript_id, count(*) AS total_fallacies, round(avg(confidence), 6) AS average_confidence, count(DISTINCT fallacy_type) AS n_types FROM f GROUP BY ALL")
def fallacy_summary(spark, sf_dir):
    rows = H.fallacy_summary(H.fallacies(debate_turns(spark)))
    return rows.select("transcript_id", "total_fallacies", "average_confidence", F.size("by_type").cast("long").alias("n_types"))


@query(f"WITH d AS (SELECT doc_id AS transcript_id, 0 AS turn_index, source AS speaker, text FROM documents) {_fallacy_sql('d')}")
def document_fallacies(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("transcript_id"), F.lit(0).alias("turn_index"), F.col("source").alias("speaker"), "text")
    return H.fallacies(docs).select("transcript_id", "turn_index", "speaker", "fallacy_type", "patterns_matched", "confidence")


def _scores_sql() -> str:
    low = "lower(text)"
    any_ = lambda ps: f"regexp_matches({low}, '{_ANY(ps)}')"
    n = lambda ps: "(" + " + ".join(f"regexp_matches({low}, '{_Q(p)}')::INT" for p in ps) + ")"
    words = lambda ws: [rf"\b{w}\b" for w in ws]
    causal, strong, compared, times, past = n(words(H.CAUSAL)), n(words(H.STRONG_CAUSAL)), n(H.COMPARATIVE), n(H.TIMES), n(words(H.PAST))
    factual = f"(0.4::DOUBLE - 0.1::DOUBLE * {n(words(H.UNCERTAIN))} + 0.05::DOUBLE * {n(words(H.CERTAIN))})"
    capped = lambda c: f"round(least(1.0::DOUBLE, {c}), 6)"
    number = rf"regexp_matches({low}, '\d+(?:\.\d+)?\s*(?:%|percent|million|billion|thousand)')"
    return f"""SELECT transcript_id, turn_index, CASE WHEN {number} THEN CASE WHEN {any_(words(H.STATISTICAL))} THEN 0.8 ELSE 0.6 END ELSE 0 END::DOUBLE AS statistical,
CASE WHEN {causal} + {strong} > 0 THEN {capped(f'0.5::DOUBLE + 0.1::DOUBLE * {causal} + 0.2::DOUBLE * {strong}')} ELSE 0 END AS causal,
CASE WHEN {compared} > 0 THEN {capped(f'0.5::DOUBLE + 0.15::DOUBLE * {compared}')} ELSE 0 END AS comparative,
CASE WHEN {times} > 0 OR {past} >= 2 THEN {capped(f'0.4::DOUBLE + 0.2::DOUBLE * {times} + 0.1::DOUBLE * {past}')} ELSE 0 END AS historical,
CASE WHEN {factual} >= {H.LEAST} THEN {capped(factual)} ELSE 0 END AS factual FROM turns"""


@query(CHAIN + _scores_sql())
def claim_scores(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return turns.select("transcript_id", F.col("turn_index").cast("long"), H.claim_scores(F.col("text")).alias("s")).select("transcript_id", "turn_index", "s.*")


@query(r"""WITH l AS (SELECT doc_id AS transcript_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
s AS (SELECT transcript_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM l)
SELECT transcript_id, count(*) AS n_lines, count(*) FILTER (WHERE line <> '') AS n_full, sum(length(line))::BIGINT AS n_chars FROM s GROUP BY ALL""")
def document_lines(spark, sf_dir):
    rows = S.lines(document_texts(spark, sf_dir))
    return rows.groupBy("transcript_id").agg(F.count("*").alias("n_lines"), F.sum((F.col("line") != "").cast("long")).alias("n_full"), F.sum(F.length("line")).cast("long").alias("n_chars"))


_DOC_LINES = rf"""
WITH lines AS (SELECT doc_id AS transcript_id, {_STRIP('line')} AS line, i FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
facts AS (SELECT transcript_id, bool_or(regexp_matches(line, '{_Q(T.SPEAKER_LINE)}')) AS labelled, count(*) FILTER (WHERE line <> '') AS n, coalesce(sum(length(line)) FILTER (WHERE line <> ''), 0) + greatest(count(*) FILTER (WHERE line <> '') - 1, 0) AS chars FROM lines GROUP BY ALL),
told AS (SELECT transcript_id, CASE WHEN labelled THEN 'labelled' WHEN (n <= 2 AND chars > {S.CONTINUOUS_CHARS}) OR (n > 0 AND chars / n > {S.CONTINUOUS_LINE}) THEN 'continuous' ELSE 'paragraphs' END AS dialect FROM facts)
"""


@query(_DOC_LINES + "SELECT dialect, count(*) AS n FROM told GROUP BY ALL")
def document_dialects(spark, sf_dir):
    return S.dialect(document_texts(spark, sf_dir)).groupBy("dialect").agg(F.count("*").alias("n"))


@query(_DOC_LINES + rf""", flagged AS (SELECT *, sum((line = '')::INT) OVER (PARTITION BY transcript_id ORDER BY i) AS paragraph, coalesce(max(CASE WHEN line = '' THEN i END) OVER (PARTITION BY transcript_id ORDER BY i), 0) + 1 AS first FROM lines),
joined AS (SELECT transcript_id, min(first)::INT AS line_number, string_agg(line, ' ' ORDER BY i) AS t FROM flagged WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY transcript_id, paragraph),
clean AS (SELECT transcript_id, line_number, {_STRIP(r"regexp_replace(regexp_replace(regexp_replace(t, '\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b', ' ', 'g'), '\s*[\[(][^\]\)]*[\])]', ' ', 'g'), '\s{2,}', ' ', 'g')".replace(chr(92) * 2, chr(92)))} AS text FROM joined)
SELECT transcript_id, line_number, text FROM clean WHERE text <> ''""")
def document_paragraphs(spark, sf_dir):
    return S.paragraph_utterances(document_texts(spark, sf_dir)).select("transcript_id", "line_number", "text")


@query()
def document_utterances(spark, sf_dir):
    return S.utterances(document_texts(spark, sf_dir)).select("transcript_id", "utterance_index", "line_number", "speaker", F.length("text").alias("n_chars"))


@query()
def continuous_turns(spark, sf_dir):
    return S.detected_turns(document_texts(spark, sf_dir)).select("transcript_id", "turn_index", "speaker", F.size("sentences").alias("n_sentences"), "start", "end", F.round("confidence", 6).alias("confidence"))


@query(CHAIN + "SELECT transcript_id, turn_index, speaker, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM turns")
def labelled_round_trip(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    return S.from_transcripts(D.labelled_text(turns)).select("transcript_id", F.col("turn_index").cast("long"), "speaker", "text")


NAMES = ["Senator Smith", "SPEAKER A", "Candidate B", "Dr. Jane Roe", "MR", "  ", "Smith Smith", "Governor", "Mr. Smith", "participant 7 x", "JONES"]


@query(f"SELECT v.raw, v.name FROM {sql_values(list(zip(NAMES, ['SMITH', 'A', 'B', 'JANE ROE', 'MR', 'UNKNOWN', 'SMITH', 'GOVERNOR', 'SMITH', 'X', 'JONES'])), 'raw, name')}")
def speaker_names(spark, sf_dir):
    return inline(spark, [(n,) for n in NAMES], "raw string").select("raw", T.normalize_speaker(F.col("raw")).alias("name"))


@query(f"SELECT conv_id, turn, sha256({_CANON('text')}) AS hash FROM conversations")
def canonical_hashes(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", T.canonical_hash(F.col("text")).alias("hash"))


@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', (event_id * 7919) // 3600000, (event_id * 7919) // 60000 % 60, (event_id * 7919) // 1000 % 60, (event_id * 7919) % 1000) AS srt FROM events")
def srt_times(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", T.srt_time(F.col("event_id") * 7919).alias("srt"))


_SRT = lambda c: f"printf('%02d:%02d:%02d,%03d', {c} // 3600000, {c} // 60000 % 60, {c} // 1000 % 60, {c} % 1000)"


@query(CHAIN + f"SELECT transcript_id, string_agg((turn_index + 1) || chr(10) || {_SRT('(s * 50)')} || ' --> ' || {_SRT('(e * 50)')} || chr(10) || '[' || speaker || '] ' || text || chr(10), chr(10) ORDER BY turn_index) AS srt FROM turns GROUP BY ALL")
def subtitles(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return D.subtitles(turns.select("transcript_id", "turn_index", "speaker", "text", (F.col("span.start") * 50).alias("start_ms"), (F.col("span.end") * 50).alias("end_ms")))


ANSWER_TEXTS = [
    (1, '[{"text": " A is B. ", "type": "factual", "confidence": 0.5, "evidence": "x"}, {"text": "a  is b.", "type": "x"}, {"no": 1}, 7]'),
    (2, 'Here you are: [{"text": "C", "speaker": "S"}] done'), (3, '```json\n[{"text": "D", "confidence": "bad"}]\n```'), (4, "nothing"), (5, "[]"),
]


@query(f"SELECT * FROM {sql_values([(1, 'A is B.', None, 'factual', 0.5, 'x'), (2, 'C', 'S', None, 0.9, None), (3, 'D', None, None, 0.9, None)], 'transcript_id, text, speaker, claim_type, confidence, evidence')}")
def generated_claims(spark, sf_dir):
    rows = S.generated_claims(inline(spark, ANSWER_TEXTS, "transcript_id int, raw string"))
    return rows.select("transcript_id", "text", "speaker", "claim_type", "confidence", F.col("metadata")["evidence"].alias("evidence"))


SPEECH = '{"text": "Hi. Yo.", "audio_duration": 2.5, "utterances": [{"speaker": "A", "text": "Hi.", "start": 0, "end": 900, "confidence": 0.75}, {"speaker": "B", "text": "Yo.", "start": 1000, "end": 2500}]}'


@query("SELECT 1 AS transcript_id, 'en' AS language, 2500::BIGINT AS duration_ms, 2 AS speaker_count, 2 AS utterance_count")
def speech_summary(spark, sf_dir):
    return S.speech_summary(inline(spark, [(1, SPEECH)], "transcript_id int, json string"))


@query("SELECT * FROM (VALUES (1, 0, 'SPEAKER_A', 'Hi.', 0::BIGINT, 900::BIGINT, 0.75::DOUBLE), (1, 1, 'SPEAKER_B', 'Yo.', 1000, 2500, 1.0)) AS v(transcript_id, turn_index, speaker, text, start_ms, end_ms, confidence)")
def speech_utterances(spark, sf_dir):
    return S.speech_utterances(inline(spark, [(1, SPEECH)], "transcript_id int, json string"))


@query("SELECT page_id, contains(url, 'youtube.com/watch') OR contains(url, 'youtu.be/') OR contains(url, 'youtube.com/v/') OR contains(url, 'youtube.com/embed/') AS video FROM pages")
def video_urls(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.is_video_url(F.col("url")).alias("video"))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) >= 50 AS long_enough FROM documents")
def input_guards(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.long_enough(F.col("text")).alias("long_enough"))


@query(_DOC_LINES + r""", full_lines AS (SELECT transcript_id, line, row_number() OVER (PARTITION BY transcript_id ORDER BY i) AS k FROM lines WHERE line <> ''),
tops AS (SELECT transcript_id, count(*) AS n, count(*) FILTER (WHERE k <= 10) AS top, count(*) FILTER (WHERE k <= 10 AND contains(line, ':') AND (starts_with(line, '[') OR starts_with(line, '(')
  OR (split_part(line, ':', 1) = upper(split_part(line, ':', 1)) AND split_part(line, ':', 1) <> lower(split_part(line, ':', 1))))) AS labels FROM full_lines GROUP BY ALL)
SELECT doc_id, length(text) > 2000 OR coalesce(n, 0) <= 2 OR labels < 0.3 * top AS continuous FROM documents LEFT JOIN tops ON transcript_id = doc_id""")
def turn_detection_guard(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.needs_turn_detection(F.col("text")).alias("continuous"))


@query("SELECT item_id, round(0.4 * a + 0.3 * b + 0.2 * c + 0.1 * d, 9)::DOUBLE AS score FROM (SELECT item_id, (item_id % 11) / 10.0 AS a, (item_id % 7) / 6.0 AS b, (item_id % 5) / 4.0 AS c, (item_id % 3) / 2.0 AS d FROM benchmark)")
def verification_scores(spark, sf_dir):
    part = lambda m: (F.col("item_id") % m) / F.lit(float(m - 1))
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", F.round(K.verification_score(part(11), part(7), part(5), part(3))["score"], 9).alias("score"))
