"""Registered queries of tasks, budgets, documents and reports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import claims as C
from lectern.operators import coreference as R
from lectern.operators import facts as K
from lectern.operators import reports as P
from lectern.operators import rhetoric as H
from lectern.operators import tasks as Q
from lectern.plans import catalog, engine
from lectern.plans.catalog import _ANY, _Q, CHAIN, DEBATE, DEBATE_CHAIN, conversation_turns, debate_turns, document_texts, query
from lectern.sources import transcripts as S

#: Limits of the budget queries: low enough to act on the conversations.
TIGHT = {"max_tasks": 40, "max_children": 9, "max_depth": 12}
BACKTRACKS = 2
# A debate with an unknown speaker, a turn without text, a short segment and a short claim.
ODD = [(9, 0, "UNKNOWN", "Data shows 5 percent. But no. 15%."), (9, 1, "ANN", ""), (9, 2, "BOB", "However, that is wrong because research shows 30 percent. Yet so.")]


def _row(source: str, kind: str, method: str, depth: int, child: int, outcome: str, part: str = "0", item: str = "0") -> str:
    return f"SELECT transcript_id, turn_index, {child} AS child, {part} AS part, {item} AS item, '{kind}' AS task_type, '{method}' AS method_name, {depth} AS depth, {outcome} AS outcome FROM {source}"


def tasks_sql(max_tasks: int, max_children: int, backtracks: int) -> str:
    """Common tables up to the events' and diagnostics' rows, after a chain."""
    done, split = f"'{Q.EXECUTED}'", f"'{Q.DECOMPOSED}'"
    rows = [
        _row("(SELECT DISTINCT transcript_id, -1 AS turn_index FROM turns)", "DECOMPOSE_TRANSCRIPT", "DecomposeTranscript", 0, 0, split),
        _row("turns", "PROCESS_TURN", "ProcessTurn", 1, 0, split),
        _row("turns", "REGISTER_SPEAKER_ENTITY", "RegisterSpeakerEntity", 2, 1, f"CASE WHEN speaker = 'UNKNOWN' THEN 'NO_METHOD' ELSE {done} END"),
        _row("turns", "PUSH_SCOPE", "PushScope", 2, 2, done),
        _row("turns WHERE turn_index > 0", "DETECT_DIALECTIC_RELATION", "DetectDialecticRelation", 2, 3, done),
        _row("turns", "BUILD_ARGUMENT_FRAME", "BuildArgumentFrame", 2, 4, done),
        _row("segments LEFT JOIN n_said USING (transcript_id, turn_index, segment_index)", "EXTRACT_CLAIMS_FROM_SEGMENT", "ExtractClaimsFromSegment", 2, 5, f"CASE WHEN length(text) <= {C.MIN_SEGMENT} THEN 'NO_METHOD' WHEN n IS NULL THEN '{Q.FAILED}' ELSE {split} END", "segment_index"),
        _row("candidates", "EXTRACT_ATOMIC_CLAIM", "ExtractAtomicClaim", 3, 5, f"CASE WHEN length(text) > {C.MIN_CLAIM} THEN {done} ELSE 'NO_METHOD' END", "segment_index", "sentence_index"),
        _row("turns LEFT JOIN n_refs USING (transcript_id, turn_index)", "DETECT_REFERENCES", "DetectReferences", 2, 6, f"CASE WHEN text = '' THEN 'NO_METHOD' WHEN n IS NULL THEN '{Q.FAILED}' ELSE {split} END"),
        _row("refs", "RESOLVE_REFERENCE", "ResolveReference", 3, 6, done, "0", "rs + 1"),
        _row("turns", "FINALIZE_FRAME", "FinalizeFrame", 2, 7, done),
        _row("turns", "FACT_CHECK_TURN_CLAIMS", "SkipTurnFactCheck", 2, 8, done),
        _row("turns", "POP_SCOPE", "PopScope", 2, 9, done),
    ]
    order, group = "turn_index, child, part, item", "transcript_id, turn_index, child, CASE WHEN child = 5 THEN part END"
    return f"""
, n_said AS (SELECT transcript_id, turn_index, segment_index, count(*) AS n FROM candidates GROUP BY ALL), n_refs AS (SELECT transcript_id, turn_index, count(*) AS n FROM refs GROUP BY ALL),
tasks AS ({' UNION ALL '.join(rows)}),
children AS (
  SELECT *, CASE WHEN depth = 1 THEN rank() OVER (PARTITION BY transcript_id, depth ORDER BY turn_index) END AS n1,
    CASE WHEN depth = 2 THEN rank() OVER (PARTITION BY transcript_id, turn_index, depth ORDER BY child, part) END AS n2,
    CASE WHEN depth = 3 THEN rank() OVER (PARTITION BY {group}, depth ORDER BY item) END AS n3 FROM tasks
), parents AS (
  SELECT *, max(n1) OVER (PARTITION BY transcript_id, turn_index) AS t1, max(n2) OVER (PARTITION BY {group}) AS t2 FROM children
), flagged AS (
  SELECT *, coalesce(t1 > {max_children}, false) OR (depth >= 2 AND coalesce(t2 > {max_children}, false)) OR coalesce(n3 > {max_children}, false) AS trimmed FROM parents
), summed AS (
  SELECT *, coalesce(sum((outcome <> 'NO_METHOD' AND NOT trimmed)::INT) OVER (PARTITION BY transcript_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM flagged
), cut AS (
  SELECT *, NOT trimmed AND before >= {max_tasks} AS over, NOT trimmed AND before < {max_tasks} AS kept FROM summed
), run AS (
  SELECT *, sum((outcome = '{Q.FAILED}')::INT) OVER (PARTITION BY transcript_id ORDER BY {order}) AS failure FROM cut WHERE kept
), short AS (
  SELECT transcript_id, CASE WHEN depth = 1 THEN -1 ELSE turn_index END AS turn_index, CASE WHEN depth = 3 THEN child ELSE 0 END AS child, CASE WHEN depth = 3 AND child = 5 THEN part ELSE 0 END AS part, min(depth) AS d FROM cut WHERE trimmed GROUP BY ALL
), events AS (
  SELECT transcript_id, {order}, 0 AS step, '{Q.SELECTED}' AS event_type, task_type, method_name, depth FROM run WHERE outcome <> 'NO_METHOD'
  UNION ALL SELECT transcript_id, {order}, 1, outcome, task_type, CASE WHEN outcome <> 'NO_METHOD' THEN method_name END, depth FROM run
  UNION ALL SELECT transcript_id, {order}, 2, '{Q.SOFT}', task_type, method_name, depth FROM run WHERE outcome = '{Q.FAILED}' AND failure >= {backtracks}
  UNION ALL SELECT r.transcript_id, r.turn_index, r.child, r.part, r.item, 8, '{Q.TRIMMED}', r.task_type, r.method_name, r.depth FROM run r JOIN short s ON r.transcript_id = s.transcript_id AND r.turn_index = s.turn_index AND r.child = s.child AND r.part = s.part AND r.depth = s.d - 1 WHERE r.item = 0
  UNION ALL SELECT DISTINCT transcript_id, 1073741824, 0, 0, 0, 9, '{Q.HARD}', 'DECOMPOSE_TRANSCRIPT', NULL, 0 FROM cut WHERE over
), told AS (
  SELECT transcript_id, turn_index, 'NO_APPLICABLE_METHOD' AS diagnostic_type, task_type, 'error' AS severity FROM run WHERE outcome = 'NO_METHOD'
  UNION ALL SELECT transcript_id, turn_index, 'BACKTRACK_LIMIT', task_type, 'warning' FROM run WHERE outcome = '{Q.FAILED}' AND failure >= {backtracks}
  UNION ALL SELECT transcript_id, min(turn_index), '{Q.HARD}', 'DECOMPOSE_TRANSCRIPT', 'error' FROM cut WHERE over GROUP BY ALL
)
"""


_EVENTS = "SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY turn_index, child, part, item, step) AS seq, event_type, task_type, method_name, depth, CASE WHEN turn_index BETWEEN 0 AND 1073741823 THEN turn_index END AS turn_index FROM events"
_TOLD = "SELECT transcript_id, diagnostic_type, task_type, severity, count(*) AS n FROM told GROUP BY ALL"
_FREE, _TIGHT = tasks_sql(2**30, 2**30, 20), tasks_sql(TIGHT["max_tasks"], TIGHT["max_children"], BACKTRACKS)
_ODD_CHAIN = catalog.chain(f"(SELECT * FROM {catalog.sql_values(DEBATE + ODD, 'conv_id, turn, role, text')})")


def _free(turns):
    return Q.within(Q.tasks(turns), 2**30, 2**30, 2**30)


def _counted(told):
    return told.groupBy("transcript_id", "diagnostic_type", "task_type", "severity").agg(F.count("*").alias("n"))


def _wide(events):
    return events.select("transcript_id", F.col("seq").cast("long"), "event_type", "task_type", "method_name", F.col("depth").cast("int"), F.col("turn_index").cast("long"))


def odd_turns(spark):
    return S.with_spans(catalog.inline(spark, DEBATE + ODD, "transcript_id long, turn_index int, speaker string, text string"))


@query(CHAIN + _FREE + _EVENTS)
def trace_events(spark, sf_dir):
    return _wide(Q.trace(_free(conversation_turns(spark, sf_dir))))


@query(CHAIN + _TIGHT + _EVENTS)
def budget_trace(spark, sf_dir):
    return _wide(Q.trace(Q.within(Q.tasks(conversation_turns(spark, sf_dir)), **TIGHT), BACKTRACKS))


@query(CHAIN + _TIGHT + _TOLD)
def budget_diagnostics(spark, sf_dir):
    return _counted(Q.diagnostics(Q.within(Q.tasks(conversation_turns(spark, sf_dir)), **TIGHT), BACKTRACKS))


@query(CHAIN + _TIGHT + f"SELECT transcript_id, count(*) FILTER (WHERE kept AND outcome <> 'NO_METHOD') AS tasks_executed, count(*) FILTER (WHERE kept AND outcome = '{Q.FAILED}') AS backtracks, NOT bool_or(over) AS success FROM cut GROUP BY ALL")
def budget_stats(spark, sf_dir):
    return Q.stats(Q.within(Q.tasks(conversation_turns(spark, sf_dir)), **TIGHT))


@query(CHAIN + _FREE + _TOLD)
def diagnostics(spark, sf_dir):
    return _counted(Q.diagnostics(_free(conversation_turns(spark, sf_dir))))


@query(_ODD_CHAIN + _FREE + _TOLD)
def debate_diagnostics(spark, sf_dir):
    return _counted(Q.diagnostics(_free(odd_turns(spark))))


@query(_ODD_CHAIN + "SELECT transcript_id, 'frame_' || turn_index AS frame_id, CASE WHEN relation IS NOT NULL THEN 'frame_' || (turn_index - 1) END AS parent_frame_id, CASE WHEN relation = 'REBUTTAL' THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence FROM relations")
def debate_frame_parents(spark, sf_dir):
    turns = odd_turns(spark)
    return C.frames(turns, C.claims(turns)).select("transcript_id", "frame_id", "parent_frame_id", "confidence")


_JSON = """, c AS (SELECT transcript_id, string_agg('{"id":' || to_json(claim_id) || ',"text":' || to_json(text) || ',"claim_type":' || to_json(k.t) || ',"speaker":' || to_json(speaker) || ',"confidence":' || k.c::DOUBLE || ',"span":[' || s || ',' || e || ']}', ',' ORDER BY turn_index, segment_index, sentence_index) AS l FROM claims GROUP BY ALL),
ids AS (SELECT transcript_id, turn_index, string_agg(to_json(claim_id)::VARCHAR, ',' ORDER BY segment_index, sentence_index) AS ids FROM claims GROUP BY ALL),
f AS (SELECT transcript_id, string_agg('{"id":"frame_' || turn_index || '","frame_type":"' || coalesce(relation, 'CLAIM') || '","speaker":' || to_json(speaker) || ',"summary":' || to_json(speaker || '''s argument') || ',"child_claims":[' || coalesce(ids, '') || ']' || coalesce(CASE WHEN relation IS NOT NULL THEN ',"parent_frame":"frame_' || (turn_index - 1) || '"' END, '') || '}', ',' ORDER BY turn_index) AS l, count(*) AS n FROM relations LEFT JOIN ids USING (transcript_id, turn_index) GROUP BY ALL),
t AS (SELECT transcript_id, count(*) FILTER (WHERE outcome <> 'NO_METHOD') AS n FROM cut GROUP BY ALL), m AS (SELECT transcript_id, count(*) AS n FROM claims GROUP BY ALL)
SELECT transcript_id, '{"claims":[' || coalesce(c.l, '') || '],"frames":[' || f.l || '],"stats":{"tasks_executed":' || t.n || ',"claims_count":' || coalesce(m.n, 0) || ',"frames_count":' || f.n || ',"fact_checks_count":0}}' AS document FROM f JOIN t USING (transcript_id) LEFT JOIN c USING (transcript_id) LEFT JOIN m USING (transcript_id)"""


@query(CHAIN + _FREE + _JSON)
def analysis_documents(spark, sf_dir):
    return engine.analyze_turns(conversation_turns(spark, sf_dir)).documents()


@query(_ODD_CHAIN + _FREE + _JSON)
def debate_documents(spark, sf_dir):
    return engine.analyze_turns(odd_turns(spark)).documents()


@query(CHAIN + f"""SELECT transcript_id, k.t AS claim_type, CASE WHEN k.t IN ({', '.join(f"'{t}'" for t in P.EMPIRICAL_TYPES)}) THEN 'empirical' ELSE 'narrative' END AS category, count(*) AS n FROM claims GROUP BY ALL""")
def claim_counts(spark, sf_dir):
    rows = P.claim_summary(C.claims(conversation_turns(spark, sf_dir))).select("transcript_id", F.explode("by_type").alias("claim_type", "n"))
    return rows.select("transcript_id", "claim_type", P.category(F.col("claim_type")).alias("category"), "n")


def _filters_sql(source: str) -> str:
    # The twin's engine knows letters beyond ASCII by their classes only.
    letters = r"\p{L}\p{N}\p{M}_"
    wide = lambda p: _Q(p.replace(r"[^\w\s]", rf"[^{letters}\s]").replace(r"\w", f"[{letters}]").replace(r"\W", f"[^{letters}]"))
    each = " UNION ALL ".join(f"SELECT '{name}' AS filter, count(*) FILTER (WHERE regexp_matches(lower(text), '{wide(p)}')) AS n FROM {source}" for name, p in P.FILTERS.items())
    return f"SELECT * FROM ({each}) WHERE n > 0"


@query(CHAIN + _filters_sql("sentences"))
def sentence_filters(spark, sf_dir):
    return P.filter_counts(C.sentences(C.segments(conversation_turns(spark, sf_dir))))


FILTERED = [
    "Yeah, right, okay.", "Do you think so?", "Suppose we had no tax.", "Use code TALK for a discount.", "Chapter 3", "Taxes rose.", "Thanks for having me on the show today.", "I grew up in a small town by the sea.", "The rates went up and then the",
    "It is good.", "You know, so anyway then", "Thisisonelongwordthatwasgluedtogetherbymistake is here.", "Unemployment fell to 4 percent in 2019 across the country.",
]


@query(f"WITH sentences AS (SELECT * FROM {catalog.sql_values([(t,) for t in FILTERED], 'text')}) " + _filters_sql("sentences"))
def filter_examples(spark, sf_dir):
    return P.filter_counts(catalog.inline(spark, [(t,) for t in FILTERED], "text string"))


@query(CHAIN + """, n AS (SELECT transcript_id, count(*) AS claims FROM claims GROUP BY ALL) SELECT t.transcript_id, count(DISTINCT CASE WHEN speaker <> 'UNKNOWN' THEN speaker END) AS speakers, max(e)::BIGINT AS characters, coalesce(any_value(claims), 0)::BIGINT AS claims FROM turns t LEFT JOIN n USING (transcript_id) GROUP BY ALL""")
def overviews(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return P.overview(turns, C.claims(turns), H.fallacies(turns)).select("transcript_id", "speakers", "characters", "claims")


@query(CHAIN + "SELECT transcript_id, (s // 1500)::INT AS chunk, min(turn_index) AS first_turn, max(turn_index) AS last_turn, sum(length(text))::BIGINT AS n_chars, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM turns GROUP BY ALL")
def turn_chunks(spark, sf_dir):
    rows = P.chunks(conversation_turns(spark, sf_dir))
    return rows.select("transcript_id", "chunk", F.col("first_turn").cast("long"), F.col("last_turn").cast("long"), "n_chars", F.array_join("speakers", ",").alias("speakers"))


_STANCE = f"CASE WHEN regexp_matches(lower(text), '\\b(?:{'|'.join(P.AGAINST)})\\b') THEN 'against' WHEN regexp_matches(lower(text), '\\b(?:{'|'.join(P.FOR)})\\b') THEN 'for' ELSE 'neutral' END"


@query(CHAIN + f"""SELECT transcript_id, stance, count(*) AS claims_count FROM (SELECT *, {_STANCE} AS stance FROM claims) GROUP BY ALL""")
def claim_stances(spark, sf_dir):
    rows = P.clusters(C.claims(conversation_turns(spark, sf_dir)))
    return rows.groupBy("transcript_id", "stance").agg(F.sum("claims_count").alias("claims_count"))


@query(DEBATE_CHAIN + f""", f AS ({catalog._fallacy_sql('turns')}) SELECT transcript_id, count(*) FILTER (WHERE confidence >= 0.8) AS high, count(*) FILTER (WHERE confidence >= 0.5 AND confidence < 0.8) AS medium, count(*) FILTER (WHERE confidence < 0.5) AS low FROM f GROUP BY ALL""")
def fallacy_severity(spark, sf_dir):
    rows = P.severity_summary(H.fallacies(debate_turns(spark)))
    return rows.select("transcript_id", *(F.col("by_severity")[b].alias(b) for b in ("high", "medium", "low")))


_SENTENCES = rf"""
WITH one AS (SELECT doc_id AS transcript_id, {catalog._STRIP("regexp_replace(text, '\\s+', ' ', 'g')")} AS t FROM documents WHERE text IS NOT NULL),
marked AS (SELECT transcript_id, regexp_replace(t, '([.!?]) ([A-Z"\[])', '\1' || chr(1) || '\2', 'g') AS t FROM one WHERE t <> ''),
freed AS (SELECT transcript_id, regexp_replace(regexp_replace(t, '((?:^|[^A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Sen|Rep|Gov|Jr|Sr)\.)' || chr(1), '\1 ', 'g'), '((?:^|[^\p{{L}}])\p{{Lu}}\.)' || chr(1), '\1 ', 'g') AS t FROM marked),
split AS (SELECT transcript_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS i FROM (SELECT transcript_id, string_split(t, chr(1)) AS ss FROM freed)),
placed AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (PARTITION BY transcript_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start, lag(sentence) OVER (PARTITION BY transcript_id ORDER BY i) AS prev FROM split),
scored AS (SELECT *, CASE WHEN prev IS NULL THEN 0 ELSE least(1.0::DOUBLE,
    CASE WHEN regexp_matches(prev, '\?\s*$') AND NOT regexp_matches(sentence, '\?\s*$') THEN 0.3::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '{_Q(S.STRONG_START)}') THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(sentence, '{_Q(S.DIRECT_ADDRESS)}') THEN 0.4::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(prev, '[\])]\s*$') AND regexp_matches(right(prev, 50), '\[[^\]]+\]|\([^\)]+\)') THEN 0.5::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(sentence, '(?i)^(?:Thank you|Thanks)') THEN 0.25::DOUBLE ELSE 0 END
    + CASE WHEN regexp_matches(prev, '(?i)(?:Thank you|Thanks)(?:\s+(?:very much|so much))?[.!]?\s*$') THEN 0.25::DOUBLE ELSE 0 END) END AS confidence FROM placed),
runs AS (SELECT *, sum((confidence >= 0.3 - 1e-9 AND i > 0)::INT) OVER (PARTITION BY transcript_id ORDER BY i) AS run FROM scored),
parts AS (SELECT *, (row_number() OVER (PARTITION BY transcript_id, run ORDER BY i) - 1) // {S.MAX_SENTENCES} AS part FROM runs),
grouped AS (SELECT transcript_id, run, part, count(*)::INT AS n_sentences, min(start) AS start, max(start + length(sentence))::INT AS "end", arg_min(confidence, i) AS confidence, string_agg(sentence, ' ' ORDER BY i) AS said FROM parts GROUP BY transcript_id, run, part),
detected AS (SELECT *, (row_number() OVER (PARTITION BY transcript_id ORDER BY run, part) - 1)::INT AS turn_index FROM grouped)
"""
catalog.ORACLES["continuous_turns"] = _SENTENCES + f"SELECT transcript_id, turn_index, CASE WHEN turn_index % 2 = 0 THEN '{S.DEFAULT_SPEAKERS[0]}' ELSE '{S.DEFAULT_SPEAKERS[1]}' END AS speaker, n_sentences, start, \"end\", CASE WHEN turn_index = 0 THEN 0.5 ELSE round(confidence, 6) END::DOUBLE AS confidence FROM detected"


# The documents hold paragraphs and continuous speech; labelled transcripts are compared by labelled_round_trip.
_CLEAN = catalog._STRIP(r"regexp_replace(regexp_replace(x, '\s*[\[(][^\]\)]*[\])]', ' ', 'g'), '\s{2,}', ' ', 'g')")
_UNTIMED = catalog._STRIP(r"regexp_replace(regexp_replace(x, '\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b', ' ', 'g'), '\s{2,}', ' ', 'g')")
_FLOWING = catalog.ORACLES["document_paragraphs"].rpartition("SELECT transcript_id, line_number, text FROM clean")[0]
_DETECTED = _SENTENCES.split("marked AS", 1)[1]
catalog.ORACLES["document_utterances"] = (
    _FLOWING.rstrip()
    + f""", flowing AS (SELECT transcript_id, string_agg(line, ' ' ORDER BY i) AS x FROM lines JOIN told USING (transcript_id) WHERE dialect = 'continuous' AND line <> '' GROUP BY ALL),
one AS (SELECT transcript_id, {catalog._STRIP("regexp_replace(x, '\\s+', ' ', 'g')")} AS t FROM (SELECT transcript_id, {_UNTIMED} AS x FROM flowing)),
marked AS{_DETECTED}, every AS (
  SELECT transcript_id, line_number, 'UNKNOWN' AS speaker, text FROM clean JOIN told USING (transcript_id) WHERE dialect = 'paragraphs' AND text <> ''
  UNION ALL SELECT transcript_id, turn_index + 1, CASE WHEN turn_index % 2 = 0 THEN '{S.DEFAULT_SPEAKERS[0]}' ELSE '{S.DEFAULT_SPEAKERS[1]}' END, {_CLEAN} FROM (SELECT transcript_id, turn_index, said AS x FROM detected)
)
SELECT transcript_id, (row_number() OVER (PARTITION BY transcript_id ORDER BY line_number) - 1)::INT AS utterance_index, line_number::INT AS line_number, speaker, length(text)::INT AS n_chars FROM every WHERE text <> ''"""
)


_PATH = "/".join


@query(CHAIN + f"""SELECT transcript_id, claim_id, 'turn_' || turn_index AS scope_id, '{_PATH(C.CLAIM_PATH)}' AS method_path, true AS requires_review, k.t = 'unclassified' OR k.c < 0.6 AS review_flag, k.t IN ({', '.join(f"'{t}'" for t in C.CHECKABLE)}) AS checkable FROM claims""")
def claim_lineage(spark, sf_dir):
    rows = C.claims(conversation_turns(spark, sf_dir))
    return rows.select("transcript_id", "claim_id", "scope_id", F.array_join("method_path", "/").alias("method_path"), "requires_review", "review_flag", "checkable")


@query(CHAIN + f"""SELECT r.transcript_id, r.turn_index, r.rs AS start, least({R.LISTED}, count(s.entity_id)) AS n_candidates, false AS should_commit, '{_PATH(R.RESOLUTION_PATH)}' AS method_path,
CASE WHEN count(s.entity_id) = 0 THEN 0 ELSE 1 END AS n_features FROM refs r LEFT JOIN scored s ON s.transcript_id = r.transcript_id AND s.turn_index = r.turn_index AND s.rs = r.rs GROUP BY ALL""")
def resolution_lineage(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    rows = R.resolutions(turns, C.claims(turns))
    return rows.select("transcript_id", F.col("turn_index").cast("long"), "span.start", F.size("candidates").cast("long").alias("n_candidates"), "should_commit", F.array_join("method_path", "/").alias("method_path"), F.size("scoring_features").alias("n_features"))


@query(CHAIN + """SELECT transcript_id, entity_id, CASE WHEN arg_min(entity_type, o) = 'PERSON' THEN 1 ELSE count(*) END AS n_spans, CASE WHEN arg_min(entity_type, o) = 'PERSON' THEN array_to_string(list_sort(list_distinct([lower(arg_min(canonical, o)), upper(arg_min(canonical, o))])), ',') ELSE '' END AS aliases FROM keyed GROUP BY ALL""")
def entity_names(spark, sf_dir):
    turns = conversation_turns(spark, sf_dir)
    return R.entities(turns, C.claims(turns)).select("transcript_id", "entity_id", F.size("mention_spans").cast("long").alias("n_spans"), F.array_join("aliases", ",").alias("aliases"))


# One sentence for each rule, in an order that tries their precedence as well.
KINDS = [
    "The rate rose by 30 percent here.", "There were 5 million people at study.", "A controlled sample was used here.", "The study design is found in data.", "Research found that it is measured.", "Evidence is what they must have.",
    "They should do what is right now.", "The bright side is a nice thing.", "Free will is an illusion to many.", "The meaning of determinism is clear.", "I think it is a good day today.", "I feel it has some merit to it.",
    "It will be a long road for them.", "That is probably what he has done.", "This is a plain thing to say now.", "Studies were kept in a box there.",
]


@query(f"SELECT i, text, c.t AS claim_type, c.c::DOUBLE AS confidence, c.r AS reason FROM (SELECT i, text, {catalog._CLASS} AS c FROM (SELECT i, text, lower(text) AS lo FROM {catalog.sql_values(list(enumerate(KINDS)), 'i, text')}))")
def claim_kinds(spark, sf_dir):
    rows = catalog.inline(spark, list(enumerate(KINDS)), "i int, text string")
    return rows.select("i", "text", C.classification(F.col("text")).alias("c")).select("i", "text", "c.claim_type", "c.confidence", "c.reason")


@query("""SELECT item_id, CASE WHEN v >= 0.9 THEN 'verified true' WHEN v >= 0.7 THEN 'likely true' WHEN v >= 0.4 THEN 'mixed' WHEN v >= 0.2 THEN 'likely false' ELSE 'verified false' END AS band,
CASE WHEN v >= 0.85 THEN 'excellent' WHEN v >= 0.7 THEN 'good' WHEN v >= 0.55 THEN 'average' WHEN v >= 0.4 THEN 'poor' ELSE 'very poor' END AS rating FROM (SELECT item_id, (item_id % 101) / 100.0 AS v FROM benchmark)""")
def score_bands(spark, sf_dir):
    v = (F.col("item_id") % 101) / F.lit(100.0)
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return rows.select("item_id", K.verification_score(v, v, v, v)["band"].alias("band"), H.rating(v).alias("rating"))
