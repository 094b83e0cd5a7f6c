"""Golden results of short debates."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.operators import claims as C
from lectern.operators import coreference as R
from lectern.operators import documents as D
from lectern.operators import facts as K
from lectern.operators import reports as P
from lectern.operators import rhetoric as H
from lectern.operators import tasks as Q
from lectern.plans import engine
from lectern.sources import transcripts as S

H1, P1 = "HARRIS", "PETERSON"
DEBATES = {
    "A": [(H1, 0, 62, "Free will is an illusion. My studies prove this conclusively."), (P1, 64, 104, "His methodology is fundamentally flawed.")],
    "B": [(H1, 0, 98, "Brain activity precedes conscious decision by 300 milliseconds. This proves free will is illusory.")],
    "C": [(H1, 0, 25, "Free will is an illusion."), (P1, 27, 38, "I disagree.")],
    "D": [(H1, 0, 86, "The Libet experiments showed something important. Benjamin Libet proved this in 1983.")],
    "E": [(H1, 0, 48, "Free will is an illusion because of causal laws."), (P1, 50, 102, "But that ignores the subjective experience of choice.")],
    "R": [("MODERATOR", 0, 25, "Welcome to the debate.")],
}


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(k, i, s, t, (a, b)) for k, turns in DEBATES.items() for i, (s, a, b, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "transcript_id string, turn_index int, speaker string, text string, span struct<start int, end int>")
    return engine.analyze_turns(turns)


def test_claims(analysed):
    got = {(r.transcript_id, r.span.start, r.span.end): (r.claim_type, r.confidence) for r in analysed.claims.collect()}
    assert got[("A", 0, 25)] == ("philosophical", 0.85)
    assert got[("A", 26, 61)] == ("unclassified", 0.3)
    assert got[("A", 64, 104)] == ("methodological", 0.8)
    assert got[("B", 0, 63)] == ("unclassified", 0.3) and got[("B", 64, 98)] == ("philosophical", 0.85)
    assert got[("D", 50, 85)] == ("unclassified", 0.3)
    assert sum(k[0] == "C" for k in got) == 1


def test_references(analysed):
    got = {(r.transcript_id, r.span.start): (r.source_text, r.status, r.winner_name, round(r.confidence, 4)) for r in analysed.references.collect()}
    assert got[("A", 43)] == ("this", "TENTATIVE", "Free will is an illusion.", 0.74)
    assert got[("A", 64)] == ("His", "TENTATIVE", H1, 0.76)
    assert got[("B", 64)][0:2] == ("This", "TENTATIVE") and got[("B", 64)][3] == 0.74
    assert got[("D", 72)] == ("this", "UNRESOLVED", None, 0.0)
    assert got[("E", 54)][0:2] == ("that", "TENTATIVE")


def test_frames_and_entities(analysed):
    frames = {(r.transcript_id, r.turn_index): r for r in analysed.frames.collect()}
    assert frames[("C", 1)].frame_type == "REBUTTAL" and frames[("C", 1)].parent_frame_id == "frame_0" and frames[("C", 1)].child_claim_ids == []
    assert (frames[("E", 1)].frame_type, frames[("E", 1)].confidence) == ("REBUTTAL", 0.8)
    assert frames[("E", 0)].frame_type == "CLAIM"
    assert frames[("A", 0)].summary == "HARRIS's argument" and len(frames[("A", 0)].child_claim_ids) == 2
    people = {(r.transcript_id, r.canonical) for r in analysed.entities.filter("entity_type = 'PERSON'").collect()}
    assert {("C", H1), ("C", P1)} <= people


def test_documents_and_stats(analysed):
    docs = {r.transcript_id: json.loads(r.document) for r in analysed.documents().collect()}
    assert [c["span"] for c in docs["A"]["claims"]] == [[0, 25], [26, 61], [64, 104]]
    assert docs["A"]["stats"]["claims_count"] == 3 and docs["A"]["stats"]["frames_count"] == 2
    stats = {r.transcript_id: r for r in analysed.stats.collect()}
    assert stats["A"].success and stats["A"].tasks_executed == 1 + 2 * 7 + 1 + 2 + 2 + 3 + 2


def sequential_salience(turns, claims):
    """The stack that the sort key replaces: turns of (speaker, claim names); salience before each turn's end."""
    base, out = None, []
    boost = lambda xs, e: [e, *(x for x in xs if x != e)]
    for speaker, said in zip(turns, claims):
        if speaker != "UNKNOWN":
            base = boost(base or [], speaker)
        top = []
        for c in said:
            top = boost(top, c)
        out.append(top + [x for x in base or [] if x not in top])
        if base is None:
            base = top
        else:
            for c in top:
                base = boost(base, c)
    return out


def test_salience_equals_a_stack(spark):
    import random

    rng = random.Random(8)
    rows, claims, want = [], [], {}
    for t in range(25):
        speakers = [rng.choice(["UNKNOWN", "ANN", "BOB"]) for _ in range(rng.randrange(1, 6))]
        said = [[f"claim number {rng.randrange(5)}" for _ in range(rng.randrange(0, 4))] for _ in speakers]
        for i, s in enumerate(speakers):
            rows.append((t, i, s, "this", (i * 10, i * 10 + 4)))
            claims += [(t, i, 0, p, c, s, (i * 10, i * 10 + 4)) for p, c in enumerate(said[i])]
        want |= {(t, i): o for i, o in enumerate(sequential_salience(speakers, said))}
    turns = spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string, span struct<start int, end int>")
    found = spark.createDataFrame(claims, "transcript_id int, turn_index int, segment_index int, sentence_index int, text string, speaker string, span struct<start int, end int>")
    names = R.entities(turns, found).select("transcript_id", "entity_id", "canonical")
    got: dict = {}
    for r in R.salience(turns, found).join(names, ["transcript_id", "entity_id"]).orderBy("rank").collect():
        got.setdefault((r.transcript_id, r.turn_index), []).append(r.canonical)
    assert got == {k: v for k, v in want.items() if v}


def test_parsing(spark):
    text = "before labels\nSENATOR JONES: Hello (applause) there.\nmore  words\n\nSPEAKER_A: not a label\nUS-BASED firms win.\nDR. ROE:\nalone here"
    plain = "# header\nFirst 00:01:02 line\ngoes on\n\n[Music]\n\nSecond one"
    rows = spark.createDataFrame([(1, text), (2, plain), (3, ""), (4, None)], "transcript_id int, text string")
    got = [tuple(r) for r in S.utterances(rows).orderBy("transcript_id", "utterance_index").select("transcript_id", "speaker", "text", "line_number").collect()]
    assert got == [
        (1, "UNKNOWN", "before labels", 1), (1, "JONES", "Hello there. more words SPEAKER_A: not a label", 2), (1, "US", "BASED firms win.", 6), (1, "ROE", "alone here", 8),
        (2, "UNKNOWN", "First line goes on", 1), (2, "UNKNOWN", "Second one", 7),
    ]
    turns = {(r.transcript_id, r.turn_index): r for r in S.from_transcripts(rows).collect()}
    assert turns[(3, 0)].text == "" and turns[(1, 1)].span.start == len("before labels") + 2


def test_continuous_speech(spark):
    one = "Hello everyone and welcome. Dr. Smith is here. What do you think? Yes, I agree with that. " + "It goes on. " * 45
    rows = spark.createDataFrame([(1, one * 12)], "transcript_id int, text string")
    assert S.dialect(rows).first().dialect == "continuous"
    turns = S.detected_turns(rows).orderBy("turn_index").collect()
    assert [t.speaker for t in turns[:3]] == ["KIRK", "QUESTIONER", "KIRK"] and turns[0].confidence == 0.5
    assert turns[0].sentences == ["Hello everyone and welcome.", "Dr. Smith is here.", "What do you think?"]
    assert max(len(t.sentences) for t in turns) == 20 and turns[1].confidence == pytest.approx(0.65)


def test_fact_check_budget(spark):
    rows = [(1, i, "ANN", f"Studies show fact number {i} is proven with {i * 10}% confidence.") for i in range(10)]
    turns = S.with_spans(spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string"))
    none = F.array().cast("array<string>")
    responses = spark.createDataFrame([("FACT NUMBER 1", 2, "verified", 0.9, "x"), ("number", 5, "false", 0.2, "y"), ("", 9, "disputed", 0.3, "z")], "key string, key_order int, status string, confidence double, source string")
    out = engine.analyze_turns(turns, responses=responses.withColumn("sources", none).withColumn("urls", none), budgets=K.Budgets(fact_check_budget=3))
    assert [r.status for r in out.fact_checks.orderBy("claim_text").collect()] == ["false", "verified", "false"]
    assert out.diagnostics.filter("task_type = 'FACT_CHECK_CLAIM'").count() == 7


def test_stages(spark):
    rows = [(1, i, "ANN", "It is what it is, data shows.") for i in range(6)]
    turns = S.with_spans(spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string"))
    engine.clear_stages()
    engine.stage("slow", "SHORTEN", 5.0)(lambda df: df.limit(1))
    engine.stage("quick", "SHORTEN", 1.0)(lambda df: df.limit(2))
    assert engine.stages_for("SHORTEN") == ["quick", "slow"] and engine.run_stage("SHORTEN", turns).count() == 2
    with pytest.raises(LookupError):
        engine.run_stage("OTHER", turns)
    engine.stage("early claims", "CLAIMS")(lambda df: df.filter("turn_index < 2"))
    try:
        out = engine.analyze_turns(turns)
        assert out.claims.count() == 2 and out.stats.first().claims_count == 2
    finally:
        engine.clear_stages()


def test_budgets_act(spark):
    rows = [(1, i, "ANN", "It is what it is, data shows.") for i in range(60)] + [(2, 0, "BOB", "Data shows this. " * 70)]
    turns = S.with_spans(spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string"))
    free = engine.analyze_turns(turns, budgets=K.Budgets(max_tasks=100))
    assert free.frames.filter("transcript_id = 1").count() == 60 and {r.transcript_id: r.success for r in free.stats.collect()} == {1: False, 2: False}
    out = engine.analyze_turns(turns, budgets=K.Budgets(strict=True))
    assert out.frames.filter("transcript_id = 1").count() == 50
    assert out.claims.filter("transcript_id = 2").count() == 50 and out.references.filter("transcript_id = 2").count() == 50
    assert out.trace.filter("event_type = 'BUDGET_TRIM_CHILDREN'").groupBy("transcript_id").count().collect() != []
    short = engine.analyze_turns(turns, budgets=K.Budgets(strict=True, max_tasks=5))
    told = {(r.transcript_id, r.diagnostic_type) for r in short.diagnostics.collect()}
    assert told == {(1, "HARD_BUDGET_EXCEEDED"), (2, "HARD_BUDGET_EXCEEDED")}
    assert [(r.tasks_executed, r.success) for r in short.stats.collect()] == [(5, False)] * 2 and short.claims.count() == 0
    assert short.trace.filter("event_type = 'HARD_BUDGET_EXCEEDED'").count() == 2


def test_backtrack_limit(spark):
    turns = S.with_spans(spark.createDataFrame([(1, i, "ANN", "Hello there my friend") for i in range(30)], "transcript_id int, turn_index int, speaker string, text string"))
    out = engine.analyze_turns(turns)
    assert out.stats.first().backtracks == 60  # neither claims nor references in any turn
    assert out.diagnostics.filter("diagnostic_type = 'BACKTRACK_LIMIT' and severity = 'warning'").count() == 41
    assert Q.events_of(out.trace, "SOFT_BUDGET_BACKTRACKS").count() == 41
    assert Q.events_of(out.trace, task_type="DETECT_REFERENCES").count() == 30 * 2 + 21
    events = json.loads(Q.trace_documents(out.trace).first().document)
    assert events[0] == {"event_type": "METHOD_SELECTED", "task_type": "DECOMPOSE_TRANSCRIPT", "method_name": "DecomposeTranscript", "depth": 0} and len(events) == out.trace.count()


def test_task_keys(spark):
    key = Q.task_key(F.col("kind"), F.col("a"), F.col("b"), F.struct("text"))
    rows = spark.createDataFrame([(1, 1, "X", 0, 5, "t"), (1, 2, "X", 0, 5, "t"), (1, 3, "X", 0, 6, "t"), (2, 1, "X", 0, 5, "t")], "transcript_id int, seq int, kind string, a int, b int, text string")
    got = {(r.transcript_id, r.seq): r.skipped for r in Q.deduplicated(rows.withColumn("dedup_key", key)).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 1): False}


def test_callable_clients(spark):
    turns = S.with_spans(spark.createDataFrame([(1, 0, "ANN", "Data shows 5 percent. It is a plain fact that he was right.")], "transcript_id int, turn_index int, speaker string, text string"))
    out = engine.analyze_turns(turns, classifier=lambda: lambda t: ("empirical", 0.9, "told") if "plain" in t else None, checker=lambda: lambda t: ("verified", 0.7, "office", ["a"], ["u"]))
    assert {r.text: (r.claim_type, r.llm_used) for r in out.claims.collect()} == {"Data shows 5 percent.": ("empirical", False), "It is a plain fact that he was right.": ("empirical", True)}
    assert [(r.status, r.summary) for r in out.fact_checks.collect()] == [("verified", "office")] * 2


def test_many_pieces_have_linear_offsets(spark):
    text = " ".join(f"Data number {i} shows this." for i in range(700))
    turns = S.with_spans(spark.createDataFrame([(1, 0, "ANN", text)], "transcript_id int, turn_index int, speaker string, text string"))
    found = C.sentences(C.segments(turns)).collect()
    assert len(found) == 700 and all(text[r.span.start : r.span.end] == r.text for r in found)
    refs = R.references(turns).collect()
    assert len(refs) == 700 and all(text[r.span.start : r.span.end] == "this" for r in refs)


def test_salience_keeps_people_beyond_the_list(spark):
    rows = [(1, i, f"P{i}", "this", (i * 10, i * 10 + 4)) for i in range(30)]
    turns = spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string, span struct<start int, end int>")
    none = spark.createDataFrame([], "transcript_id int, turn_index int, segment_index int, sentence_index int, text string, speaker string, span struct<start int, end int>")
    last = R.salience(turns, none).filter("turn_index = 29").collect()
    assert len(last) == 30 and sorted(r.rank for r in last) == [*range(10), *[10] * 20]


def test_answers_and_responses_in_any_order(spark):
    turns = S.with_spans(spark.createDataFrame([(1, 0, "ANN", "Data shows 5 percent.")], "transcript_id int, turn_index int, speaker string, text string"))
    answers = [("Data shows 5 percent.", "normative", 0.7, "a"), ("Data shows 5 percent.", "empirical", 0.9, "b")]
    told = {C.with_answers(C.claims(turns), spark.createDataFrame(x, "text string, claim_type string, confidence double, reasoning string")).first().claim_type for x in (answers, answers[::-1])}
    assert told == {"empirical"}
    keys = spark.createDataFrame([("5 PERCENT", 2, "false", 0.1, "x"), ("shows", 1, "verified", 0.9, "y"), (None, 0, "z", 0.0, "z")], "key string, key_order int, status string, confidence double, source string")
    keys = keys.withColumn("sources", F.array().cast("array<string>")).withColumn("urls", F.array().cast("array<string>"))
    both = [[r.response.status for r in K.first_responses(C.claims(turns), keys, known).collect()] for known in (0, 100)]
    assert both == [["verified"], ["verified"]]


def test_reports(spark):
    turns = S.with_spans(spark.createDataFrame([(1, 0, "ANN", "Data shows 5 percent because of trade. You should agree."), (1, 1, "Bob Roe", "But research shows it is wrong.")], "transcript_id int, turn_index int, speaker string, text string"))
    found = C.claims(turns)
    summary = P.claim_summary(found).first()
    assert summary.total == 2 and summary.by_type == {"empirical": 2} and summary.by_category == {"empirical": 2}
    known = R.entities(turns, found)
    names = spark.createDataFrame([(1, " bob roe "), (1, "nobody"), (2, "ann")], "transcript_id int, name string")
    assert [(r.name, r.entity_id) for r in P.entity_named(known, names).collect()] == [(" bob roe ", known.filter("canonical = 'Bob Roe'").first().entity_id)]
    assert known.filter(P.matches(F.lit("ANN "), F.col("canonical"), F.col("aliases"))).count() == 1
    assert P.by_id(found, found.limit(1), "claim_id").count() == 1
    assert {(r.type, r.stance): r.claims_count for r in P.clusters(found).collect()} == {("statistical", "for"): 1, ("factual", "against"): 1}
    checks = spark.createDataFrame([(1, r.claim_id, "verified", 0.9, "Office") for r in found.collect()], "transcript_id int, claim_id string, status string, confidence double, summary string")
    assert {r.explanation for r in P.checked_claims(found, checks).collect()} == {"This claim is TRUE. Source: Office."}
    page = P.overview(turns, found, H.fallacies(turns), checks).first()
    assert (page.speakers, page.claims, page.fallacies, page.verification_summary) == (2, 2, 0, {"verified": 2})
    blocks = spark.createDataFrame([(1, " taxes rose "), (2, "all TAXES fell"), (3, "none")], "block_id int, text string")
    ready = spark.createDataFrame([("taxes", 2, "c1", 0.9), ("taxes rose", 1, "c2", 0.8), ("taxes rose", 1, "c3", 0.7)], "pattern string, pattern_order int, claim string, confidence double")
    assert sorted((r.block_id, r.claim) for r in P.static_claims(blocks, ready).collect()) == [(1, "c2"), (1, "c3"), (2, "c1")]
    assert P.filtered(spark.createDataFrame([("Yeah, right.",), ("Unemployment fell to 4 percent in 2019.",)], "text string")).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / f"in/{i}.txt").write_text("ANN: Data shows it works.\n\nBOB: No." + " It is so." * i)
    texts = S.read_texts(spark, str(tmp_path / "in"))
    result = engine.analyze(texts)
    saved = D.saved_analyses(texts, result.documents()).coalesce(1)
    D.write_json(saved, str(tmp_path / "out"))
    (tmp_path / "out/bad.json").write_text("{broken")
    read = S.read_analyses(spark, str(tmp_path / "out"))
    assert read.count() == 4 and sorted(map(str, read.select("id", "input_text").collect())) == sorted(map(str, saved.select("id", "input_text").collect()))
    assert [r.claims_count for r in S.recent_analyses(read).collect()] == [1] * 4
    (tmp_path / "pages").mkdir()
    for i, r in enumerate(read.limit(2).toJSON().collect()):
        (tmp_path / f"pages/{i}.json").write_text(json.dumps(json.loads(r), indent=2))
    assert S.read_analyses(spark, str(tmp_path / "pages"), one_per_file=True).count() == 2
    (tmp_path / "in/b.txt").write_text("  ")
    with pytest.raises(S.EmptyTranscript):
        S.read_texts(spark, str(tmp_path / "in"))


def test_speech_documents(spark):
    one = '{"text": "Hi. Yo.", "audio_duration": 2.5, "utterances": [{"speaker": "A", "text": "Hi.", "start": 0, "end": 900, "confidence": 0.75}, {"speaker": "B", "text": "Yo.", "start": 1000, "end": 2500}]}'
    rows = spark.createDataFrame([(1, one)], "transcript_id int, json string")
    got = json.loads(D.speech_documents(S.speech_utterances(rows), S.speech_summary(rows)).first().document)
    assert got["metadata"] == {"audio_duration_ms": 2500, "speaker_count": 2, "language": "en", "utterance_count": 2} and got["full_text"] == "Hi. Yo."
    assert got["utterances"][1] == {"speaker": "SPEAKER_B", "text": "Yo.", "start_ms": 1000, "end_ms": 2500, "confidence": 1.0}


def test_fallacies_and_scores(spark):
    df = spark.createDataFrame([(1, 0, "A", "You are just a liar. So you're saying either we act or we lose."), (1, 1, "B", "studies show clear gains")], "transcript_id int, turn_index int, speaker string, text string")
    found = {r.fallacy_type: (r.patterns_matched, r.severity) for r in H.fallacies(df).collect()}
    assert found == {"ad_hominem": (2, "high"), "straw_man": (1, "medium"), "false_dilemma": (1, "medium")}
    assert H.fallacy_summary(H.fallacies(df)).first().total_fallacies == 3
    s = spark.createDataFrame([("A recent poll says 50% voted because this leads to change, in 1995.",)], "t string").select(H.claim_scores(F.col("t")).alias("s")).first().s
    assert (s.statistical, s.causal, s.historical) == (0.8, 0.7, 0.6)


def test_streamed_claims_equal_batch(spark, tmp_path):
    from lectern.streaming.turns import stream_claims

    rows = [(1, i, "ANN", f"Data shows {i} is right. Nothing.", (0, 40), f"2024-01-01 00:00:0{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "transcript_id int, turn_index int, speaker string, text string, span struct<start int, end int>, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.write.parquet(str(tmp_path / "in"))
    stream = stream_claims(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("streamed").count() == C.claims(df.drop("ts")).count() == 5
