from lectern.plans import catalog


def test_answer_joins_cover_the_conversations(spark, tmp_path):
    turns = [(c, 0, "user", "Research shows 70% of people agree.") for c in range(50)] + [(c, 1, "assistant", "His methodology is fundamentally flawed.") for c in range(50)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    checked = catalog.QUERIES["conversation_fact_checks"](spark, str(tmp_path)).collect()
    assert sorted((r.transcript_id, r.status, r.confidence, r.summary) for r in checked) == [(c, "verified", 0.9, "Survey office") for c in range(50)]
    answered = catalog.QUERIES["conversation_classifier_answers"](spark, str(tmp_path)).collect()
    assert sorted((r.transcript_id, r.claim_type, r.confidence) for r in answered) == sorted(x for c in range(50) for x in ((c, "normative", 0.66), (c, "empirical", 0.85)))


def test_debate_answers_are_kept(spark):
    checked = {(r.status, r.confidence, r.summary) for r in catalog.QUERIES["fact_checks"](spark, "").collect()}
    assert ("verified", 0.9, "Survey office") in checked
    answered = {(r.claim_type, r.confidence) for r in catalog.QUERIES["classifier_answers"](spark, "").collect()}
    assert ("normative", 0.66) in answered
