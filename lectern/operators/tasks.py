"""Tasks of an analysis, in the order a depth-first planner would run them.

No planner runs: what it would do follows from turns, segments, sentences and references, so tasks are a
table with an order key. Budgets cut that table, and trace and diagnostics are read off it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import claims as C
from lectern.operators import coreference as R

# Outcomes of a task and kinds of events.
EXECUTED, DECOMPOSED, FAILED, NO_METHOD = "OPERATOR_EXECUTED", "TASK_DECOMPOSED", "OPERATOR_FAILED", "NO_METHOD"
SELECTED, SKIPPED, TRIMMED, SOFT, HARD = "METHOD_SELECTED", "DEDUP_SKIP", "BUDGET_TRIM_CHILDREN", "SOFT_BUDGET_BACKTRACKS", "HARD_BUDGET_EXCEEDED"
#: Depth, then (child, part, item): where a task lies within its turn.
ORDER = ["turn_index", "child", "part", "item"]
SEGMENT, REFERENCE, CHECK = 5, 6, 8


def _task(rows: DataFrame, kind: str, method: str, depth: int, child: int, outcome: Column | str, part: Column | int = 0, item: Column | int = 0, message: Column | str = "") -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(
        "transcript_id", F.col("turn_index").cast("int").alias("turn_index"), F.lit(child).alias("child"), col(part).cast("int").alias("part"), col(item).cast("int").alias("item"),
        F.lit(kind).alias("task_type"), F.lit(method).alias("method_name"), F.lit(depth).alias("depth"), col(outcome).alias("outcome"), col(message).cast("string").alias("message"),
    )


def tasks(turns: DataFrame, claims: DataFrame | None = None, fact_check_budget: int | None = None) -> DataFrame:
    """``transcript_id, turn_index, child, part, item, task_type, method_name, depth, outcome, message``.

    With a fact-check budget, claims are checked: ``claims`` must be given then.
    """
    cut = C.segments(turns)
    said = C.candidates(C.sentences(cut))
    refs = R.references(turns)
    known = F.coalesce("speaker", F.lit(T.UNKNOWN)) != T.UNKNOWN
    spoken = said.groupBy("transcript_id", "turn_index", "segment_index").agg(F.count("*").alias("_n"))
    whole = cut.join(spoken, ["transcript_id", "turn_index", "segment_index"], "left")
    held = refs.groupBy("transcript_id", "turn_index").agg(F.count("*").alias("_r"))
    read = turns.select("transcript_id", "turn_index", F.length("text").alias("_l")).join(held, ["transcript_id", "turn_index"], "left")
    long = F.length("text") > C.MIN_SEGMENT
    first = turns.groupBy("transcript_id").agg(F.lit(-1).alias("turn_index"))
    parts = [
        _task(first, "DECOMPOSE_TRANSCRIPT", "DecomposeTranscript", 0, 0, DECOMPOSED),
        _task(turns, "PROCESS_TURN", "ProcessTurn", 1, 0, DECOMPOSED),
        _task(turns, "REGISTER_SPEAKER_ENTITY", "RegisterSpeakerEntity", 2, 1, F.when(known, EXECUTED).otherwise(NO_METHOD), message="unknown speaker"),
        _task(turns, "PUSH_SCOPE", "PushScope", 2, 2, EXECUTED),
        _task(turns.filter("turn_index > 0"), "DETECT_DIALECTIC_RELATION", "DetectDialecticRelation", 2, 3, EXECUTED),
        _task(turns, "BUILD_ARGUMENT_FRAME", "BuildArgumentFrame", 2, 4, EXECUTED),
        _task(whole, "EXTRACT_CLAIMS_FROM_SEGMENT", "ExtractClaimsFromSegment", 2, SEGMENT, F.when(~long, NO_METHOD).when(F.col("_n").isNull(), FAILED).otherwise(DECOMPOSED), F.col("segment_index"), message=F.col("text")),
        _task(said, "EXTRACT_ATOMIC_CLAIM", "ExtractAtomicClaim", 3, SEGMENT, F.when(F.length("text") > C.MIN_CLAIM, EXECUTED).otherwise(NO_METHOD), F.col("segment_index"), F.col("sentence_index") + 1, F.col("text")),
        _task(read, "DETECT_REFERENCES", "DetectReferences", 2, REFERENCE, F.when(F.col("_l") == 0, NO_METHOD).when(F.col("_r").isNull(), FAILED).otherwise(DECOMPOSED), message="empty turn"),
        _task(refs, "RESOLVE_REFERENCE", "ResolveReference", 3, REFERENCE, EXECUTED, item=F.col("span.start") + 1),
        _task(turns, "FINALIZE_FRAME", "FinalizeFrame", 2, 7, EXECUTED),
        _task(turns, "POP_SCOPE", "PopScope", 2, 9, EXECUTED),
    ]
    if fact_check_budget is None:
        parts.append(_task(turns, "FACT_CHECK_TURN_CLAIMS", "SkipTurnFactCheck", 2, CHECK, EXECUTED))
    else:
        nth = F.row_number().over(Window.partitionBy("transcript_id").orderBy(*C.claim_order()))
        checked = claims.filter("claim_type = 'empirical'").withColumn("_nth", nth)
        in_turn = checked.groupBy("transcript_id", "turn_index").agg(F.count("*").alias("_c"))
        asked = turns.select("transcript_id", "turn_index").join(in_turn, ["transcript_id", "turn_index"], "left")
        parts.append(_task(asked, "FACT_CHECK_TURN_CLAIMS", "FactCheckTurnClaims", 2, CHECK, F.when(F.col("_c").isNull(), FAILED).otherwise(DECOMPOSED)))
        parts.append(_task(checked, "FACT_CHECK_CLAIM", "FactCheckClaim", 3, CHECK, F.when(F.col("_nth") <= fact_check_budget, EXECUTED).otherwise(NO_METHOD), item=F.col("_nth"), message=F.col("claim_id")))
    return reduce(DataFrame.unionByName, parts)


def task_key(kind: Column, start: Column, end: Column, params: Column) -> Column:
    """A task's identity: type, span and parameters."""
    inner = F.substring(F.sha2(F.to_json(params), 256), 1, 16)
    return F.substring(F.sha2(F.to_json(F.struct(kind.alias("type"), F.array(start, end).alias("span"), inner.alias("params_hash"))), 256), 1, 24)


def deduplicated(listed: DataFrame, key: str = "dedup_key", order: str = "seq") -> DataFrame:
    """Tasks of a queue ``transcript_id, key, order, ...``: of equal ones the first; ``skipped`` tells the others."""
    nth = F.row_number().over(Window.partitionBy("transcript_id", key).orderBy(order))
    return listed.withColumn("skipped", nth > 1)


def within(listed: DataFrame, max_tasks: int = 1000, max_children: int = 50, max_depth: int = 12) -> DataFrame:
    """The tasks with ``kept`` and the reason of those cut: children beyond a parent's limit, or tasks beyond the total.

    Tasks without a method don't count. Cut parents take their children with them.
    """
    turn, item = Window.partitionBy("transcript_id"), Window.partitionBy("transcript_id", "turn_index", "child", F.when(F.col("child") == SEGMENT, F.col("part")))
    of = lambda depth, w, order: F.when(F.col("depth") == depth, F.sum((F.col("depth") == depth).cast("int")).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = listed.withColumn("n1", of(1, turn, ["turn_index", "child", "part", "item"])).withColumn("n2", of(2, Window.partitionBy("transcript_id", "turn_index"), ["child", "part", "item"])).withColumn("n3", of(3, item, ["item"]))
    rows = rows.withColumn("t1", F.max("n1").over(Window.partitionBy("transcript_id", "turn_index"))).withColumn("t2", F.max("n2").over(item))
    beyond = lambda c: F.coalesce(F.col(c) > max_children, F.lit(False))
    rows = rows.withColumn("trimmed", beyond("t1") | ((F.col("depth") >= 2) & beyond("t2")) | beyond("n3") | (F.col("depth") > max_depth))
    counted = ((F.col("outcome") != NO_METHOD) & ~F.col("trimmed")).cast("int")
    before = F.coalesce(F.sum(counted).over(turn.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("over", ~F.col("trimmed") & (before >= max_tasks))
    return rows.withColumn("kept", ~F.col("trimmed") & ~F.col("over")).drop("n1", "n2", "n3", "t1", "t2")


def trace(cut: DataFrame, backtracks: int = 20) -> DataFrame:
    """Events of the kept tasks of ``within``, in order, without clocks."""
    by = Window.partitionBy("transcript_id")
    kept = cut.filter("kept").withColumn("failure", F.sum((F.col("outcome") == FAILED).cast("int")).over(by.orderBy(*ORDER)))
    told = F.array_compact(F.array(
        F.when(F.col("outcome") != NO_METHOD, SELECTED), F.col("outcome"), F.when((F.col("outcome") == FAILED) & (F.col("failure") >= backtracks), SOFT),
    ))
    head = ["transcript_id", *ORDER, "task_type", "method_name", "depth"]
    events = kept.select(*head, F.posexplode(told).alias("step", "event_type"))
    # A parent whose children were cut tells so; a transcript that runs out of tasks ends with it.
    many = cut.filter("trimmed").select("transcript_id", F.when(F.col("depth") == 1, -1).otherwise(F.col("turn_index")).alias("turn_index"), F.when(F.col("depth") == 3, F.col("child")).otherwise(0).alias("child"),
                                        F.when((F.col("depth") == 3) & (F.col("child") == SEGMENT), F.col("part")).otherwise(0).alias("part"), "depth")
    many = many.groupBy("transcript_id", "turn_index", "child", "part").agg(F.min("depth").alias("d"))
    parents = kept.filter("item = 0").select(*head, F.lit(8).alias("step")).join(many, ["transcript_id", "turn_index", "child", "part"]).filter("depth = d - 1").drop("d").withColumn("event_type", F.lit(TRIMMED))
    last = cut.filter("over").groupBy("transcript_id").agg(F.lit(2**30).alias("turn_index"))
    ended = last.select("transcript_id", "turn_index", *(F.lit(0).alias(c) for c in ("child", "part", "item")), F.lit("DECOMPOSE_TRANSCRIPT").alias("task_type"), F.lit(None).cast("string").alias("method_name"), F.lit(0).alias("depth"), F.lit(9).alias("step"), F.lit(HARD).alias("event_type"))
    every = events.unionByName(parents.select(*events.columns)).unionByName(ended.select(*events.columns))
    seq = F.row_number().over(by.orderBy(*ORDER, "step"))
    return every.select("transcript_id", seq.alias("seq"), "event_type", "task_type", F.when(F.col("event_type") != NO_METHOD, F.col("method_name")).alias("method_name"), "depth", F.when(F.col("turn_index").between(0, 2**30 - 1), F.col("turn_index")).alias("turn_index"))


def diagnostics(cut: DataFrame, backtracks: int = 20) -> DataFrame:
    """``transcript_id, turn_index, diagnostic_type, task_type, severity, message`` of the kept tasks of ``within``."""
    by = Window.partitionBy("transcript_id")
    kept = cut.filter("kept").withColumn("failure", F.sum((F.col("outcome") == FAILED).cast("int")).over(by.orderBy(*ORDER)))
    turn = F.when(F.col("turn_index") >= 0, F.col("turn_index")).alias("turn_index")
    row = lambda rows, kind, severity, message: rows.select("transcript_id", turn, F.lit(kind).alias("diagnostic_type"), "task_type", F.lit(severity).alias("severity"), message.alias("message"))
    none = row(kept.filter(F.col("outcome") == NO_METHOD), "NO_APPLICABLE_METHOD", "error", F.concat(F.lit("No applicable method for "), "task_type", F.lit(": "), F.coalesce("message", F.lit(""))))
    soft = row(kept.filter((F.col("outcome") == FAILED) & (F.col("failure") >= backtracks)), "BACKTRACK_LIMIT", "warning", F.concat(F.lit("Backtrack limit reached at task "), "task_type"))
    over = cut.filter("over").groupBy("transcript_id").agg(F.min("turn_index").alias("turn_index")).withColumn("task_type", F.lit("DECOMPOSE_TRANSCRIPT"))
    return none.unionByName(soft).unionByName(row(over, HARD, "error", F.lit("Hard budget exceeded: TASK_LIMIT")))


def stats(cut: DataFrame) -> DataFrame:
    """``transcript_id, tasks_executed, backtracks, success`` of the tasks of ``within``."""
    kept = F.col("kept")
    n = lambda c: F.sum(c.cast("int")).cast("long")
    return cut.groupBy("transcript_id").agg(n(kept & (F.col("outcome") != NO_METHOD)).alias("tasks_executed"), n(kept & (F.col("outcome") == FAILED)).alias("backtracks"), (~F.max("over")).alias("success"))


def events_of(events: DataFrame, event_type: str | None = None, task_type: str | None = None) -> DataFrame:
    """Events of one kind, of one task type, or both."""
    rows = events if event_type is None else events.filter(F.col("event_type") == event_type)
    return rows if task_type is None else rows.filter(F.col("task_type") == task_type)


def trace_documents(events: DataFrame) -> DataFrame:
    """(transcript_id, document): a transcript's events as one JSON array, in order."""
    entry = F.struct("seq", F.struct("event_type", "task_type", "method_name", "depth", "turn_index").alias("e"))
    return events.groupBy("transcript_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"])).alias("document"))
