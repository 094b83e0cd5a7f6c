"""The engine: turns in, a bundle of lazy tables out; and the stage registry that extends it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import claims as C
from lectern.operators import coreference as R
from lectern.operators import documents as D
from lectern.operators import facts as K
from lectern.operators import reports as P
from lectern.operators import rhetoric as H
from lectern.operators import tasks as Q
from lectern.sources import transcripts as S


@dataclass(frozen=True)
class Analysis:
    """Everything is lazy; an output that isn't read costs nothing.

    Claims and tasks are kept once they are made, since most outputs read them; ``release`` lets them go.
    """

    turns: DataFrame
    claims: DataFrame
    frames: DataFrame
    references: DataFrame
    entities: DataFrame
    fact_checks: DataFrame | None
    diagnostics: DataFrame
    stats: DataFrame
    trace: DataFrame
    fallacies: DataFrame
    tasks: DataFrame

    def release(self) -> None:
        for kept in (self.claims, self.tasks):
            kept.unpersist()

    def overview(self) -> DataFrame:
        return P.overview(self.turns, self.claims, self.fallacies, self.fact_checks)

    def documents(self) -> DataFrame:
        return D.analysis_documents(self.claims, self.frames, self.fact_checks, self.stats)


Stage = Callable[[DataFrame], DataFrame]
_STAGES: dict[str, list[tuple[float, str, Stage]]] = {}


def stage(name: str, task: str, cost: float = 1.0) -> Callable[[Stage], Stage]:
    """Register a DataFrame stage for a task; ``run_stage`` takes the cheapest, the first of equals."""

    def add(f: Stage) -> Stage:
        _STAGES.setdefault(task, []).append((cost, name, f))
        return f

    return add


def stages_for(task: str) -> list[str]:
    return [name for _, name, _ in sorted(_STAGES.get(task, []), key=lambda s: s[0])]


def registered_tasks() -> list[str]:
    return sorted(_STAGES)


def clear_stages() -> None:
    _STAGES.clear()


def run_stage(task: str, rows: DataFrame) -> DataFrame:
    if task not in _STAGES:
        raise LookupError(f"No applicable method for {task}")
    return rows.transform(min(_STAGES[task], key=lambda s: s[0])[2])


def _through(task: str, rows: DataFrame) -> DataFrame:
    """The rows after the cheapest stage registered for a task, if there is one."""
    return run_stage(task, rows) if task in _STAGES else rows


def _in_budget(rows: DataFrame, cut: DataFrame, task: str, **places: str) -> DataFrame:
    """Rows whose task is kept; ``places`` name the tasks' order columns that tell them apart."""
    done = cut.filter((F.col("task_type") == task) & F.col("kept")).select("transcript_id", "turn_index", *(F.col(c).alias(f"_{c}") for c in places))
    marked = rows.select("*", *(F.expr(e).alias(f"_{c}") for c, e in places.items()))
    return marked.join(done, ["transcript_id", "turn_index", *(f"_{c}" for c in places)], "left_semi").select(*rows.columns)


def analyze_turns(turns: DataFrame, responses: DataFrame | None = None, answers: DataFrame | None = None, budgets: K.Budgets = K.Budgets(), classifier=None, checker=None) -> Analysis:
    """Analyse ``transcript_id, turn_index, speaker, text, span``.

    Clients come as tables of answers, or as callables that ``K.answers_by`` runs: ``classifier()`` gives a
    function from a text to (claim_type, confidence, reasoning), ``checker()`` one to (status, confidence,
    source, sources, urls). Stages registered for CLAIMS, FRAMES, REFERENCES and FACT_CHECKS have the last
    word on these tables.
    """
    every, cut = turns, None
    if budgets.strict:
        cut = Q.within(Q.tasks(every), budgets.max_tasks, budgets.max_children, budgets.max_depth).persist()
        turns = _in_budget(turns, cut, "PROCESS_TURN")
    found = C.claims(turns)
    if cut is not None:
        found = _in_budget(found, cut, "EXTRACT_ATOMIC_CLAIM", part="segment_index", item="sentence_index + 1")
    if classifier is not None:
        answers = K.answers_by(found, classifier, "text", "claim_type string, confidence double, reasoning string")
    if answers is not None:
        found = C.with_answers(found, answers, budgets.max_llm_calls)
    found = _through("CLAIMS", found).persist()
    checked = None
    if checker is not None:
        asked = K.checkable_in_order(found).filter(F.col("nth") <= budgets.fact_check_budget)
        responses = K.answers_by(asked, checker, "key", "status string, confidence double, source string, sources array<string>, urls array<string>").withColumn("key_order", F.lit(0))
    if responses is not None:
        checked = _through("FACT_CHECKS", K.fact_checks(found, responses, budgets.fact_check_budget))
    listed = Q.tasks(every, found, None if responses is None else budgets.fact_check_budget)
    done = Q.within(listed, budgets.max_tasks, *((budgets.max_children, budgets.max_depth) if budgets.strict else (2**30, 2**30))).persist()
    frames, resolved = C.frames(turns, found), R.resolutions(turns, found)
    if cut is not None:
        frames = _in_budget(frames, cut, "BUILD_ARGUMENT_FRAME")
        resolved = _in_budget(resolved, cut, "RESOLVE_REFERENCE", item="span.start + 1")
    shown = done if budgets.strict else done.withColumn("kept", F.lit(True))
    return Analysis(
        turns, found, _through("FRAMES", frames), _through("REFERENCES", resolved), R.entities(turns, found), checked,
        Q.diagnostics(shown, budgets.backtracks), K.stats(done, turns, found, budgets, checked), Q.trace(shown, budgets.backtracks), H.fallacies(turns), done,
    )


def analyze(transcripts: DataFrame, **options) -> Analysis:
    """Analyse raw transcripts ``transcript_id, text``."""
    return analyze_turns(S.from_transcripts(transcripts), **options)
