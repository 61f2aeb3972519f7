"""Entry points: build a corpus, evaluate candidates, replay loops, summarise runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .operators import corpus as C
from .operators import messages as M
from .operators import rubric as H
from .operators import runs as N
from .operators import stats as S
from .streaming import loop as L


def build_corpus(records: DataFrame, metadata: DataFrame, filters: C.Filters, n: int, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows up to the n-th kept one, tally per shard) of a release in stream order; resumes after ``existing`` ids."""
    already = 0 if existing is None else existing.count()
    rows = C.cut_at(C.look_up(C.classify(records, filters, existing), metadata, filters), n, already)
    return rows.where("outcome = 'kept'"), C.tally(rows)


def evaluate(marks: DataFrame, preset: H.Preset, force_strong: bool = True) -> DataFrame:
    """marks (candidate, role, attempt, weight, satisfied) -> verdicts and reasons."""
    return H.assess(H.stages(H.weak_first(H.score_marks(marks), preset, force_strong)), preset)


def run_loop(events: DataFrame) -> DataFrame:
    """Decisions for recorded loop events, batch or stream."""
    return L.replay_stream(events) if events.isStreaming else L.replay(events)


def summarise(summaries: DataFrame, requested: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cohort counts and rates, table of means over accepted papers) of the newest summary of each paper.

    summaries: paper, finished_at, path, completed, accepted, accepted_round, weak_avg, strong_avg, gap, question_chars, n_rubric_items.
    """
    is_number = F.lit(not isinstance(summaries.schema["finished_at"].dataType, StringType))
    newest = N.newest(summaries, "paper", summaries["finished_at"], "path", is_number)
    return N.cohort(newest, requested), S.table1(newest.where("accepted"))


def inspect(rounds: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One line per paper: rounds with their failure modes, acceptance, guardrail events."""
    return M.paper_summaries(rounds, events)


def baseline(marks: DataFrame, checks: DataFrame, preset: H.Preset) -> tuple[DataFrame, DataFrame]:
    """(one row per candidate, the three blocks of the report) of a single-shot run: both solvers always, no loop.

    marks as in :func:`evaluate`; checks: candidate, qv_passed, context_ok, rubric_ok, question_chars, n_rubric_items, errors (array).
    """
    verdicts = H.assess(H.stages(H.score_marks(marks)), preset)
    mean = lambda role: F.col(f"{role}_total").cast("double") / (F.col(f"{role}_n") * F.col("max_positive")).cast("double")
    rows = checks.join(verdicts, "candidate", "left").withColumns({"weak_avg": mean("weak"), "strong_avg": mean("strong")})
    passed = F.coalesce("qv_passed", F.lit(False))
    rows = rows.withColumns({"gap": F.col("strong_avg") - F.col("weak_avg"), "criteria_passed": F.coalesce("all_passed", F.lit(False)), "final_filter_passed": passed & F.col("context_ok") & F.col("rubric_ok"), "would_be_accepted": passed & F.coalesce("all_passed", F.lit(False))})
    return rows, S.nested_blocks(rows)


def readjudicate(rounds: DataFrame, summaries: DataFrame, reports: DataFrame, withdrawn: list[str]) -> DataFrame:
    """Summaries after papers were accepted that only withdrawn checks had refused."""
    return N.readjudicated(rounds, summaries, reports, withdrawn)


def report(runs: DataFrame, rounds: DataFrame) -> DataFrame:
    """All figures on runs and their rounds as (section, name, value)."""
    return S.agentic_report(runs, rounds)
