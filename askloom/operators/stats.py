"""Run statistics. Values stay unrounded; rounding belongs to the printed report."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table1(items: DataFrame) -> DataFrame:
    """items: weak_avg, strong_avg, gap, accepted_round, question_chars, n_rubric_items of accepted papers -> one row."""
    return items.agg(
        F.count("*").alias("n"),
        F.avg("weak_avg").alias("weak_solver_avg"),
        F.avg("strong_avg").alias("strong_solver_avg"),
        F.avg("gap").alias("gap"),
        F.avg("accepted_round").alias("rounds_mean"),
        F.median("accepted_round").alias("rounds_median"),
        F.max(F.coalesce("accepted_round", F.lit(0))).alias("rounds_max"),
        F.avg("question_chars").alias("question_length_chars"),
        F.avg("n_rubric_items").alias("rubric_items"),
    )


def tokens(runs: DataFrame, paths: dict[str, Column]) -> DataFrame:
    """Sums of optional counters, missing as 0."""
    return runs.agg(*[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(n) for n, c in paths.items()])


def boolean_counts(runs: DataFrame, mismatch: Column, errors: Column, guardrails: Column) -> DataFrame:
    """Explicitly false claims, papers with errors, guardrail events."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return runs.agg(F.count_if(mismatch.eqNullSafe(False)).alias("agent_claim_mismatches"), F.count_if(n(errors) > 0).alias("papers_with_errors"), F.sum(n(guardrails)).alias("guardrail_events"))


def usage_totals(requests: DataFrame, key: str, usage: str) -> DataFrame:
    """Sum of usage maps per key and counter, failed tries included."""
    return requests.select(key, F.explode(usage).alias("counter", "n")).groupBy(key, "counter").agg(F.sum("n").alias("n"))


def nested_blocks(runs: DataFrame) -> DataFrame:
    """The baseline's three blocks (all evaluated, verified, through the last filter) in one pass.

    runs: weak_avg, strong_avg, gap, errors (array), qv_passed, final_filter_passed, question_chars, n_rubric_items, criteria_passed.
    """
    evaluated = F.col("weak_avg").isNotNull() & F.col("strong_avg").isNotNull() & (F.coalesce(F.size("errors"), F.lit(0)) == 0)
    blocks = F.array_compact(
        F.array(F.lit("all_evaluated"), F.when(F.col("qv_passed"), F.lit("qv_passed")), F.when(F.col("final_filter_passed"), F.lit("final_filter_passed")))
    )
    rows = runs.where(evaluated).withColumn("block", F.explode(blocks))
    return rows.groupBy("block").agg(
        F.count("*").alias("n"),
        F.avg("weak_avg").alias("weak_solver_avg"),
        F.avg("strong_avg").alias("strong_solver_avg"),
        F.avg("gap").alias("gap"),
        F.avg("question_chars").alias("question_length_chars"),
        F.avg("n_rubric_items").alias("rubric_items"),
        F.avg(F.coalesce("criteria_passed", F.lit(False)).cast("int")).alias("would_pass_solver_criteria"),
    )


def accepted_items(papers: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One row per accepted paper: paper, accepted_round, final_accepted, the round's weak_avg, strong_avg, gap, scores_source,
    scores_report, qv_bound, question_chars, n_rubric_items. papers: as of ``rounds.paper_rows``; reports: as of
    ``runs.accepted_report`` (paper, its averages, scores_source, scores_report), which stand above the round's own scores."""
    index = F.col("accepted_round")
    at = F.when((index > 0) & (index <= F.size("rounds")), F.element_at("rounds", index.cast("int")))
    rows = papers.where("accepted").select(F.col("paper_id").alias("paper"), "accepted_round", "final_accepted", at.alias("r"))
    own = rows.select("paper", "accepted_round", "final_accepted", *[F.col(f"r.{c}").alias(c) for c in ("weak_avg", "strong_avg", "gap", "qv_bound", "question_chars", "n_rubric_items")])
    if reports is None:
        return own.withColumns({"scores_source": F.lit("summary"), "scores_report": F.lit(None).cast("string")})
    better = reports.where("scores_source = 'report'").select(F.col("paper").alias("b_paper"), *[F.col(c).alias(f"b_{c}") for c in ("weak_avg", "strong_avg", "gap")], F.col("scores_report").cast("string").alias("scores_report"))
    met = own.join(better, F.col("paper") == F.col("b_paper"), "left")
    has = F.col("b_paper").isNotNull()
    return met.withColumns({c: F.when(has, F.col(f"b_{c}")).otherwise(F.col(c)) for c in ("weak_avg", "strong_avg", "gap")}).withColumn("scores_source", F.when(has, "report").otherwise("summary")).drop("b_paper", "b_weak_avg", "b_strong_avg", "b_gap")


#: Columns of runs that older tables lack, with their types.
OPTIONAL = {"qv_bound": "boolean", "scores_source": "string", "subagent_prompt_tokens": "long", "subagent_completion_tokens": "long", "wall_time_s": "double"}


def agentic_report(runs: DataFrame, rounds: DataFrame) -> DataFrame:
    """The whole report on runs as one table (section, name, value): papers, the accepted ones' averages, failed rounds, tokens.

    runs: paper, accepted, final_accepted, n_rounds, stop_reason, claim_matches, errors (array), guardrails (array), prompt_tokens,
    completion_tokens, weak_avg, strong_avg, gap, accepted_round, question_chars, n_rubric_items (scores of accepted papers) and, if
    there, qv_bound (of the accepted round), scores_source, tokens of subagents, wall_time_s; rounds: paper, failure_mode.
    """
    runs = runs.withColumns({c: F.lit(None).cast(t) for c, t in OPTIONAL.items() if c not in runs.columns})
    won = F.coalesce("accepted", F.lit(False))
    source = F.coalesce("scores_source", F.lit("summary"))
    backing = runs.agg(F.count_if(won & (source == "report")).alias("report_backed"), F.count_if(won & (source == "summary")).alias("summary_backed"), F.count_if(won & F.col("qv_bound").eqNullSafe(False)).alias("qv_unbound"))
    value = lambda c: c.cast("double").alias("value")
    wide = lambda section, row: row.unpivot([], row.columns, "name", "value").select(F.lit(section).alias("section"), "name", value(F.col("value")))
    doubles = lambda df: df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    papers = runs.agg(F.count("*").alias("papers"), F.count_if("accepted").alias("accepted"), F.count_if("final_accepted").alias("final_accepted"), F.avg("n_rounds").alias("rounds_per_paper"), F.try_divide(F.count_if("accepted").cast("double"), F.nullif(F.count("*").cast("double"), F.lit(0.0))).alias("acceptance_rate"))
    shared = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a handful of modes
    modes = rounds.where("failure_mode <> 'ACCEPTED'").groupBy("failure_mode").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(shared))
    stops = runs.groupBy(F.coalesce("stop_reason", F.lit("<none>")).alias("name")).agg(F.count("*").alias("n"))
    out = [
        wide("papers", doubles(papers)),
        wide("accepted", doubles(table1(runs.where("accepted")))),
        wide("final", doubles(table1(runs.where("final_accepted")))),
        wide("tokens", doubles(tokens(runs, {"prompt": F.col("prompt_tokens"), "completion": F.col("completion_tokens"), "subagents_prompt": F.col("subagent_prompt_tokens"), "subagents_completion": F.col("subagent_completion_tokens")}))),
        wide("backing", doubles(backing)),
        wide("time", doubles(runs.agg(F.avg("wall_time_s").alias("wall_time_mean_s")))),
        wide("checks", doubles(boolean_counts(runs, F.col("claim_matches"), F.col("errors"), F.col("guardrails")))),
        modes.select(F.lit("failed_rounds").alias("section"), F.col("failure_mode").alias("name"), value(F.col("n"))),
        modes.select(F.lit("failed_share").alias("section"), F.col("failure_mode").alias("name"), value(F.col("share"))),
        stops.select(F.lit("stop_reasons").alias("section"), "name", value(F.col("n"))),
    ]
    return functools.reduce(DataFrame.unionByName, out)
