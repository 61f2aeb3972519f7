"""Verification of evaluation reports: nothing a report says of itself is believed.

Every report is compared with the run's configuration and with the call that made it, and its verdict is computed again from the
marks of its attempts, within its nested arrays: no marks are exploded. A report that only has a strong stage must reuse a weak run
that was verified earlier in its round, so a round's evaluations are folded in their order, carrying the paths verified so far; a
round has a few evaluations (its budget bounds them).

evals: paper, round, seq, mode, path, exit_code, inside, created (the path lies in the paper's folder; the call made it), the
candidate's question_hash, legacy_hash, input_sha1 and weights (null for a rubric that cannot be scored), and report, a struct of
models (map role -> name), prompts_dir, config_sha1, weak_source, error, question_hash, input_sha1, acceptance (map), n_attempts,
weak_attempts and strong_attempts (arrays of struct error, satisfied), weak_passed, strong_passed, gap_passed, all_passed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rubric as H

# The models that a report names, and the flags of a verdict.
ROLES = ("weak_solver", "strong_solver", "judge")
FLAGS = ("weak_passed", "strong_passed", "gap_passed", "all_passed")


@dataclass(frozen=True)
class Expected:
    """What the run was configured with. Null in a report means that it does not say."""

    models: dict[str, str]
    prompts_dir: str
    config_sha1: str | None
    acceptance: dict[str, str] = field(default_factory=dict)
    n_attempts: int = 3


def attempt_points(weights: Column, attempt: Column) -> Column:
    """Clipped points of an attempt by its marks; null if it failed or its marks are not whole."""
    scored = H.score_arrays(weights, attempt["satisfied"])
    points = F.greatest(F.lit(0).cast("long"), F.least(scored["max_positive"], scored["earned"] - scored["penalty"]))
    return F.when(attempt["error"].isNull() & scored.isNotNull(), points)


def recomputed(evals: DataFrame, preset: H.Preset) -> DataFrame:
    """Adds the stages' totals and verdict by the marks, and ``broken``: whether an attempt's marks could not be scored."""
    w, r = F.col("weights"), F.col("report")
    rows = evals.withColumn("max_positive", F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.greatest(x, F.lit(0)).cast("long")))
    empty = F.array().cast("array<bigint>")
    broken = F.col("weights").isNull()
    for role in ("weak", "strong"):
        rows = rows.withColumn(f"{role}_points", F.coalesce(F.transform(r[f"{role}_attempts"], lambda a: attempt_points(w, a)), empty))
        broken = broken | F.exists(f"{role}_points", lambda p: p.isNull())
    rows = rows.withColumn("broken", F.coalesce(broken, F.lit(False)))
    for role in ("weak", "strong"):
        p, n = F.col(f"{role}_points"), F.size(f"{role}_points")
        there = (n > 0) & ~F.col("broken")
        rows = rows.withColumns({
            f"{role}_attempts": n, f"{role}_n": F.when(there, n), f"{role}_total": F.when(there, F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x)),
            f"{role}_top": F.when(there, F.array_max(p)), f"{role}_least": F.when(there, F.array_min(p)),
        })
    return H.assess(rows, preset)


def own_problems(e: Expected) -> Column:
    """What is wrong with a report by itself, in a fixed order; reports that only reuse a weak stage are looked at afterwards."""
    r = F.col("report")
    says = lambda c, want: F.coalesce(c != F.lit(want), F.lit(False)) if want is not None else F.lit(False)
    differs = [F.when(says(r["models"][role], e.models[role]), F.lit(f"{role} model")) for role in ROLES]
    accepted = F.lit(False)
    for k, v in e.acceptance.items():
        accepted = accepted | ~r["acceptance"][k].eqNullSafe(F.lit(v))
    known = F.coalesce(r["question_hash"].isin(F.col("question_hash"), F.col("legacy_hash")), F.lit(False))
    length = lambda role: F.when((F.col(f"{role}_attempts") > 0) & (F.col(f"{role}_attempts") != e.n_attempts) & ~F.col("broken"), F.lit(f"{role} attempts"))
    # A stage that is missing counts as not passed where a report says something of it.
    contradicts = [F.when(~F.col("broken") & r[k].isNotNull() & (r[k] != F.coalesce(F.col(k), F.lit(False))), F.lit(f"verdict {k}")) for k in FLAGS]
    return F.array_compact(
        F.array(
            *differs,
            F.when(says(r["prompts_dir"], e.prompts_dir), F.lit("prompts_dir")),
            F.when(says(r["config_sha1"], e.config_sha1), F.lit("config")),
            F.when(~F.coalesce("inside", F.lit(False)), F.lit("path outside")),
            F.when(~F.coalesce("created", F.lit(False)), F.lit("path not of this call")),
            F.when(~F.col("exit_code").eqNullSafe(0), F.lit("exit code")),
            F.when(F.coalesce(r["error"], F.lit("")) != "", F.lit("evaluator error")),
            F.when(~known, F.lit("question_hash")),
            F.when(F.coalesce(r["input_sha1"] != F.col("input_sha1"), F.lit(False)), F.lit("input_sha1")),
            F.when(accepted, F.lit("acceptance")),
            F.when(~r["n_attempts"].eqNullSafe(F.lit(e.n_attempts)), F.lit("n_attempts")),
            length("weak"),
            length("strong"),
            F.when(F.col("broken"), F.lit("recomputation")),
            *contradicts,
        )
    )


def verified(evals: DataFrame, expected: Expected, preset: H.Preset) -> DataFrame:
    """One row per evaluation: paper, round, seq, mode, problems (array), warnings (array), verified, and the verdict by the marks."""
    rows = recomputed(evals, preset).withColumn("problems", own_problems(expected))
    odd = F.when(~F.coalesce(H.weights_in_bounds(F.col("weights")), F.lit(False)), F.lit("weights out of bounds"))
    rows = rows.withColumn("warnings", F.array_compact(F.array(odd)))
    r, verdict = F.col("report"), ["weak_n", "weak_total", "strong_n", "strong_total", "max_positive", *FLAGS]
    one = F.struct("seq", "mode", "path", "question_hash", "legacy_hash", F.col("report.weak_source").alias("source"), (F.size(F.coalesce(r["weak_attempts"], F.array())) > 0).alias("has_weak"), "problems", "warnings", *verdict)
    folded = rows.groupBy("paper", "round").agg(F.array_sort(F.collect_list(one)).alias("evals"))

    def step(done: Column, e: Column) -> Column:
        """``done``: the evaluations so far with their whole problems."""
        reuses = F.exists(done, lambda d: (F.size(d["problems"]) == 0) & d["has_weak"] & (d["path"] == e["source"]) & d["question_hash"].isin(e["question_hash"], e["legacy_hash"]))
        lacks = (e["mode"] == "strong-only") & ~F.coalesce(reuses, F.lit(False))
        return F.concat(done, F.array(e.withField("problems", F.when(lacks, F.concat(e["problems"], F.array(F.lit("weak provenance")))).otherwise(e["problems"]))))

    checked = folded.select("paper", "round", F.explode(F.aggregate("evals", F.slice("evals", 1, 0), step)).alias("e"))
    return checked.select("paper", "round", "e.seq", "e.mode", "e.problems", "e.warnings", (F.size("e.problems") == 0).alias("verified"), *[F.col(f"e.{c}") for c in verdict])
