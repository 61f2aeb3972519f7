"""Run summaries and reports: newest of each paper, cohorts, provenance, reuse, repair and resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import epoch_seconds


def newest(rows: DataFrame, key: str, finished: Column, path: str, is_number: Column | None = None) -> DataFrame:
    """The newest row of each key; ties go to the later path, unreadable times are oldest."""
    everything = F.struct(*rows.columns)
    at = epoch_seconds(finished.cast("string"), is_number)
    return rows.groupBy(key).agg(F.max_by(everything, F.struct(at, path)).alias("r")).select("r.*")


def usable_directory(name: Column) -> Column:
    return ~name.startswith("_") & ~name.contains(".old.")


def skipped_locked(log: DataFrame, runs: DataFrame) -> DataFrame:
    """Papers whose latest log record, or whose run, says skipped = 'locked'. log: paper, line, skipped; runs: paper, skipped."""
    latest = log.groupBy("paper").agg(F.max_by("skipped", "line").alias("skipped"))
    locked = F.col("skipped") == "locked"
    return latest.where(locked).select("paper").union(runs.where(locked).select("paper")).distinct()


def pending_directories(directories: DataFrame) -> DataFrame:
    """directories: directory, has_summary -> the workspaces that were begun and have no summary yet."""
    name = F.col("directory")
    return directories.where(usable_directory(name) & ~name.startswith(".") & ~F.coalesce("has_summary", F.lit(False)))


def cohort(runs: DataFrame, requested: DataFrame | None, directories: DataFrame | None = None) -> DataFrame:
    """Counts and rates of runs (paper, completed, accepted), restricted to the requested papers if there is a manifest.

    Without one, only the ``directories`` without a summary tell what is pending.
    """
    if requested is None:
        rows = runs.withColumn("present", F.lit(True))
        if directories is not None:
            begun = pending_directories(directories).select(F.lit(None).cast(runs.schema["paper"].dataType).alias("paper"), F.lit(None).cast("boolean").alias("completed"), F.lit(None).cast("boolean").alias("accepted"), F.lit(False).alias("present"))
            rows = rows.select("paper", "completed", "accepted", "present").unionByName(begun)
    else:
        rows = requested.select("paper").distinct().join(runs.withColumn("present", F.lit(True)), "paper", "left")
    present = F.coalesce("present", F.lit(False))
    done, accepted = present & F.coalesce("completed", F.lit(True)), present & F.coalesce("accepted", F.lit(False))
    g = rows.agg(
        F.count("*").alias("n_requested"),
        F.count_if(present).alias("n_runs"),
        F.count_if(done).alias("n_completed"),
        F.count_if(accepted).alias("n_accepted"),
        F.count_if(accepted & done).alias("n_accepted_completed"),
    )
    part = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    return g.select(
        "n_requested",
        "n_completed",
        (F.col("n_runs") - F.col("n_completed")).alias("n_incomplete"),
        (F.col("n_requested") - F.col("n_runs")).alias("n_pending"),
        part("n_accepted", "n_runs").alias("acceptance_rate"),
        part("n_accepted_completed", "n_completed").alias("acceptance_rate_completed"),
        part("n_accepted", "n_requested").alias("acceptance_rate_cohort"),
    )


def accepted_report(rounds: DataFrame, reports: DataFrame) -> DataFrame:
    """The earliest accepting report of each accepted round, matched by either of its two hashes, else the round's own scores.

    rounds: paper, hash, legacy_hash, weak_avg, strong_avg, gap; reports: paper, question_hash, all_passed, started, path and scores.
    """
    keys = rounds.select("paper", F.explode(F.array_distinct(F.array_compact(F.array("hash", "legacy_hash")))).alias("question_hash"))
    fine = reports.where("all_passed AND started IS NOT NULL").join(keys, ["paper", "question_hash"], "left_semi")
    first = fine.groupBy("paper").agg(F.min_by(F.struct("path", "weak_avg", "strong_avg", "gap"), F.struct("started", "path")).alias("r"))
    pick = lambda c: F.when(F.col("r").isNotNull(), F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    source = F.when(F.col("r").isNotNull(), "report").otherwise("summary")
    return rounds.join(first, "paper", "left").select("paper", pick("weak_avg"), pick("strong_avg"), pick("gap"), source.alias("scores_source"), F.col("r.path").alias("scores_report"))


PROVENANCE = ["acceptance", "eval", "models", "prompts_dir", "config_sha1"]


def reusable_weak(wanted: DataFrame, reports: DataFrame, n_attempts: int = 3) -> DataFrame:
    """The latest compatible weak stage for each wanted question; incompatible newer runs are skipped.

    wanted: paper, question_hash, legacy_hash and PROVENANCE; reports: paper, run_no, mode, question_hash,
    question_hash_canonical, PROVENANCE, n_weak, weak_error. Equality of provenance is null-safe.
    """
    ids = wanted.select("paper", *PROVENANCE, F.explode(F.array_distinct(F.array_compact(F.array("question_hash", "legacy_hash")))).alias("h")).alias("w")
    r = reports.where(F.col("mode").isin("weak-only", "both") & (F.col("n_weak") == n_attempts) & F.col("weak_error").isNull())
    r = r.withColumn("h", F.explode(F.array_distinct(F.array_compact(F.array("question_hash", "question_hash_canonical"))))).alias("r")
    same = (F.col("r.paper") == F.col("w.paper")) & (F.col("r.h") == F.col("w.h"))
    for c in PROVENANCE:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"w.{c}"))
    return r.join(ids, same).groupBy(F.col("w.paper").alias("paper")).agg(F.max("r.run_no").alias("run_no"))


def report_problems(reports: DataFrame, expected: DataFrame, key: str, checks: list[str], optional: list[str] | None = None) -> DataFrame:
    """``reports`` with an array of the columns that differ from what is expected for their key; an ``optional`` one may be null."""
    e = expected.select(key, *[F.col(c).alias(f"_{c}") for c in checks])
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"_{c}")) & (F.col(c).isNotNull() if c in (optional or []) else F.lit(True))
    problems = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in checks]))
    return reports.join(e, key, "left").withColumn("problems", problems).drop(*[f"_{c}" for c in checks])


def same_candidate(a: str, b: str) -> Column:
    """Whether two candidate structs agree in context, question and rubric, nulls included."""
    return F.col(f"{a}.context").eqNullSafe(F.col(f"{b}.context")) & F.col(f"{a}.question").eqNullSafe(F.col(f"{b}.question")) & F.col(f"{a}.rubric").eqNullSafe(F.col(f"{b}.rubric"))


def claim_matches(present: Column, claimed: Column, accepted_round: Column) -> Column:
    """Whether an agent's claim agrees with the verified round; null without a claim file."""
    return F.when(present, claimed.eqNullSafe(accepted_round))


def agentic_done(accepted: Column, qv_completed: Column, completed: Column, errors: Column, stop_reason: Column) -> Column:
    """Whether a finished paper needs no rerun."""
    clean = F.coalesce(completed, F.lit(False)) & (F.coalesce(F.size(errors), F.lit(0)) == 0) & ~F.coalesce(stop_reason.isin("error", "crashed"), F.lit(False))
    return (F.coalesce(accepted, F.lit(False)) & F.coalesce(qv_completed, F.lit(False))) | clean


def needs_final_qv(accepted: Column, final_qv_present: Column, qv_completed: Column, final_qv: bool = True) -> Column:
    """Whether an accepted paper lacks a finished last verification."""
    lacking = F.when(final_qv_present, qv_completed.eqNullSafe(False)).otherwise(F.lit(final_qv))
    return F.coalesce(accepted, F.lit(False)) & lacking


def baseline_needs_repair(frozen_matches: Column, qv_incomplete: Column, weak_incomplete: Column, strong_incomplete: Column) -> Column:
    return frozen_matches & (qv_incomplete | weak_incomplete | strong_incomplete)


def qualifying_rounds(rounds: DataFrame, withdrawn: list[str]) -> DataFrame:
    """Last rounds that pass everything and were refused only for checks since withdrawn.

    rounds: paper, round, qv_passed, weak_passed, strong_passed, gap_passed, problems (array), binding (boolean).
    """
    last = F.max("round").over(Window.partitionBy("paper"))
    passes = F.col("qv_passed") & F.col("weak_passed") & F.col("strong_passed") & F.col("gap_passed")
    excused = F.size(F.array_except("problems", F.array(*map(F.lit, withdrawn)))) == 0
    refused = (F.size("problems") > 0) | F.col("binding")
    first = F.min(F.when(F.coalesce(passes & excused & refused, F.lit(False)), F.col("round"))).over(Window.partitionBy("paper"))
    rows = rounds.withColumn("last", last).withColumn("first", first).where("round = first AND round = last")
    reason = F.when(F.col("binding"), "qv_binding_withdrawn").otherwise(F.concat(F.lit("withdrawn_report_checks:"), F.array_join(F.array_sort("problems"), ",")))
    return rows.select("paper", "round", reason.alias("reason"))


def readjudicated(rounds: DataFrame, summaries: DataFrame, reports: DataFrame, withdrawn: list[str]) -> DataFrame:
    """Summaries with refused papers accepted whose last round passed everything and was refused only for checks since withdrawn.

    summaries: paper, accepted, accepted_round, claimed_round; reports: paper, run, candidate, all_passed, error; rounds also has the
    candidate. A paper qualifies if an accepting report without an error is about its round's candidate; the first run counts.
    """
    fine = reports.where("all_passed AND error IS NULL").select("paper", "run", "candidate")
    last = qualifying_rounds(rounds, withdrawn).join(rounds.select("paper", "round", "candidate"), ["paper", "round"])
    found = last.join(fine, (last["paper"] == fine["paper"]) & last["candidate"].eqNullSafe(fine["candidate"])).groupBy(last["paper"].alias("of")).agg(F.min(F.struct("run", "round", "reason")).alias("x"))
    changed = ~F.coalesce("accepted", F.lit(False)) & F.col("x").isNotNull()
    out = summaries.join(found, F.col("paper") == F.col("of"), "left")
    return out.select(
        "paper",
        (F.coalesce("accepted", F.lit(False)) | changed).alias("accepted"),
        F.when(changed, F.col("x.round")).otherwise(F.col("accepted_round")).alias("accepted_round"),
        F.when(changed, F.col("claimed_round").eqNullSafe(F.col("x.round"))).alias("claim_matches"),
        F.when(changed, F.col("x.reason")).alias("reason"),
        F.when(changed, F.col("x.run")).alias("report"),
    )


def usable_previous(papers: DataFrame, summaries: DataFrame, done: Column, retry_errors: bool) -> DataFrame:
    """papers (paper) with whether an earlier summary can be resumed from: one is there and, where errors are retried, is done."""
    there = summaries.select(F.col("paper").alias("of"), F.coalesce(done, F.lit(False)).alias("done"))
    usable = F.col("of").isNotNull() & (F.col("done") if retry_errors else F.lit(True))
    return papers.join(there, F.col("paper") == F.col("of"), "left").select("paper", usable.alias("usable"), F.coalesce("done", F.lit(False)).alias("done"))


def run_plan(papers: DataFrame, summaries: DataFrame, done: Column, repair: Column, locked: DataFrame, drained: bool = False) -> DataFrame:
    """What a run does with each paper: drained, locked, resume, repair, rerun (its work is archived first) or run; in this order."""
    there = summaries.select(F.col("paper").alias("of"), F.coalesce(done, F.lit(False)).alias("done"), F.coalesce(repair, F.lit(False)).alias("repair"))
    held = locked.select(F.col("paper").alias("held")).distinct()
    rows = papers.select("paper").distinct().join(there, F.col("paper") == F.col("of"), "left").join(held, F.col("paper") == F.col("held"), "left")
    action = F.when(F.lit(drained), "drained").when(F.col("held").isNotNull(), "locked").when(F.col("repair"), "repair").when(F.col("done"), "resume").when(F.col("of").isNotNull(), "rerun").otherwise("run")
    return rows.select("paper", action.alias("action"))


def new_runs(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Run directories that are there now and were not before."""
    return after.join(before.select(*keys), keys, "left_anti")


def next_run(existing: DataFrame, key: str, run_no: str = "run_no") -> DataFrame:
    """The next run number of each key: the largest so far plus one."""
    return existing.groupBy(key).agg((F.coalesce(F.max(run_no), F.lit(0)) + 1).alias("next_run")).withColumn("run_name", F.format_string("run_%03d", "next_run"))


def changed_texts(now: DataFrame, stored: DataFrame) -> DataFrame:
    """Papers whose rendered text differs from what was stored (paper, text_sha1); new ones count. now: paper, text."""
    n = now.select("paper", F.sha1("text").alias("text_sha1"))
    return n.join(stored.withColumnRenamed("text_sha1", "old"), "paper", "left").where(~F.col("text_sha1").eqNullSafe(F.col("old"))).drop("old")


def merged_ids(a: Column, b: Column) -> Column:
    """Ids of both lists in the order they first appear."""
    return F.array_distinct(F.concat(a, b))


def upsert(registry: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """A registry (key, paper_ids) with new imports added: ids of one key are joined and unique."""
    both = registry.select(key, F.explode("paper_ids").alias("p"), F.lit(0).alias("o")).unionByName(new.select(key, F.explode("paper_ids").alias("p"), F.lit(1).alias("o")))
    return both.groupBy(key, "p").agg(F.min("o").alias("o")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "p"))), lambda x: x["p"]).alias("paper_ids"))
