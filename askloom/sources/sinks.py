"""Sinks: ordered appends, numbered runs, versioned reruns, rendered reports."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import exact_percent
from ..operators.rubric import Preset
from .versions import Store


def append_ordered(rows: DataFrame, path: str, order: list[str]) -> None:
    """Append rows, with their order in columns; each job commits whole or not at all."""
    rows.select(*rows.columns, F.struct(*order).alias("ord")).write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").json(path)


def current_versions(rows: DataFrame, key: str, attempt: str) -> DataFrame:
    """Reruns as versions: the latest attempt of each key is current, the rest is the archive."""
    last = rows.groupBy(key).agg(F.max(attempt).alias("last"))
    return rows.join(last, key).withColumn("is_current", F.col(attempt) == F.col("last")).drop("last")


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file in any store Spark reaches, replaced in one step: a reader finds the old text or the new."""
    Store(spark, path).put(path, text, replace=True)


def write_json(obj, path: str, spark: SparkSession | None = None) -> None:
    """A small JSON file, replaced as a whole: on the driver, or with a session in the store of ``path``."""
    text = json.dumps(obj, indent=2, ensure_ascii=False) + "\n"
    if spark is not None:
        return put_text(spark, text, path)
    p = Path(path)
    temporary = p.with_name(f".{p.name}.tmp")
    temporary.write_text(text, encoding="utf-8")
    temporary.replace(p)


def one_file(lines: DataFrame, order: list[str], path: str, end: str = "\n") -> None:
    """One file of ordered lines (column ``value``), each with its ``end``, gzipped if it is called so: a shard, written by one task."""
    spark = lines.sparkSession
    context = spark.sparkContext
    at = lambda x: context._jvm.org.apache.hadoop.fs.Path(x)
    fs = at(path).getFileSystem(context._jsc.hadoopConfiguration())
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    lines.orderBy(*order).select("value").coalesce(1).write.text(beside, compression="gzip" if path.endswith(".gz") else None, lineSep=end)
    part = next(f.getPath() for f in fs.listStatus(at(beside)) if f.getPath().getName().startswith("part-"))
    fs.delete(at(path), False)
    fs.rename(part, at(path))
    fs.delete(at(beside), True)


def report_lines(assessed: DataFrame) -> DataFrame:
    """A text block per candidate: averages in percent with one decimal, verdicts, reasons."""
    pct = lambda part, n: F.coalesce(F.format_string("%.1f%%", part.cast("double") / (n * F.col("max_positive")).cast("double") * 100), F.lit("n/a"))
    word = lambda c: F.when(F.col(c).isNull(), "NOT EVALUATED").when(F.col(c), "PASSED").otherwise("FAILED")
    lines = F.array(
        F.concat(F.lit("weak: avg "), pct(F.col("weak_total"), F.col("weak_n")), F.lit(" "), word("weak_passed")),
        F.concat(F.lit("strong: avg "), pct(F.col("strong_total"), F.col("strong_n")), F.lit(" "), word("strong_passed")),
        F.concat(F.lit("gap: "), word("gap_passed")),
        F.concat(F.lit("overall: "), F.when(F.col("all_passed"), "ACCEPTED").otherwise("REJECTED")),
    )
    reasons = F.transform("failure_reasons", lambda r: F.concat(F.lit("- "), r))
    return assessed.select("candidate", F.array_join(F.concat(lines, reasons), "\n").alias("report"))


def evaluation_report(rows: DataFrame, preset: Preset) -> DataFrame:
    """``rows`` with ``report``: the evaluator's whole text block, a line each for rubric, attempts, averages, stages, gap and verdict.

    rows: mode, question_hash, error_kind, error_message (null without an error), weights (array; or their numbers above 0 and not,
    n_positive and n_other), weak_model, strong_model,
    weak_list and strong_list (arrays of struct index, error_type, error, points, n_pos, n_neg, finish, tokens) and the columns of
    ``rubric.assess``. Percentages are exact fractions, rounded half to even.
    """
    m, mode = F.col("max_positive"), F.col("mode")
    if "weights" in rows.columns:
        n, n_pos, n_neg = F.size("weights"), F.size(F.filter("weights", lambda w: w > 0)), F.size(F.filter("weights", lambda w: w <= 0))
    else:
        n, n_pos, n_neg = F.col("n_positive") + F.col("n_other"), F.col("n_positive"), F.col("n_other")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    fixed = lambda t: f"{t / 100:.1f}%"
    reasons = lambda prefix: F.transform(F.filter("failure_reasons", lambda r: r.startswith(prefix)), lambda r: F.substring(r, len(prefix) + 1, 10_000))
    # The words of the block.
    lines = [
        F.array(text(F.col("error_kind"), ": ", F.coalesce("error_message", F.lit("")))),
        F.array(text("=== EVALUATE_RUBRIC REPORT (", mode, ") ===")),
        F.array(text("question_hash: ", F.col("question_hash"))),
        F.array(text("rubric: ", n, " criteria (", n_pos, " positive, ", n_neg, " negative), positive weight total ", m)),
    ]
    weak_rule = [text("weak_avg ", exact_percent(F.col("weak_total"), F.col("weak_n") * m), f" {'<=' if preset.weak_inclusive else '<'} {fixed(preset.weak_avg_max)}")]
    weak_rule += [F.lit(f"max_weak <= {fixed(preset.weak_attempt_max)}")] if preset.weak_attempt_max is not None else []
    weak_rule += [F.lit("no zero weak attempt")] if preset.weak_no_zero else []
    passed = {"weak": text("WEAK_PASSED (", F.array_join(F.array(*weak_rule), ", "), ")"), "strong": F.lit("STRONG_PASSED")}
    skipped = F.when(mode == "both", "STRONG_SKIPPED: weak evaluation did not pass").when(mode == "strong-only", "STRONG_SKIPPED: no passing weak result for this question (run --weak-only first)")
    for role, prefix in (("weak", "weak: "), ("strong", "failed on strong: ")):
        made, whole = F.coalesce(F.col(f"{role}_list"), F.array()), F.col(f"{role}_n") * m
        there = F.size(made) > 0

        def shown(a):
            failed = text("  attempt ", a["index"], ": ", a["error_type"], ": ", a["error"])
            fine = text("  attempt ", a["index"], ": ", exact_percent(a["points"], m), "  (positive satisfied ", a["n_pos"], "/", n_pos, ", negative triggered ", a["n_neg"], "/", n_neg, ", finish=", F.coalesce(a["finish"], F.lit("None")), ", ", F.coalesce(a["tokens"], F.lit(0)), " completion tokens)")
            return F.when(a["error"].isNotNull(), failed).otherwise(fine)

        average = text(f"{role}_avg: ", exact_percent(F.col(f"{role}_total"), whole), f"  max_{role}: ", exact_percent(F.col(f"{role}_top"), m), f"  min_{role}: ", exact_percent(F.col(f"{role}_least"), m))
        verdict = F.when(F.col(f"{role}_passed"), passed[role]).when(~F.col(f"{role}_passed"), text(f"{role.upper()}_FAILED: ", F.array_join(reasons(prefix), "; ")))
        head = text(f"{role} solver: ", F.col(f"{role}_model"), " x", F.size(made))
        block = F.concat(F.array(head), F.transform(made, shown), F.when(F.col(f"{role}_n").isNotNull(), F.array(average, verdict)).otherwise(F.array().cast("array<string>")))
        lines.append(F.when(there, block).otherwise(F.array(skipped) if role == "strong" else F.array().cast("array<string>")))
    lead = F.col("strong_total") * F.col("weak_n") - F.col("weak_total") * F.col("strong_n")
    others = F.filter("failure_reasons", lambda r: r.startswith("gap "))
    lines += [
        F.array(F.when((mode == "strong-only") & (F.size(F.coalesce("weak_list", F.array())) == 0), "NO_WEAK_RESULT: run --weak-only first")),
        F.when(F.col("gap_passed").isNotNull(), F.array(text("gap: ", exact_percent(lead, F.col("weak_n") * F.col("strong_n") * m)), F.when(F.col("gap_passed"), "GAP_PASSED").otherwise(text("GAP_FAILED: ", F.array_join(others, "; "))))).otherwise(F.array().cast("array<string>")),
        F.array(F.when((mode != "weak-only") | F.col("error_kind").isNotNull(), F.when(F.col("all_passed"), "ACCEPTANCE: ALL_SOLVER_CRITERIA_PASSED").otherwise(text("ACCEPTANCE: FAILED (", F.array_join("failure_reasons", "; "), ")")))),
    ]
    return rows.withColumn("report", F.concat(F.array_join(F.array_compact(F.concat(*lines)), "\n"), F.lit("\n")))


def markdown_table(row: dict) -> str:
    """A collected row of statistics as a table for people."""
    cell = lambda v: "-" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join(["| metric | value |", "|---|---|", *[f"| {k} | {cell(v)} |" for k, v in row.items()]])
