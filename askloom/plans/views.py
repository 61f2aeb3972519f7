"""Evaluation tables derived from order data: rubrics, judgments, attempts, rounds. Integers only, so any engine agrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators import rounds as R
from ..operators import rubric as H


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rubric(spark: SparkSession, d: str) -> DataFrame:
    """candidate, pos, part, weight: one criterion per order line."""
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    weight = (sign * (1 + F.col("l_quantity").cast("int") % 10)).alias("weight")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("candidate"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), weight)


def judged(attempts: int = 3) -> dict[str, list[Column]]:
    """By solver, for each attempt whether a criterion is satisfied."""
    weak = lambda n: ((F.col("part") + n * 7) % 3 == 0) | ((F.col("candidate") % 5 == 0) & (F.col("part") % 4 != 0))
    strong = lambda n: (F.col("part") + n * 5) % 4 != 0
    return {"weak": [weak(n) for n in range(1, attempts + 1)], "strong": [strong(n) for n in range(1, attempts + 1)]}


def marks(spark: SparkSession, d: str, attempts: int = 3) -> DataFrame:
    """candidate, role, attempt, pos, weight, satisfied: every criterion judged for every attempt of both solvers."""
    one = lambda role, n, s: F.struct(F.lit(role).alias("role"), F.lit(n).alias("attempt"), s.alias("satisfied"))
    each = [one(role, n, s) for role, all_ in judged(attempts).items() for n, s in enumerate(all_, 1)]
    return rubric(spark, d).withColumn("m", F.explode(F.array(*each))).select("candidate", "pos", "weight", "m.*")


def attempts(spark: SparkSession, d: str) -> DataFrame:
    return H.score_marks(marks(spark, d))


def verdicts(spark: SparkSession, d: str, preset: H.Preset = H.PROSE) -> DataFrame:
    return H.assess(H.stages(attempts(spark, d)), preset)


def rounds(spark: SparkSession, d: str, preset: H.Preset = H.PROSE) -> DataFrame:
    """paper, round, candidate, verdicts, failure_mode: a customer's orders are the rounds of a paper, up to the accepted one."""
    o = table(spark, d, "orders")
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    base = o.select(F.col("o_custkey").alias("paper"), nth.alias("round"), F.col("o_orderkey").alias("candidate"), (F.col("o_orderstatus") != "P").alias("qv_passed"), "o_orderdate")
    v = verdicts(spark, d, preset).select("candidate", "weak_passed", "strong_passed", "gap_passed", "all_passed", "weak_total", "weak_n", "strong_total", "strong_n", "max_positive")
    joined = base.join(v, "candidate", "left")
    kept = R.until_accepted(joined.withColumn("passes", F.coalesce(F.col("qv_passed") & F.col("all_passed"), F.lit(False))))
    strong_ok = F.when(F.col("all_passed").isNotNull(), F.col("strong_passed") & F.col("gap_passed"))
    mode = R.failure_mode(F.col("accepted"), F.col("qv_passed"), F.col("weak_passed"), strong_ok, F.when(F.col("all_passed").isNull(), 0).otherwise(1))
    return kept.withColumn("failure_mode", mode)


# The same views for an SQL engine.
RUBRIC = """rubric AS (SELECT l_orderkey AS candidate, l_linenumber AS pos, l_partkey AS part,
 (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * (1 + CAST(trunc(l_quantity) AS INT) % 10) AS weight FROM lineitem)"""
MARKS = f"""{RUBRIC}, n AS (SELECT unnest([1, 2, 3]) AS attempt), marks AS (
 SELECT candidate, pos, weight, 'weak' AS role, attempt, (part + attempt * 7) % 3 = 0 OR (candidate % 5 = 0 AND part % 4 <> 0) AS satisfied FROM rubric CROSS JOIN n
 UNION ALL SELECT candidate, pos, weight, 'strong', attempt, (part + attempt * 5) % 4 <> 0 FROM rubric CROSS JOIN n)"""
ATTEMPTS = f"""{MARKS}, points AS (SELECT candidate, role, attempt,
 CAST(sum(CASE WHEN satisfied AND weight > 0 THEN weight ELSE 0 END) AS BIGINT) AS earned,
 CAST(sum(CASE WHEN satisfied AND weight < 0 THEN -weight ELSE 0 END) AS BIGINT) AS penalty,
 CAST(sum(CASE WHEN weight > 0 THEN weight ELSE 0 END) AS BIGINT) AS max_positive,
 CAST(sum(CASE WHEN satisfied AND weight > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos_satisfied,
 CAST(sum(CASE WHEN satisfied AND weight < 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg_triggered FROM marks GROUP BY ALL),
attempts AS (SELECT *, greatest(0, least(max_positive, earned - penalty)) AS points FROM points)"""
STAGES = f"""{ATTEMPTS}, stages AS (SELECT candidate, max(max_positive) AS max_positive,
 count(*) FILTER (role = 'weak') AS weak_n, CAST(sum(points) FILTER (role = 'weak') AS BIGINT) AS weak_total, max(points) FILTER (role = 'weak') AS weak_top, min(points) FILTER (role = 'weak') AS weak_least,
 count(*) FILTER (role = 'strong') AS strong_n, CAST(sum(points) FILTER (role = 'strong') AS BIGINT) AS strong_total, max(points) FILTER (role = 'strong') AS strong_top, min(points) FILTER (role = 'strong') AS strong_least
 FROM attempts WHERE max_positive > 0 GROUP BY candidate)"""


def verdict_sql(p: H.Preset) -> str:
    """Common table expressions up to ``verdicts``."""
    weak = f"10000 * weak_total {'<=' if p.weak_inclusive else '<'} {p.weak_avg_max} * weak_n * max_positive"
    if p.weak_attempt_max is not None:
        weak += f" AND 10000 * weak_top <= {p.weak_attempt_max} * max_positive"
    weak += " AND weak_least > 0" * p.weak_no_zero
    strong = f"10000 * strong_total >= {p.strong_avg_min} * strong_n * max_positive"
    if p.strong_avg_max is not None:
        strong += f" AND 10000 * strong_total < {p.strong_avg_max} * strong_n * max_positive"
    strong += " AND strong_least > 0" * p.strong_no_zero
    gap = f"10000 * (strong_total * weak_n - weak_total * strong_n) >= {p.gap_min} * weak_n * strong_n * max_positive"
    return f"{STAGES}, verdicts AS (SELECT *, {weak} AS weak_passed, {strong} AS strong_passed, {gap} AS gap_passed, ({weak}) AND ({strong}) AND ({gap}) AS all_passed FROM stages)"


ROUNDS = f"""{verdict_sql(H.PROSE)}, base AS (SELECT o_custkey AS paper, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS round, o_orderkey AS candidate, o_orderstatus <> 'P' AS qv_passed, o_orderdate FROM orders),
met AS (SELECT b.*, v.* EXCLUDE (candidate), coalesce(qv_passed AND all_passed, false) AS passes FROM base b LEFT JOIN verdicts v USING (candidate)),
first AS (SELECT *, min(CASE WHEN passes THEN round END) OVER (PARTITION BY paper) AS accepted_round FROM met),
rounds AS (SELECT *, CASE WHEN round = accepted_round THEN 'ACCEPTED' WHEN qv_passed = false THEN 'FAILED_QV' WHEN weak_passed = false THEN 'TOO_EASY'
 WHEN all_passed IS NOT NULL AND NOT (strong_passed AND gap_passed) THEN 'FAILED_ON_STRONG' ELSE 'NO_EVAL' END AS failure_mode
 FROM first WHERE accepted_round IS NULL OR round <= accepted_round)"""
