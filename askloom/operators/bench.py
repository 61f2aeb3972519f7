"""Model-server benchmark analysis: scraped counters, deltas, distributions, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a line of the text exposition format.
LINE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)"


def scrape(lines: DataFrame, prefix: str, text: str = "value") -> DataFrame:
    """Text exposition lines -> metric[/position=k] and the sum of its values; _created and _bucket series are dropped."""
    g = lambda i: F.regexp_extract(text, LINE, i)
    pos = F.regexp_extract(g(2), 'position="([0-9]+)"', 1)
    rows = lines.where(F.col(text).startswith(prefix) & (g(1) != "")).select(g(1).alias("name"), pos.alias("pos"), g(3).try_cast("double").alias("v"))
    rows = rows.where(~F.col("name").rlike("_(created|bucket)$") & F.col("v").isNotNull())
    metric = F.when(F.col("pos") != "", F.concat("name", F.lit("/position="), "pos")).otherwise(F.col("name"))
    return rows.groupBy(metric.alias("metric")).agg(F.sum("v").alias("value"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """after minus before for every counter that changed; a counter that is new starts from 0."""
    d = after.join(before.withColumnRenamed("value", "old"), "metric", "left").withColumn("delta", F.col("value") - F.coalesce("old", F.lit(0.0)))
    counter = F.col("metric").rlike("(_total|_sum|_count)$") | F.col("metric").contains("_total/position=")
    return d.where(counter & (F.abs("delta") > 1e-9)).select("metric", "delta")


def means(changes: DataFrame) -> DataFrame:
    """base, mean: a histogram's mean over the interval, null where nothing was counted."""
    base = F.regexp_replace("metric", "_(sum|count)$", "")
    total = lambda end: F.sum(F.when(F.col("metric").endswith(end), F.col("delta")))
    return changes.where(F.col("metric").rlike("_(sum|count)$")).groupBy(base.alias("base")).agg(F.try_divide(total("_sum"), F.nullif(total("_count"), F.lit(0.0))).alias("mean"))


def distribution(rows: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """p50, p95, mean, min, max."""
    return rows.groupBy(*(by or [])).agg(F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def throughput(requests: DataFrame, by: list[str]) -> DataFrame:
    """requests: tokens, wall_s, finish_reason, error -> output tokens per second, finishes by reason, first five errors."""
    return requests.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum("tokens").alias("tokens"),
        F.try_divide(F.sum("tokens").cast("double"), F.max("wall_s").cast("double")).alias("tokens_per_s"),
        F.count_if(F.col("finish_reason") == "stop").alias("n_stop"),
        F.count_if(F.col("finish_reason") == "length").alias("n_length"),
        F.slice(F.sort_array(F.collect_set("error")), 1, 5).alias("errors"),
    )


def pairwise_agreement(marks: DataFrame, item: str, run: str, pos: str, mark: str) -> DataFrame:
    """Mean share of equal marks over all pairs of an item's runs, from counts per position: no pair is made.

    At a position with t true and f false marks, t(t-1)/2 + f(f-1)/2 of the pairs agree.
    """
    per = marks.groupBy(item, pos).agg(F.count_if(F.col(mark)).alias("t"), F.count_if(~F.col(mark)).alias("f"))
    pairs = lambda a: F.col(a) * (F.col(a) - 1)
    n = F.col("t") + F.col("f")
    return per.groupBy(item).agg(F.sum(pairs("t") + pairs("f")).alias("agreeing"), F.sum(n * (n - 1)).alias("pairs")).withColumn("agreement", F.try_divide(F.col("agreeing").cast("double"), F.nullif(F.col("pairs").cast("double"), F.lit(0.0))))
