"""Run configuration as data: roles resolved against endpoints, cohort manifests merged, criteria as text, readiness of services.

The driver reads one file (``askloom.config``); what many runs, roles or services say is tables, and these are the joins over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running


def expanded(text: Column, variables: Column) -> Column:
    """$NAME and ${NAME} replaced by ``variables`` (map); an unknown one is left as it stands. Longer names come first."""
    names = F.array_sort(F.map_keys(variables), lambda a, b: F.char_length(b) - F.char_length(a))
    braced = lambda s, k: F.replace(s, F.concat(F.lit("${"), k, F.lit("}")), variables[k])
    return F.aggregate(names, text, lambda s, k: F.replace(braced(s, k), F.concat(F.lit("$"), k), variables[k]))


def resolved_roles(roles: DataFrame, endpoints: DataFrame, variables: Column | None = None) -> DataFrame:
    """roles: role, endpoint, overrides (map of strings, or null); endpoints: endpoint, options (map of strings) -> role, options.

    An override stands above the endpoint's own option. A role whose endpoint is unknown has null options.
    """
    none = F.create_map().cast("map<string,string>")
    met = roles.join(endpoints, "endpoint", "left").withColumn("own", F.coalesce("overrides", none))
    merged = F.map_concat(F.map_filter("options", lambda k, _: ~F.map_contains_key("own", k)), "own")
    if variables is not None:
        merged = F.transform_values(merged, lambda _, v: expanded(v, variables))
    return met.select("role", merged.alias("options"))


def merged_manifests(stored: DataFrame, new: DataFrame, settings: list[str]) -> DataFrame:
    """Manifests of runs asked for again: root, the new settings, changed (names that differ), n_history.

    stored: root, settings, n_history; new: root, settings. A run without a stored manifest changes nothing; another setting adds the
    old ones to the history, and ``changed`` is for the caller to refuse.
    """
    old = stored.select(F.col("root").alias("o_root"), "n_history", F.lit(True).alias("known"), *[F.col(c).alias(f"o_{c}") for c in settings])
    met = new.join(old, F.col("root") == F.col("o_root"), "left")
    changed = F.array_compact(F.array(*[F.when(F.col("known") & ~F.col(c).eqNullSafe(F.col(f"o_{c}")), F.lit(c)) for c in settings]))
    history = F.coalesce("n_history", F.lit(0)) + (F.size("changed") > 0).cast("int")
    return met.withColumn("changed", changed).select("root", *settings, "changed", history.alias("n_history"))


def merged_papers(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Papers of each run in the order they were first asked for: root, paper, place (from 1); both inputs have root, paper, place."""
    listed = lambda df, k: df.select("root", "paper", F.struct(F.lit(k).alias("list"), F.col("place").cast("long").alias("place")).alias("at"))
    first = listed(stored, 0).unionByName(listed(new, 1)).groupBy("root", "paper").agg(F.min("at").alias("at"))
    return running(first.select("root", "paper", "at.list", F.col("at.place").alias("asked")), ["root"], ["list", "asked"], {"place": ("sum", F.lit(1).cast("long"))}).select("root", "paper", "place")


def criteria(weak_avg_max: Column, weak_inclusive: Column, weak_attempt_max: Column, weak_no_zero: Column, strong_avg_min: Column, strong_avg_max: Column, gap_min: Column) -> tuple[Column, Column, Column]:
    """What a prompt says about thresholds given in whole percent: the weak, the strong and the gap criterion; null is no limit."""
    percent = lambda c: F.concat(c.cast("string"), F.lit("%"))
    weak = F.array(
        F.concat(F.lit("weak_avg "), F.when(weak_inclusive, "≤").otherwise("<"), F.lit(" "), percent(weak_avg_max)),
        F.concat(F.lit("max_weak ≤ "), percent(weak_attempt_max)),
        F.when(weak_no_zero, "no zeros"),
    )
    strong = F.concat(F.lit("strong_avg ≥ "), percent(strong_avg_min), F.coalesce(F.concat(F.lit(" AND strong_avg < "), percent(strong_avg_max)), F.lit("")))
    return F.array_join(F.array_compact(weak), ", "), strong, F.concat(F.lit("Gap (strong_avg - weak_avg) ≥ "), percent(gap_min))


def readiness(probes: DataFrame, wait: float) -> DataFrame:
    """probes: service, at (timestamp), ready -> service, probes made until it was ready or the wait was over, ready, waited (seconds).

    The wait begins with a service's first probe; probes after its end, or after the first that found it ready, were not made.
    """
    seconds = F.unix_micros("at") / 1e6
    began = probes.groupBy("service").agg(F.min(seconds).alias("began"))
    timed = probes.join(began, "service").withColumn("waited", seconds - F.col("began")).where(F.col("waited") <= wait)
    first = timed.groupBy("service").agg(F.min(F.when(F.col("ready"), F.col("waited"))).alias("first"))
    made = timed.join(first, "service").where(F.col("first").isNull() | (F.col("waited") <= F.col("first")))
    return made.groupBy("service").agg(F.count("*").alias("probes"), F.first("first").isNotNull().alias("ready"), F.coalesce(F.first("first"), F.lit(float(wait))).alias("waited"))
