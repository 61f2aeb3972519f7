"""Whole-table order without a task that sees it whole: running aggregates, ranks, exact percentiles, the n-th row.

A window with one partition, or with a key that a third of all rows share, sorts that key in one task. Here rows are dealt by ranges
of (key, order) that Spark samples, so a frequent key is spread over many ranges; a window runs within (key, range), and what stands
in earlier ranges of the same key is added from a table of range totals. Only keys that cross a border of ranges need one, so that
table has fewer rows than there are ranges and may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import discard, stage

PART = "__part"
#: Rows of the last range that nth() sorts on the driver, and ranges of one pass of its search.
FEW, FAN = 10_000, 4_096

AGGREGATES = {"sum": (F.sum, lambda a, b: a + b), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def ranged(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` written once in ranges of ``order``, numbered in order by ``__part``."""
    return stage(rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()), name)


def running(rows: DataFrame, key: list[str], order: list[str], measures: dict[str, tuple[str, Column]]) -> DataFrame:
    """Adds, per name, the sum, min or max of a column over the rows of the same key up to and including this one.

    ``order`` should tell the rows of a key apart: of rows that tie, which comes first is not defined (but it is the same for all
    measures, as rows are written once). A null counts as nothing; before the first value the aggregate is null.
    """
    held = rows.withColumns({f"__{n}": c for n, (_, c) in measures.items()})
    parts = ranged(held, [*key, *order], "running")
    totals = parts.groupBy(*key, PART).agg(*[AGGREGATES[kind][0](f"__{n}").alias(f"__t_{n}") for n, (kind, _) in measures.items()])
    earlier = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # A key that stands in one range alone has no earlier one: what is left has at most a row for each border between ranges.
    offsets = totals.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col(PART).alias("__p"), F.count("*").over(earlier).alias("__before"), *[AGGREGATES[kind][0](f"__t_{n}").over(earlier).alias(f"__o_{n}") for n, (kind, _) in measures.items()]).where("__before > 0").drop("__before")
    here = Window.partitionBy(*key, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.withColumns({f"__{n}": AGGREGATES[kind][0](f"__{n}").over(here) for n, (kind, _) in measures.items()})
    same = F.col(PART) == F.col("__p")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    met = local.join(F.broadcast(offsets), same, "left")
    added = {n: F.when(F.col(f"__o_{n}").isNull(), F.col(f"__{n}")).when(F.col(f"__{n}").isNull(), F.col(f"__o_{n}")).otherwise(AGGREGATES[kind][1](F.col(f"__{n}"), F.col(f"__o_{n}"))) for n, (kind, _) in measures.items()}
    return met.withColumns(added).select(*rows.columns, *measures)


def percentiles(rows: DataFrame, key: list[str], values: list[str], fractions: list[float], places: int | None = None) -> DataFrame:
    """Exact percentiles, by linear interpolation, of several numeric columns at once: key, measure, n, mean, points (array of double).

    Equal values are counted first, by partial aggregation, so a value that most rows share is a row a task; running counts over the
    distinct values then tell which of them hold the ranks asked for, and only those leave the ranges. Nulls count as nothing; a key
    without values has no row. With ``places``, points and mean are rounded half away from zero.
    """
    long = rows.select(*key, F.explode(F.array(*[F.struct(F.lit(v).alias("measure"), F.col(v).cast("double").alias("value")) for v in values])).alias("x")).select(*key, "x.*").where("value IS NOT NULL")
    keys = [*key, "measure"]
    counted = running(long.groupBy(*keys, "value").agg(F.count("*").alias("n")), keys, ["value"], {"upto": ("sum", F.col("n")), "total": ("sum", F.col("value") * F.col("n"))})
    whole = counted.groupBy(*keys).agg(F.max("upto").alias("n_all"), F.max_by("total", "upto").alias("total_all"))
    at = F.array(*[(F.col("n_all") - 1) * F.lit(q) for q in fractions])
    ranks = whole.select(*[F.col(k).alias(f"__{k}") for k in keys], "n_all", "total_all", F.posexplode(at).alias("i", "rank"))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    low, high = F.floor("rank"), F.ceil("rank")
    holds = lambda r: (F.col("upto") - F.col("n") <= r) & (r < F.col("upto"))
    met = counted.join(ranks, same).where(holds(low) | holds(high))
    point = met.groupBy(*keys, "n_all", "total_all", "i", "rank").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    shown = lambda c: c if places is None else F.round(c, places)
    exact = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    return point.groupBy(*keys, F.col("n_all").alias("n"), shown(F.col("total_all") / F.col("n_all")).alias("mean")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", shown(exact).alias("x")))), lambda p: p["x"]).alias("points"))


def nth(rows: DataFrame, position: str, n: int) -> int | None:
    """The n-th smallest (from 1) of the long integers in a column, or null if there are fewer; equal ones count each.

    Ranges are counted, the one that holds the n-th is counted again in narrower ranges, and only a range of at most FEW rows, or
    of one value, is looked at itself: no sort, no shuffle but of counts, and at most FAN counts or FEW numbers on the driver.
    ``rows`` is read several times: hand in a written table.
    """
    p = F.col(position)
    lo, hi, count = rows.where(p.isNotNull()).agg(F.min(p), F.max(p), F.count(p)).first()
    if n < 1 or count < n:
        return None
    inside = rows.where(p.isNotNull())
    while lo < hi and count > FEW:
        width = -(-(hi - lo + 1) // FAN)
        number = F.expr(f"(`{position}` - {lo}L) div {width}L")
        counts = inside.groupBy(number.alias("range")).agg(F.count("*").alias("n"), F.min(p).alias("lo"), F.max(p).alias("hi")).orderBy("range").collect()
        for r in counts:
            if n <= r.n:
                lo, hi, count = r.lo, r.hi, r.n
                break
            n -= r.n
        inside = rows.where(p.between(lo, hi))
    if lo == hi:
        return lo
    return sorted(r[0] for r in inside.select(p).collect())[n - 1]


def upto(rows: DataFrame, order: tuple[str, str], kept: Column, n: int, within: int = 1 << 40) -> DataFrame:
    """The rows, in the order of two integer columns, up to and including the n-th that is ``kept`` (all of them if there are fewer).

    ``within`` bounds the second column. Kept positions are written once, as one number each, and searched by :func:`nth`.
    """
    first, second = order
    place = (F.col(first).cast("long") * F.lit(within) + F.col(second).cast("long")).alias("place")
    if n <= 0:
        return rows.where(F.lit(False))
    places = stage(rows.where(kept).select(place), "places")
    last = nth(places, "place", n)
    discard(places)
    return rows if last is None else rows.where(place <= F.lit(last))
