"""Prompts out of rows, and rows out of completions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its {placeholders} filled; one that is missing is an error, other braces stay."""
    parts = re.split(r"\{(\w+)\}", template)
    if lacking := [p for p in parts[1::2] if p not in values]:
        raise KeyError(f"no value for {lacking}")
    return F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(values[p], F.lit("")) for i, p in enumerate(parts)])


def criteria_lines(rubric: Column) -> Column:
    """Numbered criteria with signed weights, for a judge: ``1. [+3 positive] text``. rubric: array of criterion, weight, category."""
    line = lambda x, i: F.format_string("%d. [%+d %s] %s", i + 1, x["weight"], x["category"], x["criterion"])
    return F.array_join(F.transform(rubric, line), "\n")


def solver_prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), question)


def merged_options(*maps: Column) -> Column:
    """Option maps, later ones winning key by key."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_zip_with(out, m, lambda k, a, b: F.coalesce(b, a))
    return out


USAGE = ["prompt_tokens", "completion_tokens", "total_tokens"]


def flattened(response: Column) -> Column:
    """The first choice of a chat completion (JSON): content, reasoning, finish_reason, tool calls (bad arguments as {}, raw kept), usage."""
    v = F.try_parse_json(response)
    s = lambda path: F.try_variant_get(v, path, "string")
    calls = F.try_variant_get(v, "$.choices[0].message.tool_calls", "array<struct<id:string,function:struct<name:string,arguments:string>>>")
    fine = lambda raw: F.coalesce(F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    call = lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), F.when(fine(c["function"]["arguments"]), c["function"]["arguments"]).otherwise("{}").alias("arguments"), c["function"]["arguments"].alias("raw"))
    whole = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.usage.{k}", "variant")) == "BIGINT", F.try_variant_get(v, f"$.usage.{k}", "bigint"))
    usage = F.map_filter(F.create_map(*[x for k in USAGE for x in (F.lit(k), whole(k))]), lambda k, n: n.isNotNull())
    return F.struct(
        s("$.choices[0].message.content").alias("content"),
        F.coalesce(s("$.choices[0].message.reasoning"), s("$.choices[0].message.reasoning_content")).alias("reasoning"),
        s("$.choices[0].finish_reason").alias("finish_reason"),
        F.transform(F.coalesce(calls, F.array()), call).alias("tool_calls"),
        usage.alias("usage"),
    )


def history_row(flat: Column) -> Column:
    """The assistant message that a flattened completion adds to a history."""
    return F.struct(F.lit("assistant").alias("role"), F.coalesce(flat["content"], F.lit("")).alias("content"), flat["reasoning"].alias("reasoning"), F.when(F.size(flat["tool_calls"]) > 0, flat["tool_calls"]).alias("tool_calls"))


def micro_batches(rows: DataFrame, partition: str, order: list[str], pending: Column, size: int = 500, span: int = 1 << 16) -> DataFrame:
    """The number of the lookup batch of every row: a batch is full with ``size`` pending rows.

    The first column of the order is a number. Sums run within spans of it, and over the spans' sums: no task holds a whole partition.
    """
    rows = rows.withColumns({"_pending": F.when(pending, 1).otherwise(0), "_span": F.floor(F.col(order[0]) / span)})
    own = F.sum("_pending").over(Window.partitionBy(partition, "_span").orderBy(*order))
    spans = rows.groupBy(partition, "_span").agg(F.sum("_pending").alias("_sum"))
    before = Window.partitionBy(partition).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col(partition).alias("_of"), F.col("_span").alias("_at"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    so_far = rows.withColumn("_own", own).join(spans, F.col(partition).eqNullSafe(F.col("_of")) & (F.col("_span") == F.col("_at")))
    return so_far.withColumn("batch", F.floor((F.greatest(F.col("_own") + F.col("_before"), F.lit(1)) - 1) / size)).drop("_pending", "_span", "_own", "_of", "_at", "_before")


def request_options(endpoint: Column, extra: Column, nested_endpoint: Column, nested_extra: Column, seed: Column) -> Column:
    """STRUCT<options, nested> of a request: extra options win over the endpoint's, key by key, also in the nested map; the call's seed wins over all."""
    own = F.when(seed.isNotNull(), F.create_map(F.lit("seed"), seed.cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    return F.struct(merged_options(endpoint, extra, own).alias("options"), merged_options(nested_endpoint, nested_extra).alias("nested"))


def paper_summaries(rounds: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """rounds: paper, round, failure_mode -> one summary per paper; events: paper, kind, informational."""
    g = rounds.groupBy("paper").agg(
        F.count("*").alias("n_rounds"),
        F.min(F.when(F.col("failure_mode") == "ACCEPTED", F.col("round"))).alias("accepted_round"),
        F.array_sort(F.collect_list(F.struct("round", "failure_mode"))).alias("rounds"),
    )
    g = g.withColumn("accepted", F.col("accepted_round").isNotNull())
    if events is None:
        return g
    return g.join(events.groupBy("paper").agg(F.count("*").alias("guardrail_events")), "paper", "left").withColumn("guardrail_events", F.coalesce("guardrail_events", F.lit(0)))
