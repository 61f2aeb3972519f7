"""Sources: JSON lines (gzipped shards too), run directories, transcripts, metadata caches and batch lookups."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lazy import ship
from ..functions.text import url_basename
from ..operators.ordered import running
from ..staging import stage


def listing(files: DataFrame, url: str = "url") -> DataFrame:
    """A release's files in the order of their names: file, shard (place from 0), url."""
    named = files.select(url_basename(F.col(url)).alias("file"), F.col(url).alias("url"))
    return named.withColumn("shard", F.row_number().over(Window.orderBy("file")) - 1)  # a row per file


def shard_records(spark: SparkSession, listing: list[str]) -> DataFrame:
    """Lines of gzipped JSONL shards: shard (place in the listing), line (in file order), record (variant; null: bad or no object).

    A file that ends early fails the read. Blank lines are skipped. Gzip cannot be split, so a file is read in order by one task.
    """
    names = spark.createDataFrame([(p.rsplit("/", 1)[-1], i) for i, p in enumerate(sorted(listing, key=lambda p: p.rsplit("/", 1)[-1]))], "file string, shard int")
    lines = spark.read.text(listing).select("value", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.where(F.trim("value") != "").join(F.broadcast(names), "file")
    v = F.try_parse_json("value")
    return rows.select("shard", "line", F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("record"))


def strict_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines that must all be well-formed."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def torn_tail(spark: SparkSession, path: str, step: int = 1 << 16) -> str | None:
    """The last line of a file if no line feed ends it, read from the file's end."""
    context = spark.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(context._jsc.hadoopConfiguration())
    end, tail = fs.getFileStatus(p).getLen(), b""
    stream = fs.open(p)
    try:
        while len(tail) < end and b"\n" not in tail:
            lo = max(0, end - len(tail) - step)
            stream.seek(lo)
            tail = bytes(stream.readNBytes(end - len(tail) - lo)) + tail
    finally:
        stream.close()
    last = tail.rsplit(b"\n", 1)[-1]
    return last.decode("utf-8", "replace") if last else None


def keys_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Integer keys of an append-only JSONL file; only an unterminated last line may be broken, a broken inner line is an error."""
    rows = spark.read.text(path).where(F.trim("value") != "").select("value", F.try_variant_get(F.try_parse_json("value"), f"$.{key}", "bigint").alias(key))
    broken = [r["value"] for r in rows.where(F.col(key).isNull()).select("value").limit(2).collect()]
    if broken and broken != [torn_tail(spark, path)]:
        raise ValueError(f"malformed record in {path}: {broken[0][:80]!r}")
    return rows.select(key).where(F.col(key).isNotNull())


def latest_by_key(lines: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """An append-only key-value log: the last write of each key; a stored null stays, as known to be unknown."""
    return lines.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def run_summaries(spark: SparkSession, root: str, filename: str) -> DataFrame:
    """One level of run directories: directory, path, paper_id, summary (variant). Archived and private directories, unreadable files and summaries without a paper id are skipped."""
    raw = spark.read.text(f"{root}/*/{filename}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    rows = raw.withColumn("directory", F.element_at(F.split("path", "/"), -2)).where(~F.col("directory").startswith("_") & ~F.col("directory").contains(".old."))
    v = F.try_parse_json("value")
    paper = F.when(F.schema_of_variant(F.variant_get(v, "$.paper_id", "variant")) == "STRING", F.variant_get(v, "$.paper_id", "string"))
    return rows.select("directory", "path", paper.alias("paper_id"), v.alias("summary")).where(F.coalesce(F.col("paper_id") != "", F.lit(False)))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """Evaluation reports below run directories: directory, run, path, report (variant); bad ones are skipped."""
    raw = spark.read.text(f"{root}/*/eval_attempts/run_*/report.json", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    v = F.try_parse_json("value")
    rows = raw.select(F.element_at(F.split("path", "/"), -4).alias("directory"), F.element_at(F.split("path", "/"), -2).alias("run"), "path", v.alias("report"))
    return rows.where(F.coalesce(F.schema_of_variant("report").startswith("OBJECT"), F.lit(False)))


EVENT = "type STRING, agent STRING, step INT, kind STRING, data STRING, message STRING, ts DOUBLE"


def transcript(spark: SparkSession, path: str, kinds: list[str] | None = None) -> DataFrame:
    """Transcript lines; broken ones are skipped; optionally only some kinds of event."""
    rows = spark.read.schema(EVENT + ", _corrupt STRING").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").where("_corrupt IS NULL").drop("_corrupt")
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def present(variant: Column, path: str) -> Column:
    """Whether a key is there at all: a JSON null counts, a missing key does not."""
    return F.try_variant_get(variant, path, "variant").isNotNull()


def flag(variant: Column, path: str, missing: bool) -> Column:
    """A boolean whose missing key has a default while JSON null is false."""
    return F.when(present(variant, path), F.coalesce(F.try_variant_get(variant, path, "boolean"), F.lit(False))).otherwise(F.lit(missing))


def parse_shards(text: str) -> list[int]:
    """'0,2-4' -> [0, 2, 3, 4], in order, each once."""
    out: dict[int, None] = {}
    for part in filter(None, map(str.strip, text.split(","))):
        lo, _, hi = part.partition("-")
        a, b = int(lo), int(hi or lo)
        if b < a:
            raise ValueError(f"empty range {part!r}")
        out.update(dict.fromkeys(range(a, b + 1)))
    return list(out)


def choose_shards(n: int, listed: list[int] | None = None, count: int | None = None, seed: int = 0) -> list[int]:
    """The listed shards, or a seeded sample without replacement; an index outside the listing is an error."""
    chosen = listed if listed is not None else random.Random(seed).sample(range(n), min(count or n, n))
    if bad := [i for i in chosen if not 0 <= i < n]:
        raise ValueError(f"no such shards: {bad}")
    return chosen


def batch_lookup(keys: DataFrame, key: str, fetch: Callable[[list[int]], list[str | None]], batch: int = 500) -> DataFrame:
    """key, value (JSON; null: unknown) through a service that answers up to ``batch`` keys at a time, aligned with its input."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            ids = p[key].tolist()
            for lo in range(0, len(ids), batch):
                asked = ids[lo : lo + batch]
                got = fetch(asked)
                if len(got) != len(asked):
                    raise ValueError("the answer is not aligned with the request")
                yield pd.DataFrame({key: asked, "value": got})

    return keys.select(F.col(key).cast("long").alias(key)).distinct().mapInPandas(run, f"{key} long, value string")


def cached_lookup(keys: DataFrame, cache: DataFrame, key: str, fetch: Callable, batch: int = 500) -> tuple[DataFrame, DataFrame]:
    """(all answers, those that were not cached): known unknowns are not asked again."""
    fresh = batch_lookup(keys.join(cache, key, "left_anti"), key, fetch, batch)
    return cache.join(keys.select(key).distinct(), key, "left_semi").select(key, "value").unionByName(fresh), fresh


def counted_lookup(rows: DataFrame, cache: DataFrame, fetch: Callable[[list[int]], list[str | None]], batch: int = 500, id_path: str = "$.corpusId") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Look-ups of many shards, cache first: (key and value of every key asked for, the fresh ones, counters of each shard).

    rows: shard, key; cache: key, value (JSON; null: known to be unknown). A key that several shards ask for is fetched by the first
    of them and cached for the others. Each shard's misses are asked for in calls of up to ``batch`` keys, in key order, and what was
    answered is written once, so no call is made twice. Counters: from_cache, from_service, calls and mismatches (answers that carry
    another id than the one asked for; they are kept).
    """
    asked = rows.select("shard", F.col("key").cast("long").alias("key")).where("key IS NOT NULL").distinct()
    known = cache.select(F.col("key").cast("long").alias("key"), "value")
    misses = asked.groupBy("key").agg(F.min("shard").alias("shard")).join(known.select("key"), "key", "left_anti")
    dealt = running(misses, ["shard"], ["key"], {"nth": ("sum", F.lit(1).cast("long"))})
    calls = dealt.groupBy("shard", F.floor((F.col("nth") - 1) / batch).alias("call")).agg(F.array_sort(F.collect_list("key")).alias("keys"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for shard, call, keys in zip(p["shard"].tolist(), p["call"].tolist(), p["keys"].tolist()):
                wanted = [int(k) for k in keys]
                got = fetch(wanted)
                if len(got) != len(wanted):
                    raise ValueError("the answer is not aligned with the request")
                yield pd.DataFrame({"shard": shard, "call": call, "key": wanted, "value": pd.Series(got, dtype=object)})

    fresh = stage(calls.mapInPandas(run, f"shard {asked.schema['shard'].dataType.simpleString()}, call long, key long, value string"), "lookups")
    answers = asked.select("key").distinct().join(known.unionByName(fresh.select("key", "value")), "key")
    other = F.get_json_object("value", id_path).cast("long")
    served = fresh.groupBy("shard").agg(F.count("*").alias("from_service"), F.count_distinct("call").alias("calls"), F.count_if(other != F.col("key")).alias("mismatches"))
    counters = asked.groupBy("shard").agg(F.count("*").alias("n")).join(served, "shard", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    counters = counters.select("shard", (F.col("n") - zero("from_service")).alias("from_cache"), *[zero(c).alias(c) for c in ("from_service", "calls", "mismatches")])
    return answers, fresh.select("key", "value"), counters


ship(__name__)
