"""Leases on many keys at once: exclusive for a time, taken over when their holder is silent, fenced against late writes.

A claim is a row (key, holder, fence, until, seq); the claim of a key with the greatest (fence, seq) counts. Claims and finished work
are two tables of one versioned log (``sources.versions``), so taking a lease and committing work exclude each other: work is
accepted only under the fence that counts at the version it is committed on. A holder that dies leaves nothing to clean up: its
leases end by themselves, and what it still writes afterwards carries an old fence and is refused.

Times are seconds, handed in by the caller; holders should agree on them within a fraction of the lease's length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .versions import Conflict, Versions

CLAIM = "key string, holder string, fence long, until double, seq long"


class Leases:
    def __init__(self, spark: SparkSession, path: str, work_schema: str | StructType):
        """work_schema: what a piece of work carries beside key, holder and fence."""
        self.log = Versions(spark, path)
        extra = StructType.fromDDL(work_schema) if isinstance(work_schema, str) else work_schema
        self.work_schema = StructType([*StructType.fromDDL("key string, holder string, fence long").fields, *extra.fields])

    def current(self, version: int | None = None) -> DataFrame:
        """The claim that counts, of every key ever claimed."""
        claims = self.log.read("claims", CLAIM, version)
        return claims.groupBy("key").agg(F.max_by(F.struct("holder", "fence", "until"), F.struct("fence", "seq")).alias("c")).select("key", "c.*")

    def work(self, version: int | None = None) -> DataFrame:
        return self.log.read("work", self.work_schema, version)

    def _attempt(self, step: Callable[[int], DataFrame | None], table: str) -> int:
        """Commit what ``step`` makes of the newest version; again, from what is there then, if another commit comes first."""
        while True:
            version = self.log.latest()
            rows = step(version)
            try:
                return self.log.commit({table: rows}, version)
            except Conflict:
                continue

    def acquire(self, keys: DataFrame, holder: str, ttl: float, now: float) -> DataFrame:
        """Claim those of ``keys`` (column key) that nobody holds at ``now`` and that are not finished; the claims got: key, fence."""

        def step(version: int) -> DataFrame:
            wanted = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct()
            open_ = wanted.join(self.work(version).select("key"), "key", "left_anti")
            met = open_.join(self.current(version).withColumnRenamed("holder", "by"), "key", "left").where(F.col("until").isNull() | (F.col("until") <= now))
            return met.select("key", F.lit(holder).alias("holder"), (F.coalesce("fence", F.lit(0)) + 1).cast("long").alias("fence"), F.lit(float(now + ttl)).alias("until"), F.lit(version + 1).cast("long").alias("seq"))

        version = self._attempt(step, "claims")
        return self.log.read("claims", CLAIM, version).where(F.col("seq") == version).select("key", "fence")

    def _extend(self, holder: str, until: float, now: float, keys: DataFrame | None = None) -> int:
        def step(version: int) -> DataFrame:
            held = self.current(version).where((F.col("holder") == holder) & (F.col("until") > now))
            held = held if keys is None else held.join(keys.select(F.col("key").cast("string").alias("key")), "key", "left_semi")
            return held.select("key", "holder", "fence", F.lit(float(until)).alias("until"), F.lit(version + 1).cast("long").alias("seq"))

        return self._attempt(step, "claims")

    def heartbeat(self, holder: str, ttl: float, now: float) -> DataFrame:
        """Prolong what the holder still holds; a lease that ended is not revived. What it holds now: key, fence."""
        version = self._extend(holder, now + ttl, now)
        return self.log.read("claims", CLAIM, version).where(F.col("seq") == version).select("key", "fence")

    def release(self, holder: str, now: float, keys: DataFrame | None = None) -> None:
        """Let go of some keys, or all."""
        self._extend(holder, now, now, keys)

    def finish(self, rows: DataFrame, holder: str, now: float) -> tuple[DataFrame, DataFrame]:
        """Commit work: rows of key, fence and the work's columns -> (accepted, refused), each with key and fence.

        Accepted is what comes under the key's newest fence, within its lease, once; all else is refused, now and ever.
        """
        columns = [f.name for f in self.work_schema.fields if f.name not in ("key", "holder", "fence")]
        rows = rows.select(F.col("key").cast("string").alias("key"), F.col("fence").cast("long").alias("fence"), *columns).dropDuplicates(["key", "fence"])

        def step(version: int) -> DataFrame:
            live = self.current(version).where((F.col("holder") == holder) & (F.col("until") > now)).select("key", "fence")
            fine = rows.join(live, ["key", "fence"], "left_semi").join(self.work(version).select("key"), "key", "left_anti")
            return fine.select("key", F.lit(holder).alias("holder"), "fence", *columns)

        version = self._attempt(step, "work")
        folder = self.log.folders("work", version)[-1]
        accepted = self.log.spark.read.schema(self.work_schema).parquet(f"{self.log.path}/data/{folder}").select("key", "fence")
        return accepted, rows.select("key", "fence").join(accepted, ["key", "fence"], "left_anti")

    def compact(self) -> int:
        """Rewrite the claims as the ones that count."""
        while True:
            version = self.log.latest()
            rows = self.current(version).withColumn("seq", F.lit(version + 1).cast("long"))
            try:
                return self.log.commit({"claims": rows}, version, append=False)
            except Conflict:
                continue
