"""Reruns as versions: immutable folders and one small manifest a version, so a reader sees the old or the new, never none or half.

``{path}/data/<uuid>`` holds what one commit wrote, ``{path}/versions/<number>.json`` lists the folders that make up each named table
at that version. A commit writes its data first, then moves the next manifest to its place, which only one committer can do; another
one that worked on the same version gets :class:`Conflict`, reads again and decides anew. Nothing is changed or moved afterwards:
a reader that was pinned to a version keeps it, and earlier versions are the archive.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Another commit came first."""


class Store:
    """Small files in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.at(path))] if self.fs.exists(self.at(path)) else []

    def text(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str, replace: bool) -> bool:
        """Write beside the place, then move there in one step: over what stands there if ``replace``, else only if nothing does."""
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.makeQualified(self.at(path)).toUri(), self.conf)
        place = self.fs.makeQualified(self.at(path))
        beside = self.fs.makeQualified(self.at(f"{path}.{uuid.uuid4().hex}.tmp"))
        out = self.fs.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        how = self.gateway.new_array(options, 1)
        how[0] = options.OVERWRITE if replace else options.NONE
        try:
            context.rename(beside, place, how)
        except Exception:
            self.fs.delete(beside, False)
            if replace or not self.fs.exists(place):
                raise
            return False
        return True


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def latest(self) -> int:
        """The number of the newest version; 0 before the first."""
        return max((int(n[:-5]) for n in self.store.names(f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def folders(self, table: str, version: int | None = None) -> list[str]:
        v = self.latest() if version is None else version
        return json.loads(self.store.text(f"{self.path}/versions/{v:010d}.json")).get(table, []) if v else []

    def read(self, table: str, schema, version: int | None = None) -> DataFrame:
        """A table as of a version (the newest now, if none is given): later commits do not change what this reads."""
        parts = [f"{self.path}/data/{x}" for x in self.folders(table, version)]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def commit(self, tables: dict[str, DataFrame], expected: int, append: bool = True) -> int:
        """Add to, or replace, these tables on top of version ``expected``; the other tables stay. Returns the new version."""
        manifest = json.loads(self.store.text(f"{self.path}/versions/{expected:010d}.json")) if expected else {}
        for name, rows in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.path}/data/{folder}")
            manifest[name] = [*(manifest.get(name, []) if append else []), folder]
        if not self.store.put(f"{self.path}/versions/{expected + 1:010d}.json", json.dumps(manifest), replace=False):
            raise Conflict(f"{self.path}: version {expected + 1} is there already")
        return expected + 1
