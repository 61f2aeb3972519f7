"""Shared plumbing of the training-data operators.

Three rules hold for every operator of this subpackage:

* intermediate tables that must survive lost executors are written as Parquet under ``spark.checkpoint.dir`` (:func:`stage`);
* an operator selects the columns it needs under names of its own, so extra columns of the input never clash;
* functions that run in Python workers are shipped by value (:func:`ship`), so executors need no copy of the package.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: The columns of :func:`numbered`.
ROW_ID, ROW = "__row_id", "__row"


def ship(module: str) -> None:
    """Pickle the functions of this module by value when they go to Python workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; a temporary one where that is unset in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.askloom.workdir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="askloom-")
        spark.conf.set("spark.askloom.workdir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold within the block only."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: lineage ends there, later readers prune its columns.

    Shuffle files of the write go once it is done; a lost executor costs a rerun of the tasks whose files it held.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    for tables in _COLLECTING:
        tables.append(out)
    return out


_COLLECTING: list[list[DataFrame]] = []


@contextmanager
def collecting() -> Iterator[list[DataFrame]]:
    """The tables that are staged within the block and not discarded there: what a result made in it still reads.

    Once that result is written (or not wanted any more), ``discard(*tables)`` frees them.
    """
    tables: list[DataFrame] = []
    _COLLECTING.append(tables)
    try:
        yield tables
    finally:
        _COLLECTING[:] = [x for x in _COLLECTING if x is not tables]


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        for x in _COLLECTING:
            x[:] = [y for y in x if y is not t]
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t._staged)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def numbered(docs: DataFrame, name: str, written: bool = False) -> DataFrame:
    """``__row_id``, a number of each row of ``docs``, and ``__row``, the row itself as one struct; written once.

    A scan that is run again may number its rows differently: its splits follow the number of cores that are there at the time.
    So what joins by row number, in another job than the one that gave the numbers, must take texts and rows from this table.
    As the row is one column, no name of its fields can clash with one of an operator's own; readers still prune its fields.

    ``written``: ``docs`` is a table of files that stay as they are while the result is read, so no copy is needed: a row's number
    is made of its file's number and its place in that file. What is no scan of files is copied all the same.
    """
    if written:
        try:
            return placed(docs)
        except AnalysisException:  # there are no files behind these rows
            pass
    return stage(docs.select(F.monotonically_increasing_id().alias(ROW_ID), F.struct("*").alias(ROW)), name)


def placed(docs: DataFrame) -> DataFrame:
    """Numbers by file and place. The table of files, one short row each, is broadcast."""
    at = docs.metadataColumn("_metadata")
    rows = docs.select(at["file_path"].alias("__file"), at["row_index"].alias("__at"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias(ROW))
    files = rows.select("__file").distinct()
    files = stage(files.select("__file", (F.row_number().over(Window.orderBy("__file")) - 1).cast("long").alias("__nth")).coalesce(1), "files")
    return rows.join(F.broadcast(files), "__file").select((F.shiftleft("__nth", 33) + F.col("__at")).alias(ROW_ID), ROW)


def field(name: str) -> Column:
    """A column of the table that was numbered."""
    return F.col(f"{ROW}.`{name}`")


def unnumbered(rows: DataFrame) -> DataFrame:
    """The columns of the table that was numbered."""
    return rows.select(*[field(c).alias(c) for c in rows.schema[ROW].dataType.names])


def laid_out(rows: DataFrame, lane: list[str], key: list[str], payload: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Places of rows in streams: (units, offsets); ``rows`` has row_id, size, bucket, the lane (its stream), the key and the payload.

    A lane's rows stand in the order of (bucket, key), which comes from the rows alone: neither splits nor cores change it. Rows
    of one key are interchangeable and have one size. A unit is the rows of one key among 131,072 numbers: a key that a third of all
    rows share is many units, and its lists of rows are bounded by that. units: lane, bucket,
    key, n, size, rows (array of row_id and payload), start and rank of its first row within (lane, bucket); offsets: lane, bucket,
    words (the bucket's sum of sizes), n.
    """
    units = rows.groupBy(*lane, "bucket", *key, F.shiftright("row_id", 17).alias("part")).agg(F.first("size").alias("size"), F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("row_id", *payload))).alias("rows"))
    before = Window.partitionBy(*lane, "bucket").orderBy(*key, "part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    units = stage(units.withColumns({"start": so_far(F.col("n") * F.col("size")), "rank": so_far("n")}), name)
    return units, units.groupBy(*lane, "bucket").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("words"), F.sum("n").cast("long").alias("n"))


#: 4 KB bitmaps of row numbers (32,768 numbers each) that may be broadcast: 64 MB.
BITMAPS = 16_384


def with_ids(rows: DataFrame, ids: DataFrame, row_id: str = ROW_ID, keep: bool = True) -> DataFrame:
    """The rows whose number is (or, unless ``keep``, is not) among ``ids`` (one column of the same name, of :func:`numbered`).

    The rows stay where they are: the numbers of a scan are dense, so one bit a row, as a broadcast table of bitmaps, tells which
    are meant. Its size is counted first; beyond BITMAPS of them (5e8 rows) rows and numbers are shuffled to each other.
    """
    maps = stage(ids.groupBy(F.bitmap_bucket_number(row_id).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(row_id)).alias("__bits")), "bitmaps")
    if maps.count() > BITMAPS:
        return rows.join(ids.select(row_id).distinct(), row_id, "left_semi" if keep else "left_anti").select(*rows.columns)
    at = F.bitmap_bit_position(row_id)
    byte = F.conv(F.hex(F.substr("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) > 0, F.lit(False))
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(row_id)).join(F.broadcast(maps), "__bucket", "inner" if keep else "left")
    return met.where(bit if keep else ~bit).select(*rows.columns)


def small_batches(spark: SparkSession, n_bytes: int = 1 << 19) -> None:
    """Bound the bytes of an Arrow batch: whole texts travel in them. Batches of slim rows stay as long as they were."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > n_bytes:
        spark.conf.set(name, f"{n_bytes}b")


#: What operators keep on modules that outlive a task, so that a reused worker need not build it again.
KEPT = {"tokenizers": "_parts", "sentencepiece": "_counts"}


def lean(keep: str = "") -> None:
    """In a Python worker: let go of what other operators' tasks left there, but for what is kept on module ``keep``."""
    for module, name in KEPT.items():
        if module != keep and module in sys.modules:
            sys.modules[module].__dict__.pop(name, None)


def text_of(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ship(__name__)
