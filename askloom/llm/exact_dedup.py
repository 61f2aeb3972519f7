"""Exact dedup by progressive refinement: length, then a hash of the first characters, then a full hash.

Native: DataFrame functions only. Two texts are equal when they are identical after each run of ASCII white space became one
space. The refinement only compares what still collides: rows whose (length, prefix hash) is unique are settled without a full
hash (unless the caller wants digests of all rows); the full SHA-256 is grouped for the survivors alone.

Defined cases: a null text counts as empty; of equal texts the row with the smallest id stays (a null id comes last); of
repeated rows with that same id exactly one stays; an empty table gives an empty result; other columns are ignored.

Scale: no group is ever gathered and no text is shuffled. Groups are partially aggregated counts and minima of slim rows, so a
group with a third of all rows costs one row a task. Rows that a level settles are told from the others by their numbers
(``common.with_ids``), not by a join on what they have in common; survivors' texts are read, and dropped rows left out, in scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW_ID, SPACE, discard, field, numbered, read, stage, text_of, unnumbered, with_ids

PREFIX = 256  # characters under the prefix hash


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def survivors(slim: DataFrame) -> DataFrame:
    """The rows of ``slim`` whose length and prefix hash occur more than once: levels one and two."""
    alone = slim.groupBy("n_bytes", "head").agg(F.count("*").alias("n"), F.min("row_id").alias("row_id")).where("n = 1")
    return with_ids(slim, alone.select("row_id"), "row_id", keep=False)


def groups(crowd: DataFrame) -> DataFrame:
    """n_bytes, digest, group_size, first (the row that stays) of every group of equal texts."""
    order = F.struct(F.col("id").isNull().alias("last"), "id", "row_id")
    return crowd.groupBy("n_bytes", "digest").agg(F.count("*").alias("group_size"), F.min(order).alias("first"))


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row_id, id, keep_id, group_size, kept, digest (binary SHA-256 of the normalised text).

    As every row gets its digest, texts are hashed in the one scan, and the levels only thin what is grouped; see :func:`dedup`.
    """
    norm = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    slim = stage(norm.select("row_id", "id", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"), F.unhex(F.sha2("norm", 256)).alias("digest")), "exact-sketch")
    several = stage(groups(survivors(slim)).where("group_size > 1"), "exact-groups")
    # Merged, so that the rows of one large group are split between tasks.
    return slim.join(several.hint("merge"), ["n_bytes", "digest"], "left").select(
        "row_id",
        "id",
        F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("first.row_id") == F.col("row_id"), F.lit(True)).alias("kept"),
        "digest",
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", written: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged. Only texts that share length and prefix are read a second time and hashed."""
    rows = numbered(docs, "exact-rows", written)
    norm = rows.select(F.col(ROW_ID).alias("row_id"), normalised(field(text_col)).alias("norm"))
    slim = stage(norm.select("row_id", F.octet_length("norm").alias("n_bytes"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head")), "exact-sketch")
    asked = stage(survivors(slim).select(F.col("row_id").alias(ROW_ID)), "exact-survivors")
    read_again = with_ids(rows, asked).select(F.col(ROW_ID).alias("row_id"), field(id_col).alias("id"), normalised(field(text_col)).alias("norm"))
    crowd = stage(read_again.select("row_id", "id", F.octet_length("norm").alias("n_bytes"), F.unhex(F.sha2("norm", 256)).alias("digest")), "exact-digests")
    discard(slim, asked)
    dropped = with_ids(crowd, groups(crowd).select("first.row_id"), "row_id", keep=False).select(F.col("row_id").alias(ROW_ID))
    return unnumbered(with_ids(rows, dropped, keep=False))


def query(spark, sf_dir: str) -> DataFrame:
    return duplicates(read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
