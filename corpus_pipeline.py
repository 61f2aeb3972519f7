"""Corpus pipeline: five stages from raw documents to packed sequences, each written as Parquet and read again.

A stage takes a written table and returns a result that must be written before the next stage is called: what that result reads
besides its input (sketches, links, places) is deleted when the next stage begins. Rows are numbered by file and place, so no stage
copies its input.

Defined cases, for all stages: rows with a null or empty text are ordinary and stay until the mix, which takes nothing of them; null
and repeated ids are rows like others; of equal or near rows one stays (smallest id, null last, then the first row); a null source is
a source; texts of any length are read whole; an empty table stays empty; extra columns pass through all stages but the last.
"""

from __future__ import annotations

import functools
import gc

from askloom.llm import exact_dedup, mixing, near_dup, packing, toxicity
from askloom.llm.common import collecting, discard, read, stage

#: By application: tables that the last stage's result reads.
_LEFT: dict[str, list] = {}


def freeing(f):
    """A stage that deletes what the one before left, whose result is written by now."""

    @functools.wraps(f)
    def run(spark, docs, sf_dir):
        discard(*_LEFT.pop(spark.sparkContext.applicationId, []))
        # Plans, broadcasts and shuffles of the finished stage are freed when they are collected, which an idle driver does late.
        gc.collect()
        spark.sparkContext._jvm.java.lang.System.gc()
        with collecting() as left:
            out = f(spark, docs, sf_dir)
        _LEFT[spark.sparkContext.applicationId] = left
        return out

    return run


@freeing
def drop_toxic(spark, docs, sf_dir):
    """Toxicity: documents scored 0.5 or more go. Labels come from the labels table, counts from all of ``docs``."""
    return toxicity.ordinary(docs, read(spark, sf_dir, "labels"))


@freeing
def drop_copies(spark, docs, sf_dir):
    """Exact dedup: of equal texts one document stays."""
    return exact_dedup.dedup(docs, written=True)


@freeing
def drop_near_copies(spark, docs, sf_dir):
    """MinHash near-dedup: of each group of near copies the document with the smallest id stays."""
    return near_dup.dedup(docs, written=True)


@freeing
def mix_sources(spark, docs, sf_dir):
    """Mixing sources to target weights: each document as often, and as much of it, as the mix takes."""
    return mixing.mixed(docs, written=True)


@freeing
def pack_sequences(spark, docs, sf_dir):
    """Best-fit packing into sequences of 4096 tokens; the last stage: one row per piece with its place and ids."""
    return packing.pack(docs, packing.tokenizer_file()).withColumnRenamed("id", "doc_id").drop("row_id")


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Toxicity and near-dedup stages run models and sketches that SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
            if before is not None:
                discard(before)
            before = docs
    return docs
