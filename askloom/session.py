"""SparkSession factory: ANSI arithmetic, UTC, adaptive execution with skew handling."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; ``conf`` keys use ``__`` for dots."""
    b = SparkSession.builder.appName("askloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for files in between: spark.checkpoint.dir; a temporary one where that is unset in local mode (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.askloom.workdir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="askloom-")
        spark.conf.set("spark.askloom.workdir", shared)
    return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
