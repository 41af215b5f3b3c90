"""Session defaults, and the two things every query needs from a session."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def session(app: str = "inkframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


#: What one Arrow batch holds at most. Spark's defaults let 10,000 long texts through at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Rows that are dealt by page stay where they are for joins on page and region.
PLACING = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package, and set what the caller has not set: bounds of Arrow batches, joins without a needless shuffle."""
    for key, value in (BATCH | PLACING).items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, ROOT) if x)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that all executors read; local mode may do without ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"inkframe-{os.getuid()}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in a new folder that all executors read: it is computed once, and a lost executor costs a reread."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
