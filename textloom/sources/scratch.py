"""Tables that a job stores on its way, in the folder that the driver and all executors share, and what Python workers get at once."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir; a local one only where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors reach")
        base = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='textloom-', dir=os.environ.get('TEXTLOOM_TMP'))}")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, its lineage is cut, and it outlives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bounded_batches(df: DataFrame, rows: int = 500, size: int = 16 << 20) -> DataFrame:
    """df, whose rows are whole texts, before it goes to Python: for the session, workers get at most that many rows and about that many bytes at once."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        have = conf.get(name).lower().removesuffix("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            conf.set(name, str(most))
    return df
