"""Helpers that the operators of this subpackage share: table reads, shared scratch tables, let-bindings."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_own: dict[str, str] = {}


def bounded_batches(spark: SparkSession, rows: int = 500, size: int = 16 << 20) -> None:
    """Rows are whole texts here: Python workers get at most that many rows and about that many bytes at once."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        have = spark.conf.get(name).lower().removesuffix("b")
        if not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(name, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which every executor reaches; a local one where that is unset and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: it has to name a folder that the driver and all executors reach")
        base = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='textloom-', dir=os.environ.get('TEXTLOOM_TMP'))}")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While it lasts, Python workers get that many rows at once, where rows are short."""
    bounded_batches(spark)
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(rows or before))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def written(df: DataFrame, label: str, batch_rows: int | None = None, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    batch_rows: rows that Python workers get at once, where rows are short. options: of the writer.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession, label)
    with batches_of(spark, batch_rows):
        df.write.options(**options).parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() gave, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        store, path = fs.FileSystem.from_uri(folder)
        store.delete_dir(path)


def with_keyed(rows: DataFrame, keyed: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows and, by inner join, the columns of keyed: a row for each key that occurs, n of which says how many rows have it; n goes. Keys have no nulls.

    Keys with more than 1 / share of all rows are fewer than share, so they are broadcast and their rows stay where they
    are; all others meet in a shuffle.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    hot = keyed.filter(F.col("n") * share > total).drop("n")
    rest = keyed.filter(F.col("n") * share <= total).drop("n")
    return rows.join(F.broadcast(hot), keys).unionByName(rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the optimiser does with the projections around it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
