"""Numbers in order over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.sources.scratch import stored


def numbered(df: DataFrame, by: list[str], order: str, name: str, buckets: int | None = None) -> DataFrame:
    """df with name, 1, 2, 3 .. in order, of any type, among the rows of equal ``by``; nulls first, ties in any order.

    Spark deals the rows out by ranges of (by, order), so a key that a third of all rows share has many ranges. A row's place in its range
    and the counts of its key's rows in the ranges before give its number: a row for each key and range. buckets: ranges, if not as many as
    shuffles have.
    """
    keys = [*by, order]
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(*([buckets] if buckets else []), *keys, "__tie").sortWithinPartitions(*keys).drop("__tie")
    dealt = stored(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "numbered")
    sizes = dealt.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*by).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__range"), (before - F.col("__first") + 1).alias("__shift"))
    same = F.col("__part") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = dealt.join(offsets, same).withColumn(name, F.col("__at") + F.col("__shift"))
    return out.drop("__part", "__at", "__range", "__shift", *[f"__{c}" for c in by])
