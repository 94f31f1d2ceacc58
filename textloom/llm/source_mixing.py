"""Mixing sources to target weights by Poisson replication, in DataFrame expressions only.

A source with share w of the target and size n of a whole N has the mean repetition rate w * N / n. Each document
draws its number of copies by inverting the Poisson distribution of that rate at a uniform number hashed from the
seed and its id, so a rerun, a retry or another partitioning draws the same. Copies are exploded and dealt over all
partitions by a hash of (seed, id, copy), and sorted by that hash within them.

Defined cases: null and empty texts count as size 0 but are drawn like others; a null source is a source of its
own; a null id draws as an empty one; repeated rows draw the same number of copies each; a source of size 0 gets
rate 1; an empty table gives an empty result; further columns are kept, and those named like the three that are
added (copy, rate, mix_key) are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import let, table, text_or_empty, written

#: A Poisson draw of a higher rate is a sum of draws of at most this one; 80 terms leave less than 2**-52 of its tail.
PART_RATE, TERMS = 16, 80
#: Characters, or whatever a document's size is, that one partition of the result holds.
PARTITION = 64 << 20


def uniform(*parts: Column) -> Column:
    """[0, 1) in steps of 2**-52, from the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0 .. TERMS of a Poisson X."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda a: a["c"])


def rates(df: DataFrame, source: str, size: Column, weight: Column | None = None, target: float = 1.0) -> DataFrame:
    """One row for each source: rate, parts and the distribution's table. weight: of a source, from ``size`` and ``source``; by default the root of its size."""
    by = df.groupBy(F.col(source).alias("__source")).agg(F.sum(size).alias("size"))
    by = by.withColumn("weight", F.sqrt(F.col("size").cast("double")) if weight is None else weight)
    whole = by.agg(F.struct(F.sum("size").alias("size"), F.sum("weight").alias("weight")).alias("all")).scalar()
    rate = F.when(F.col("size") > 0, F.lit(target) * (F.col("weight") / whole["weight"]) * whole["size"] / F.col("size")).otherwise(F.lit(1.0))
    by = by.withColumn("rate", rate).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_RATE)).cast("int"))
    return by.withColumn("cdf", cumulative(F.col("rate") / F.col("parts"))).select("__source", "size", "rate", "parts", "cdf")


def mix(df: DataFrame, *, key: str = "doc_id", source: str = "source", size: Column | None = None, weight: Column | None = None, target: float = 1.0, seed: int = 42, partitions: int | None = None) -> DataFrame:
    """The rows of df, each as often as it is drawn, with copy (from 1), rate and mix_key, dealt and sorted by mix_key.

    partitions: by default as many as give each about PARTITION of the size that is drawn, and no fewer than Spark's own number.
    """
    df = df.drop("copy", "rate", "mix_key")
    kept = df.columns
    by = written(rates(df, source, F.length(text_or_empty()) if size is None else size, weight, target), "rates")  # a row for each source
    if partitions is None:
        out = by.agg(F.sum(F.col("size") * F.col("rate"))).first()[0] or 0.0
        partitions = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(out / PARTITION))
    drawn = lambda j: let(uniform(F.lit(seed), F.col(key), j), lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda n, j: n + drawn(j))
    out = df.join(by.drop("size"), F.col(source).eqNullSafe(F.col("__source"))).withColumn("__n", copies).filter("__n > 0")
    out = out.select(*kept, "rate", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))
    mix_key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return out.withColumn("mix_key", mix_key).repartition(partitions, "mix_key").sortWithinPartitions("mix_key")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "copy", "mix_key", "text")


OP3_SQL = """
WITH RECURSIVE s AS (
  SELECT source, sum(length(coalesce(text, ''))) AS size, sqrt(CAST(sum(length(coalesce(text, ''))) AS DOUBLE)) AS weight FROM documents GROUP BY source
), r AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * (weight / (SELECT sum(weight) FROM s)) * CAST((SELECT sum(size) FROM s) AS DOUBLE) / CAST(size AS DOUBLE) ELSE 1.0::DOUBLE END AS rate FROM s
), q AS (
  SELECT source, CAST(greatest(1, ceil(rate / 16)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 16)) AS part_rate FROM r
), p AS (
  SELECT source, 0 AS k, exp(-part_rate) AS p, exp(-part_rate) AS c, part_rate FROM q
  UNION ALL SELECT source, k + 1, p * part_rate / (k + 1), c + p * part_rate / (k + 1), part_rate FROM p WHERE k < 80
), cdf AS (
  SELECT source, list(c ORDER BY k) AS cdf FROM p GROUP BY source
), d AS (
  SELECT d.doc_id, d.source, d.text, unnest(range(1, parts + 1)) AS j, cdf FROM documents d JOIN q ON d.source IS NOT DISTINCT FROM q.source JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source
), n AS (
  SELECT doc_id, source, text, sum(len(list_filter(cdf, lambda c: c <= CAST('0x' || substr(md5('42:' || doc_id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE))) AS n
  FROM d GROUP BY doc_id, source, text
)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('42:order:' || doc_id || ':' || copy) AS mix_key, text
FROM (SELECT doc_id, source, text, unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy FROM n)
"""
