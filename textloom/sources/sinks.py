"""Sinks and plans for them (SNK-*). A plan is a DataFrame; applying it is the write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered
from textloom.operators.validate import guarded


def write_json_by(df: DataFrame, path: str, by: str) -> None:
    """SNK-01."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def write_report(df: DataFrame, path: str, fields: list[str]) -> None:
    """SNK-03: a CSV report with a fixed field list; nested values as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in fields]).write.mode("overwrite").option("header", True).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """SNK-04: a one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, heading: str, body: list[str], title: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """SNK-05: (part, value): with a title first a summary of the one-row totals, then a section for each row, in order of its heading."""
    said = lambda c: F.concat(F.lit(f"- {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")))
    out = df.select(F.concat(F.lit("1 "), F.col(heading).cast("string")).alias("part"), F.concat_ws("\n", F.concat(F.lit("## "), F.col(heading).cast("string")), *map(said, body), F.lit("")).alias("value"))
    if title is not None and totals is not None:
        out = totals.select(F.lit("0").alias("part"), F.concat_ws("\n", F.lit(f"# {title}"), *map(said, totals.columns), F.lit("")).alias("value")).unionByName(out)
    return out.orderBy("part")


def append_new(df: DataFrame, spark: SparkSession, path: str, key: str) -> None:
    """SNK-06, SNK-07: append the rows whose key isn't there yet."""
    try:
        df = df.join(spark.read.parquet(path).select(key), key, "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    df.write.mode("append").parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """SNK-08: rows of df replace those of the same partitions, and of no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def dense_ids(df: DataFrame, order: str, name: str = "vector_id") -> DataFrame:
    """SNK-09, WIN-09: 0, 1, 2 .. in order."""
    return numbered(df, [], order, name).withColumn(name, F.col(name) - 1)


def copy_plan(df: DataFrame, target: str, filename: str, order: str) -> DataFrame:
    """SNK-10, SNK-11: target_name, with __n before the extension where a name is taken, and status."""
    n = F.col("__n_same")
    stem, ext = F.regexp_extract(filename, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(filename, r"^(.*?)(\.[^.]*)?$", 2)
    df = numbered(df, [target, filename], order, "__n_same")
    return df.withColumn("target_name", F.when(n == 1, F.col(filename)).otherwise(F.concat(stem, F.lit("__"), (n - 1).cast("string"), ext))).withColumn("status", F.when(n == 1, "planned").otherwise("renamed")).drop("__n_same")


def rollback_manifest(plan: DataFrame, source: str, target: str, target_name: str) -> tuple[DataFrame, DataFrame]:
    """SNK-11: (operations, manifest): what is done, and what takes it back."""
    to = F.concat_ws("/", target, target_name)
    return plan.select(F.col(source).alias("source"), to.alias("destination"), "status"), plan.select(to.alias("delete"), F.col(source).alias("was"))


def put_fields(df: DataFrame, updates: DataFrame, key: str, column: str, field: str) -> DataFrame:
    """SNK-13: the struct's field from updates where there is one."""
    out = df.join(updates.select(key, F.col(field).alias("__new")), key, "left")
    return out.withColumn(column, F.col(column).withField(field, F.coalesce("__new", F.col(f"{column}.{field}")))).drop("__new")


def extend_expiry(users: DataFrame, updates: DataFrame, key: str, now, days: int = 3) -> DataFrame:
    """SNK-16."""
    hit = updates.select(key).distinct().withColumn("__u", F.lit(True))
    later = F.coalesce("expires_at", now) + F.expr(f"INTERVAL {days} DAYS")
    return users.join(hit, key, "left").withColumn("expires_at", F.when(F.col("__u"), later).otherwise(F.col("expires_at"))).drop("__u")


def publish(df: DataFrame, root: str, version: str, production: str | None = None, checks: DataFrame | None = None) -> None:
    """SNK-14, VAL-06: a version's folder first, then a pointer to it, with the version before as its backup.

    checks: the one row of manifest_checks() (VAL-02); nothing is written unless it is ok.
    """
    if checks is not None and not (found := checks.first())["ok"]:
        raise ValueError(f"version {version} fails its checks: {found['errors']}")
    df.write.parquet(guarded(f"{root}/version={version}", production or f"{root}/current"))
    point(df.sparkSession, root, version)


def pointers(spark: SparkSession, root: str) -> DataFrame | None:
    """(version, backup, at) of what was published and rolled back, if anything was."""
    try:
        return spark.read.schema("version string, backup string, at timestamp").parquet(f"{root}/pointers")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def _last(found: DataFrame | None) -> Row | None:
    return None if found is None else found.agg(F.max_by(F.struct("version", "backup"), "at").alias("x")).first()["x"]


def point(spark: SparkSession, root: str, version: str) -> None:
    """A pointer to a version; its backup is the version that was current."""
    before = _last(pointers(spark, root))
    row = spark.range(1).select(F.lit(version).alias("version"), F.lit(before and before["version"]).cast("string").alias("backup"), F.current_timestamp().alias("at"))
    row.write.mode("append").parquet(f"{root}/pointers")


def roll_back(spark: SparkSession, root: str) -> str:
    """VAL-06: points to the backup of the current version, and names it."""
    last = _last(pointers(spark, root))
    if last is None or last["backup"] is None:
        raise ValueError(f"{root} has no version to roll back to")
    point(spark, root, last["backup"])
    return last["backup"]


def current(spark: SparkSession, root: str) -> DataFrame:
    """WIN-17: the version that the last pointer names."""
    return spark.read.parquet(f"{root}/version={_last(pointers(spark, root))['version']}")
