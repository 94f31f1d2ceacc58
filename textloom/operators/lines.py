"""Operators over the lines of documents (D3, NRM-08, NRM-12, AGG-09)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import hash_key, is_navigation, let


def lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line)."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4, shortest: int = 5, longest: int = 120) -> DataFrame:
    """NRM-08, AGG-09: (key, line, n) of the trimmed lines that a document repeats like a header or footer."""
    x = lines(df, key, text).select(key, F.trim("line").alias("line")).filter(F.length("line").between(shortest, longest) & ~F.col("line").endswith("."))
    x = x.filter(F.size(F.array_distinct(F.split(F.lower("line"), r"\s+"))) >= 2)
    return x.groupBy(key, "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _met_again(sorted_values: Column, times: int = 2) -> Column:
    """The distinct values that stand at least ``times`` times in a sorted array."""
    return F.array_distinct(F.filter(sorted_values, lambda x, i: (i >= times - 1) & (F.get(sorted_values, i - times + 1) == x)))


def without_repeated_lines(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 4, shortest: int = 5, longest: int = 120) -> DataFrame:
    """NRM-08: df with its text free of repeated_lines(), and with them as removed_lines, sorted. Lines never leave their row."""
    short = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    some = F.sort_array(F.filter(short, lambda x: F.length(x).between(shortest, longest) & ~x.endswith(".")))
    found = F.filter(let(some, lambda x: _met_again(x, least)), lambda x: F.size(F.array_distinct(F.split(F.lower(x), r"\s+"))) >= 2)
    df = df.withColumn("removed_lines", F.coalesce(found, F.array().cast("array<string>")))
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("removed_lines", F.trim(x))), "\n")
    return df.withColumn(text, F.when(F.size("removed_lines") > 0, kept).otherwise(F.col(text)))


def clean_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """NRM-12: (key, cleaned, navigation, repeated, empty): lines without navigation and later repeats, one blank for each run of blanks.

    All in the document's row. A line is looked up among the earlier ones only if its key stands in the text twice.
    """
    rows = F.transform(F.split(text, "\r?\n"), lambda x: let(F.regexp_replace(x, r"^\s+|\s+$", ""), lambda line: F.struct(line.alias("line"), hash_key(line).alias("k"), is_navigation(line).alias("nav"))))

    def marked(rows: Column) -> Column:
        keys = F.transform(rows, lambda r: F.when(r["nav"], "").otherwise(r["k"]))
        again = lambda keys, often: F.transform(rows, lambda r, i: (r["k"] != "") & ~r["nav"] & F.array_contains(often, r["k"]) & (F.array_position(keys, r["k"]) <= i))
        return let(keys, lambda keys: let(_met_again_of(keys), lambda often: F.arrays_zip(rows.alias("r"), again(keys, often).alias("again"))))

    def result(found: Column) -> Column:
        kept = F.transform(F.filter(found, lambda x: ~x["r"]["nav"] & ~x["again"]), lambda x: x["r"]["line"])
        text = let(kept, lambda kept: F.array_join(F.filter(kept, lambda x, i: (x != "") | (i == 0) | (F.get(kept, i - 1) != "")), "\n"))
        count = lambda test: F.size(F.filter(found, test)).cast("long")
        return F.struct(text.alias("cleaned"), count(lambda x: x["r"]["nav"]).alias("navigation"), count(lambda x: x["again"]).alias("repeated"), count(lambda x: x["r"]["k"] == "").alias("empty"))

    return df.select(key, let(rows, lambda r: let(marked(r), result)).alias("x")).select(key, "x.*")


def _met_again_of(values: Column) -> Column:
    return let(F.sort_array(values), _met_again)
