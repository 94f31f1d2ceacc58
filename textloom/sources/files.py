"""Scans (SRC-*)."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that a scan passes by, and the extensions that it takes.
PROTECTED = ("cleaned", "test-ingestion", ".git", "node_modules", "__pycache__")
EXTENSIONS = ("txt", "md", "markdown", "csv", "docx", "pdf")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def files(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """SRC-01..03: (path, title, ext, length, modified, content) of the files below path."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    df = df.withColumn("ext", extension(F.col("path"))).filter(F.col("ext").isin(*extensions))
    df = df.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, protected))))
    return df.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("title"), "ext", "length", F.col("modificationTime").alias("modified"), "content")


def docx_text(raw: bytes, joint: str = "\n\n") -> str:
    """SRC-06 for one file."""
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return joint.join(filter(None, ("".join(x.text or "" for x in p.iter(f"{ns}t")).strip() for p in root.iter(f"{ns}p"))))


def texts(df: DataFrame, chars: int | None = None) -> DataFrame:
    """SRC-04..07: files with text and warnings; invalid bytes become U+FFFD, PDFs are routed to ocr_required, others that can't be read have a warning and an empty text."""
    plain = F.make_valid_utf8(F.col("content").cast("string"))

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, bad = [], []
            for raw in b["content"]:
                try:
                    out.append(docx_text(raw))
                    bad.append(None)
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    out.append("")
                    bad.append(f"docx: {type(e).__name__}")
            yield b.drop(columns="content").assign(text=out, warning=bad)

    kept = [f for f in df.schema.fields if f.name != "content"]
    schema = T.StructType([*kept, T.StructField("text", T.StringType()), T.StructField("warning", T.StringType())])
    docx = df.filter("ext = 'docx'").mapInPandas(extracted, schema)
    rest = df.filter("ext != 'docx'").withColumn("text", F.when(F.col("ext") == "pdf", "").otherwise(plain)).withColumn("warning", F.when(F.col("ext") == "pdf", "ocr_required")).drop("content")
    out = rest.unionByName(docx)
    return out.withColumn("text", F.substring("text", 1, chars)) if chars else out


def json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """SRC-08, SRC-09."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def sessions(spark: SparkSession, path: str, status: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-11."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).filter(F.col("status") == status)


def newest_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """SRC-12: the rows of the file that was changed last; a byte order mark is no part of the first column's name."""
    df = None
    for p in paths:
        one = spark.read.option("header", True).csv(p)
        one = one.select(*[F.col(f"`{c}`").alias(c.lstrip("\ufeff")) for c in one.columns], F.col("_metadata.file_modification_time").alias("__at"))
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
    last = df.agg(F.max("__at").alias("__last"))
    return df.join(F.broadcast(last), F.col("__at") == F.col("__last")).drop("__at", "__last")


def sidecars(df: DataFrame, key: str = "title", text: str = "text") -> DataFrame:
    """SRC-10: (key, metadata) of JSON sidecar texts; one that is no object gives an empty map."""
    return df.select(key, F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"))


def last_texts(df: DataFrame, key: str, text: str, *order: str) -> DataFrame:
    """SRC-14: one text for each id, the last in order."""
    return df.groupBy(key).agg(F.max_by(text, F.struct(*order)).alias(text))


def with_sidecar(df: DataFrame, sidecar: DataFrame, key: str) -> DataFrame:
    """SRC-10, JON-02: sidecar metadata where there is any, else an empty map."""
    return df.join(sidecar.select(key, "metadata"), key, "left").withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def articles(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """SRC-13: a table of articles, one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scenario_vectors(spark: SparkSession, path: str, scenario: str) -> DataFrame:
    """SRC-15: the vectors of one scenario; the store is partitioned by it, so others aren't read."""
    return spark.read.parquet(path).filter(F.col("scenario") == scenario)


def scan_roots(spark: SparkSession, *roots: str, **how) -> DataFrame:
    """SET-01: files() of several roots, with their root; a file below two of them is met once, under the first."""
    found = None
    for k, root in enumerate(roots):
        one = files(spark, root, **how).withColumn("root", F.struct(F.lit(k).alias("n"), F.lit(root).alias("path")))
        found = one if found is None else found.unionByName(one)
    first = found.groupBy("path").agg(F.min("root").alias("first"))
    return found.join(first, "path").filter(F.col("root") == F.col("first")).withColumn("root", F.col("root.path")).drop("first")
