"""Triage and audit of sources by name, size and content (FLT-07..09, FLT-23, JON-11, JON-14, AGG-11, AGG-12, SRT-04, PIP-05, PIP-06)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.measures import NUMBERED, document_noise
from textloom.sources.scratch import bounded_batches

# What file names say, where a category goes, and what is to be done with it.
BOOK_NAME = "книга|справочник|руководство|терапия|психотерапия|сексология|женщина|мужчина"
TEST_NAME = r"(?:^|[_\-\s])(?:test|тест)(?:[_\-\s.]|$)"
REPORT_NAME = "preprocessing_report"
BIBLIOGRAPHY_NAME = "литература"
DOCUMENTS = ("txt", "md", "docx", "doc", "pdf")
TARGETS = {"good_source": "good", "book_theory": "good", "article": "good", "test": "tests", "questionnaire": "surveys", "exercise": "exercises", "bibliography": "bibliography", "ocr_required": "ocr_required", "ocr_noise": "trash", "duplicate": "unclear", "unclear": "unclear"}
ACTIONS = {"duplicate": "review_duplicate_do_not_ingest", "ocr_required": "copy_to_ocr_queue", "ocr_noise": "copy_for_manual_review", "unclear": "copy_for_manual_review", "good_source": "copy_to_source_bucket_then_prepare_cleaning", "book_theory": "copy_to_source_bucket_then_prepare_cleaning", "article": "copy_to_source_bucket_then_prepare_cleaning"}
SPECIAL = "copy_to_specialized_bucket"


def _ladder(rows: list[tuple[Column, str, Column]], value: str) -> Column:
    cases = [(test, F.struct(F.lit(name).alias(value), F.round(sure.cast("double"), 6).alias("confidence"))) for test, name, sure in rows]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)\.([^.]*)$", 1))


def source_kind(name: Column) -> Column:
    """FLT-23."""
    return F.when(extension(name) == "pdf", "pdf").when(extension(name) == "docx", "docx").otherwise("text")


def anchor(pattern: str) -> str:
    """The longest literal that every match of a simple pattern holds, lower-cased; empty where none is sure."""
    if re.search(r"[|?*{\\]", pattern):
        return ""
    return max(re.split(r"\[[^\]]*\]|[.^$()+]", pattern.lower()), key=len)


def rules_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """(family, pattern, anchor) of a lexicon."""
    return spark.createDataFrame([(k, p, anchor(p)) for k, patterns in lexicon.items() for p in patterns], "family string, pattern string, anchor string")


def rule_counts(df: DataFrame, rules: DataFrame, text: Column, most: int = 20_000) -> DataFrame:
    """JON-11: df with a column for each family of rules (family, pattern, anchor): the matches of its patterns in text, in any case.

    The rules go to every task, so a table of over ``most`` rows is refused. One automaton finds the anchors in a text, and only patterns
    whose anchor is there, or that have none, are tried.
    """
    rows = rules.select("family", "pattern", F.lower(F.coalesce("anchor", F.lit(""))).alias("anchor")).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rules: they don't fit every task")
    families = sorted({r["family"] for r in rows})
    if not families:
        return df

    @F.pandas_udf(T.StructType([T.StructField(f, T.IntegerType()) for f in families]))
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seek = ahocorasick.Automaton()
        tests = [(families.index(r["family"]), re.compile(r["pattern"], re.I)) for r in rows]
        by_anchor: dict[str, list[int]] = {}
        for k, r in enumerate(rows):
            by_anchor.setdefault(r["anchor"], []).append(k)
        free = by_anchor.pop("", [])
        for word, numbers in by_anchor.items():
            seek.add_word(word, numbers)
        seek.make_automaton()
        for b in batches:
            found = np.zeros((len(b), len(families)), np.int32)
            for row, t in enumerate(b):
                low = t.lower()
                tried = {k for _, numbers in (seek.iter(low) if by_anchor else []) for k in numbers}
                for k in [*free, *tried]:
                    family, test = tests[k]
                    found[row, family] += sum(1 for _ in test.finditer(low))
            yield pd.DataFrame(found, columns=families)

    out = bounded_batches(df).withColumn("__rules", counted(F.coalesce(text, F.lit(""))))
    return out.select(*df.columns, *[F.col(f"__rules.{f}").alias(f) for f in families])


def measured(df: DataFrame, lexicon: dict[str, list[str]] | DataFrame, text: str = "text", name: str = "filename") -> DataFrame:
    """JON-11: df with the counts of each family of the rules over lower-cased name and text, numbered items, noise, chars, ext.

    A small lexicon becomes columns; a rules table goes through rule_counts(). Either way each text is read once.
    """
    full = F.concat(F.lower(name), F.lit("\n"), F.lower(text))
    if isinstance(lexicon, DataFrame):
        df = rule_counts(df, lexicon, full)
    else:
        count = lambda patterns: reduce(lambda a, b: a + b, [F.regexp_count(full, F.lit(f"(?iu){p}")) for p in patterns])
        df = df.withColumns({k: count(p) for k, p in lexicon.items()})
    return df.withColumns({"numbered": F.regexp_count(text, F.lit("(?m)" + NUMBERED)), "noise": document_noise(F.col(text)), "chars": F.length(text), "ext": extension(F.col(name)), "low": F.lower(name)})


def category() -> Column:
    """FLT-07 over measured() columns, duplicate and size: struct of category and confidence; all fifteen rows."""
    c, low, pdf = F.col, F.col("low"), F.col("ext") == "pdf"
    density = c("bib") / F.greatest(c("chars") / 10_000, F.lit(1.0))
    few = lambda x, n: F.least(x, F.lit(n))
    return _ladder([
        (c("duplicate"), "duplicate", F.lit(0.98)),
        (pdf & (c("chars") == 0), "ocr_required", F.lit(0.92)),
        (low.contains(REPORT_NAME), "unclear", F.lit(0.82)),
        ((c("chars") > 2000) & (c("noise") >= 0.56) & (c("theory") < 5), "ocr_noise", F.round(0.75 + few(c("noise") - 0.56, 0.2), 2)),
        (((c("bib") >= 8) & ((c("chars") < 25_000) | (density >= 7) | (c("theory") < 8))) | (low.contains(BIBLIOGRAPHY_NAME) & (c("bib") >= 2)), "bibliography", few(0.65 + c("bib") / 100, 0.95)),
        ((c("size") >= 500 << 10) & (low.rlike(BOOK_NAME) | (c("theory") >= 15)), "book_theory", F.lit(0.84)),
        (low.rlike(TEST_NAME), "test", F.lit(0.86)),
        ((c("quest") >= 2) | ((c("quest") >= 1) & (c("numbered") >= 8)), "questionnaire", few(0.66 + c("quest") / 30 + few(c("numbered"), 30) / 100, 0.96)),
        ((c("test") >= 4) | ((c("test") >= 2) & (c("numbered") >= 10)), "test", few(0.62 + c("test") / 40 + few(c("numbered"), 40) / 120, 0.95)),
        ((c("exer") >= 4) | ((c("exer") >= 2) & (c("numbered") >= 6)), "exercise", few(0.6 + c("exer") / 40, 0.9)),
        (pdf & (c("size") >= 5 << 20), "book_theory", F.when(low.rlike(BOOK_NAME), 0.82).otherwise(0.68)),
        ((c("chars") >= 8000) & (c("theory") >= 8), "good_source", few(0.62 + c("theory") / 100, 0.9)),
        ((c("chars") >= 1500) & ((c("article") >= 1) | (c("theory") >= 4)), "article", few(0.58 + (c("article") + c("theory")) / 80, 0.84)),
        ((c("chars") == 0) & (c("ext") == "doc"), "unclear", F.lit(0.45)),
        (F.lit(True), "unclear", F.lit(0.5)),
    ], "category")


def _looked_up(key: Column, table: dict[str, str], other: str | None = None) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if other is None else F.coalesce(found, F.lit(other))


def triage(df: DataFrame, lexicon: dict[str, list[str]] | DataFrame) -> DataFrame:
    """PIP-05, FLT-09, JON-14: df (filename, text, size, duplicate, ...) with category, confidence, action and target."""
    d = measured(df, lexicon).withColumn("__c", category()).select(*df.columns, "__c.category", "__c.confidence")
    return d.withColumns({"action": _looked_up(F.col("category"), ACTIONS, SPECIAL), "target": F.concat(F.lit("sorted_sources/"), _looked_up(F.col("category"), TARGETS))})


def audit_hint() -> Column:
    """FLT-08 over measured() columns and size."""
    c, low, document = F.col, F.col("low"), F.col("ext").isin(*DOCUMENTS)
    cases = [
        ((c("test") >= 3) | ((c("test") >= 1) & (c("numbered") >= 15)), "test_or_questionnaire"), ((c("bib") >= 5) | low.contains(BIBLIOGRAPHY_NAME), "bibliography_like"), (c("exer") >= 3, "exercise_like"),
        ((c("ext") == "pdf") & (c("size") >= 5 << 20), "book_like"), (low.rlike(BOOK_NAME) & (c("size") >= 300 << 10), "book_like"), (document & (c("size") >= 20 << 10), "source_doc_like"), (document, "small_source_or_unclear"),
    ]
    return reduce(lambda out, case: out.when(case[0], case[1]), cases[1:], F.when(*cases[0])).otherwise("non_source_or_unclear")


def roll_ups(df: DataFrame, folder: str, ext: str, size: str) -> DataFrame:
    """AGG-11: (folder, ext, files, bytes, kb), a row for each folder and one for each extension, in one pass."""
    df = df.withColumns({folder: F.coalesce(folder, F.lit("")), ext: F.coalesce(F.nullif(F.col(ext), F.lit("")), F.lit("<no_ext>"))})
    by = df.groupingSets([[folder], [ext]], folder, ext).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return by.select(F.coalesce(folder, F.lit("")).alias("folder"), F.coalesce(ext, F.lit("")).alias("ext"), "files", "bytes", F.round(F.col("bytes") / 1024, 1).alias("kb"))
