"""The document cleaning job (NRM-10, AGG-03..05, AGG-25, FLT-19, FLT-24, SET-04, SNK-02, PIP-01, PIP-08)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.measures import cleaner_action, cleaner_score, cleaner_signals, quality_label, tokens_by_chars
from textloom.functions.text import clean_artifacts, clean_spaces, join_hyphens, mend_lines, nfkc, page_markers_dropped, strip_junk, tidy
from textloom.operators.lines import clean_lines, without_repeated_lines
from textloom.operators.stabilize import with_blocks
from textloom.sources.scratch import bounded_batches

EXAMPLES = 5
KEPT = ("keep_theory", "keep_clinical", "keep_narrative")


def normalized(df: DataFrame, key: str = "doc_id", text: str = "text", preserve_paragraphs: bool = False) -> DataFrame:
    """NRM-10: df with its text normalised, page_markers_removed and removed_lines."""
    df = df.withColumn("__kept", page_markers_dropped(clean_spaces(F.col(text))))
    df = df.withColumns({text: F.col("__kept.text"), "page_markers_removed": F.col("__kept.dropped")}).drop("__kept")
    df = without_repeated_lines(df, key, text)
    return df.withColumn(text, clean_artifacts(mend_lines(F.col(text)), preserve_paragraphs))


def examples(blocks: DataFrame, key: str = "doc_id", n: int = EXAMPLES) -> DataFrame:
    """AGG-04: the first n blocks of each document and action; kept ones only of a kept label."""
    some = blocks.filter((F.col("action") != "keep") | F.col("label").isin(*KEPT))
    return some.withColumn("place", F.row_number().over(W.partitionBy(key, "action").orderBy("block_index"))).filter(F.col("place") <= n)


def warnings(text: Column, cleaned: Column, unclear: Column) -> Column:
    """FLT-19."""
    return F.array_compact(F.array(
        F.when(text == "", "empty_or_unreadable_source"),
        F.when(unclear > 0, F.concat(F.lit("review_unclear_blocks:"), unclear.cast("string"))),
        F.when((text != "") & (F.length(cleaned) < 0.35 * F.length(text)), "large_removal_ratio_review_recommended"),
    ))


def cleaned(df: DataFrame, classify: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text", preserve_paragraphs: bool = False) -> tuple[DataFrame, DataFrame]:
    """PIP-01: (reports, blocks). classify: blocks (key, block_index, heading, text) -> the same with label, action and confidence.

    A report has counts, confidence (AGG-02), labels of both actions, warnings and the kept text, its blocks in order (AGG-05).
    """
    df = df.withColumn(text, F.coalesce(text, F.lit("")))
    blocks = classify(with_blocks(normalized(df.select(key, text), key, text, preserve_paragraphs), key, text))
    keep, weight = F.col("action") == "keep", F.greatest(F.length(text), F.lit(1))
    kept = F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("block_index", text)))), lambda x: x[text])
    labels = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("label"))))
    by = blocks.groupBy(key).agg(F.count("*").alias("blocks"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("rejected"), F.count_if(F.col("label") == "review_unclear").alias("unclear"), F.round(F.sum(F.col("confidence") * weight) / F.sum(weight), 2).alias("confidence"), labels(keep).alias("labels_kept"), labels(~keep).alias("labels_removed"), F.array_join(kept, "\n\n").alias("_cleaned_text"))
    out = df.join(by, key, "left").fillna({"blocks": 0, "kept": 0, "rejected": 0, "unclear": 0, "confidence": 0.0, "_cleaned_text": ""})
    chars = {"chars_before": F.length(text), "chars_after": F.length("_cleaned_text"), "warnings": warnings(F.col(text), F.col("_cleaned_text"), F.col("unclear"))}
    return out.withColumns(chars).drop(text), blocks


def public(df: DataFrame) -> DataFrame:
    """FLT-24: without the columns whose names begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def flat_warnings(reports: DataFrame, key: str = "doc_id") -> DataFrame:
    """AGG-25: (warning), each with its document in front."""
    return reports.select(F.explode("warnings").alias("w"), key).select(F.concat(F.col(key).cast("string"), F.lit(": "), F.col("w")).alias("warning"))


def split(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SET-04: (kept, rejected); together they are all blocks."""
    kept = F.coalesce(F.col("action") == "keep", F.lit(False))
    return blocks.filter(kept), blocks.filter(~kept)


def write_cleaned(reports: DataFrame, blocks: DataFrame, path: str, key: str = "doc_id") -> None:
    """SNK-02: cleaned texts, metadata without payload, and rejected blocks, in three folders below path."""
    reports.select(key, F.col("_cleaned_text").alias("text")).write.json(f"{path}/cleaned")
    public(reports).write.json(f"{path}/metadata")
    split(blocks)[1].write.json(f"{path}/rejected")


def intake_cleaned(df: DataFrame, families: dict[str, list[str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """PIP-08: (key, cleaned, counters, signals, score, label, action, tokens): NFKC, junk, white space, hyphens and lines, then the grade."""
    t = join_hyphens(tidy(strip_junk(nfkc(F.coalesce(text, F.lit(""))))))
    out = clean_lines(bounded_batches(df).select(key, t.alias(text)), key, text).withColumn("cleaned", tidy(F.col("cleaned")))
    c = F.col("cleaned")
    out = out.withColumn("signals", cleaner_signals(c, families)).withColumn("score", cleaner_score(c, F.col("signals"))).withColumn("label", quality_label(F.col("score"), F.col("signals")))
    return out.withColumn("action", cleaner_action(F.col("label"))).withColumn("tokens", tokens_by_chars(c))
