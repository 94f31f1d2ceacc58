"""The training-data pipeline: five stages over documents, each a call of one operator.

Every stage gets all rows that its predecessor kept, as a table, and returns a DataFrame; all but the last return
the columns of documents. An empty table stays empty in every stage; columns beyond those of documents are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe_words import TOKENIZERS
from textloom.llm.common import discard, table, text_or_empty, written
from textloom.llm.ngram_jaccard import near_classes
from textloom.llm.quality_gam import score, train_on_labels
from textloom.llm.sentence_pieces import encoded_digests
from textloom.llm.source_mixing import mix
from textloom.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; null and empty texts are scored as empty, repeated rows each."""
    return score(docs, train_on_labels(spark, docs, sf_dir)).filter("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Of rows that share that id the one with the smaller hash of its text, if they are of one group; rows that share an id and are no
    near duplicates stay; of rows equal in id and text one stays. Null and blank texts are groups of their own.
    """
    keys = ["__key", "text_hash"]
    first = near_classes(docs).filter("doc_id = class_id").groupBy(F.col("doc_id").alias("__key"), F.coalesce("class_key", "text_hash").alias("__class")).agg(F.min("text_hash").alias("text_hash")).select(keys).distinct()
    keyed = docs.withColumns({"__key": F.coalesce("doc_id", F.xxhash64("text")), "text_hash": F.xxhash64(text_or_empty())})
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes that occur elsewhere too; what is left of a character that was cut goes as well.

    A null text becomes an empty one; of equal rows of 200 bytes and more nothing remains, as each repeats the other.
    """
    cut = remove_repeats(docs, as_text=True)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the target weights of their sources ask; a null source is one of its own, repeated rows are drawn alike."""
    return mix(docs).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number and digest of the ids of each document, and whether they decode to it; empty texts have no ids."""
    return encoded_digests(docs.select("doc_id", "source", "text"), f"{TOKENIZERS}/piece_bpe_32k.model")


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", source_mix),
    ("sentence_pieces", pieces),
]

#: Training, near duplicates and pieces can't be said in SQL; tests/llm/test_pipeline.py tests each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
