"""Registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.queries import corpus, documents, retrieval, usage

ALL = documents.QUERIES | retrieval.QUERIES | usage.QUERIES | corpus.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
