"""Planning, records and checks of an ingestion (FLT-12, FLT-15, FLT-17, FLT-22, CHK-07, MSR-24, MSR-25, MSR-35, JON-05, JON-13, WIN-03, AGG-15..17, VAL-02, PIP-03, PIP-04, PIP-09, SNK-12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.measures import embedding_cost, tokens_by_chars
from textloom.functions.text import hash_key
from textloom.operators.dedupe import known_before, previous_duplicates
from textloom.operators.stabilize import retrieval_weight
from textloom.sources.scratch import bounded_batches

# Fixed values of the chunk record.
CHUNK_VERSION, PIPELINE_VERSION, HARD, LEAST = 1, "chunker_v1", 1150, 350


def included(label: Column, action: Column) -> Column:
    """FLT-12."""
    return F.coalesce(label.isin("HIGH", "MEDIUM") & action.isin("keep", "manual_review"), F.lit(False))


def long_enough(t: Column, least: int = 100) -> Column:
    """FLT-15: 100 characters for a document, 50 for a chunk."""
    return F.length(F.trim(t)) >= least


def stable_id(*parts: Column) -> Column:
    """MSR-25, MSR-35: SHA-1 of the parts joined by colons, so a rerun gives the same ids."""
    return F.sha1(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def chunk_id(canonical: Column, first: Column, last: Column, chunk: Column) -> Column:
    """MSR-24."""
    return F.sha1(F.concat(canonical, F.lit("["), first.cast("string"), F.lit(","), last.cast("string"), F.lit("]"), hash_key(chunk)))


def chunk_records(chunks: DataFrame, *, namespace: str, language: str = "ru") -> DataFrame:
    """CHK-07, PIP-03: (chunk_id, chunk_version, pipeline_version, text, metadata).

    chunks: source_file, duplicate_of, logical_category, duplicate_status, tail_removed, restore_splits, readiness_before,
    readiness_after, similarity, and semantic_chunks()' columns; nulls among the first stand for documents without metadata.
    """
    c = F.col
    canonical = F.coalesce(F.nullif(c("duplicate_of").cast("string"), F.lit("")), c("source_file"))
    tail, restored = F.coalesce(c("tail_removed") > 0, F.lit(False)), F.coalesce(c("restore_splits") > 0, F.lit(False))
    category = F.coalesce("logical_category", F.lit("explanatory_narrative"))
    one = (c("tokens") < LEAST) & (c("first_paragraph") == c("last_paragraph"))
    metadata = F.struct(
        F.lit(namespace).alias("namespace"), F.lit(language).alias("language"), retrieval_weight(category, tail, restored).alias("retrieval_weight"), c("source_file"), canonical.alias("canonical_source"), category.alias("logical_category"),
        F.coalesce("duplicate_status", F.lit("canonical_or_unique")).alias("duplicate_status"), F.array("first_paragraph", "last_paragraph").alias("paragraph_range"), c("chunk_index"), c("tokens").alias("token_estimate"), F.length("chunk").alias("char_count"),
        F.struct(c("readiness_before").alias("chunking_readiness_before"), c("readiness_after").alias("chunking_readiness_after"), restored.alias("paragraph_restore_applied"), tail.alias("tail_cleanup_applied"), c("similarity").alias("duplicate_similarity")).alias("stabilization"),
        F.struct(c("continuity").alias("semantic_continuity_score"), c("redundancy").alias("overlap_redundancy"), (c("tokens") > HARD).alias("oversized"), one.cast("int").alias("orphan_paragraphs")).alias("quality"),
    )
    return chunks.select(chunk_id(canonical, c("first_paragraph"), c("last_paragraph"), c("chunk")).alias("chunk_id"), F.lit(CHUNK_VERSION).alias("chunk_version"), F.lit(PIPELINE_VERSION).alias("pipeline_version"), c("chunk").alias("text"), metadata.alias("metadata"))


def record_warnings(record: DataFrame) -> DataFrame:
    """FLT-17: chunk records with warnings, the names of what is missing, in fixed order."""
    fields = {f.name for f in record.schema["metadata"].dataType.fields}
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    tests = [(empty("chunk_id"), "missing_chunk_id"), (empty("text"), "missing_text"), (F.col("metadata").isNull(), "missing_metadata")]
    tests += [(F.col(f"metadata.{k}").isNull() if k in fields else F.lit(True), f"metadata_missing_{k}") for k in ("source_file", "canonical_source", "paragraph_range", "chunk_index", "token_estimate")]
    return record.withColumn("warnings", F.array_compact(F.array(*[F.when(t, F.lit(n)) for t, n in tests])))


def planned_chunks(chunks: DataFrame, current: DataFrame, *, kb: str, session: str, order: str = "seq", span: int = 1_000_000) -> DataFrame:
    """PIP-09, JON-05, WIN-03: chunks (item_id, chunk_index, chunk, order) with hash, chunk_id, tokens, duplicate_status and duplicate_of.

    current: (hash) of the chunks in production. duplicate_of is the order of the session's last chunk of that hash before;
    duplicates are marked and stay.
    """
    d = chunks.withColumn("hash", F.sha1(hash_key(F.col("chunk"))))
    d = known_before(previous_duplicates(d, F.col("hash"), order, span), current, "hash")
    status = F.when(F.col("in_previous"), "duplicate_candidate_current").when(F.col("duplicate_of").isNotNull(), "duplicate_candidate_session").otherwise("canonical_or_unique")
    return d.withColumns({"chunk_id": stable_id(F.lit(kb), F.lit(session), F.col("item_id"), F.col("chunk_index"), F.col("hash")), "tokens": tokens_by_chars(F.col("chunk")), "duplicate_status": status}).drop("in_previous", "n_same")


def plan_summary(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """AGG-16: one row. items: quality_label, included; chunks: planned_chunks()."""
    label = lambda x: F.count_if(F.col("quality_label") == x).alias(x.lower())
    a = items.agg(F.count("*").alias("items"), F.count_if("included").alias("sources"), F.count_if(~F.col("included")).alias("rejected"), *map(label, ("HIGH", "MEDIUM", "LOW", "REJECT"))).withColumn("one", F.lit(1))
    b = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("duplicate_status") != "canonical_or_unique").alias("duplicates")).withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one").withColumn("cost", embedding_cost(F.col("tokens")))


def cleaning_summary(items: DataFrame) -> DataFrame:
    """AGG-15: one row. items: quality_label, recommended_action, chars_before, chars_after; tokens of what is kept only."""
    kept = F.col("recommended_action") != "reject"
    tokens = F.sum(F.when(kept, F.ceil(F.col("chars_after") / 4)).otherwise(0))
    return items.agg(F.count("*").alias("items"), *[F.count_if(F.col("quality_label") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW", "REJECT")], F.count_if(kept).alias("kept"), F.sum("chars_before").alias("chars_before"), F.sum("chars_after").alias("chars_after"), tokens.alias("tokens"))


def embedding_sizes(records: DataFrame, file: str) -> DataFrame:
    """AGG-17: per file records, tokens, cost and invalid records; records: text, warnings."""
    tokens = tokens_by_chars(F.col("text"))
    by = records.groupBy(file).agg(F.count("*").alias("records"), F.sum(tokens).alias("tokens"), F.count_if(F.size("warnings") > 0).alias("invalid"))
    return by.withColumn("cost", embedding_cost(F.col("tokens")))


def embedded(chunks: DataFrame, provider: Callable[[list[str]], np.ndarray], dim: int, *, text: str = "text", batch: int = 64, longest: int | None = None) -> DataFrame:
    """PIP-04, VAL-04: chunks with embedding, from a provider that gets at most ``batch`` texts at once; a vector of another length fails the job."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), batch):
                part = b.iloc[k : k + batch]
                found = np.asarray(provider([(t or "")[:longest] for t in part[text]]), np.float32)
                if found.shape != (len(part), dim):
                    raise ValueError(f"embeddings of shape {found.shape}, wanted {(len(part), dim)}")
                yield part.assign(embedding=list(found))

    return bounded_batches(chunks).mapInPandas(run, f"{own}, embedding array<float>")


def candidate_status(sessions: DataFrame, *reports: DataFrame) -> DataFrame:
    """JON-13: sessions (session_id, ...) with status and report, of the first of reports (session_id, status) that has the session."""
    for k, r in enumerate(reports):
        sessions = sessions.join(r.groupBy("session_id").agg(F.max("status").alias(f"__{k}")), "session_id", "left")
    found = [F.col(f"__{k}") for k in range(len(reports))]
    number = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in enumerate(found)])
    return sessions.withColumns({"status": F.coalesce(*found), "report": number}).drop(*[f"__{k}" for k in range(len(reports))])


def required_status(df: DataFrame, column: str, *allowed: str) -> DataFrame:
    """FLT-22: df; a row of another status fails the job."""
    wrong = F.raise_error(F.concat(F.lit("unexpected status "), F.coalesce(column, F.lit("null"))))
    return df.filter(F.when(F.coalesce(F.col(column).isin(*allowed), F.lit(False)), F.lit(True)).otherwise(wrong.cast("boolean")))


def manifest_checks(rows: DataFrame, manifest: dict, ingestion: dict | None = None, *, dim: int, vectors: int | None = None) -> DataFrame:
    """VAL-02: one row of counts, errors, warnings and ok. rows: vector_id, chunk_id, text, source_id, embedding_dim.

    manifest and ingestion are the two small JSON records of an index; vectors is the number in its vector file.
    """
    one = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("empty"), F.count_distinct("chunk_id").alias("chunk_ids"), F.count_distinct("source_id").alias("sources"), F.count_if(F.coalesce(F.col("embedding_dim") != dim, F.lit(True))).alias("bad_dim"), F.min("vector_id").alias("low"), F.max("vector_id").alias("high"), F.count_distinct("vector_id").alias("ids"))
    n, other = F.col("rows"), ingestion or {}
    sure = lambda test: F.lit(bool(test))
    summary = other.get("summary", {})
    apart = lambda key: bool(other.get(key)) and bool(manifest.get(key)) and other[key] != manifest[key]
    critical = other.get("critical_quality_errors") or [x for x in other.get("quality_errors", []) if str(x.get("severity", "")).lower() == "critical"]
    errors = [
        ("schema_version", sure(int(manifest.get("manifest_schema_version") or manifest.get("schema_version") or 1) != 1)), ("index_type", sure(manifest.get("index_type") != "faiss.IndexFlatIP")), ("manifest_dim", sure(manifest.get("embedding_dim") != dim)),
        ("manifest_vectors", n != F.lit(manifest.get("vectors", -1))), ("vector_count", n != F.lit(vectors) if vectors is not None else F.lit(False)), ("duplicate_chunk_id", F.col("chunk_ids") != n), ("empty_chunks", F.col("empty") > 0), ("row_dim", F.col("bad_dim") > 0),
        ("vector_id", ~((n == 0) | ((F.col("low") == 0) & (F.col("high") == n - 1) & (F.col("ids") == n)))), ("kb_id", sure(apart("kb_id"))), ("session_id", sure(apart("session_id"))), ("planned_chunks", n != F.lit(summary["planned_chunks"]) if "planned_chunks" in summary else F.lit(False)),
        ("planned_sources", F.col("sources") != F.lit(summary["planned_sources"]) if "planned_sources" in summary else F.lit(False)), ("critical_quality_errors", sure(critical)),
    ]
    unsure = ingestion is not None and (ingestion.get("safeguards") or {}).get("wrote_only_staging") is not True
    return one.select("rows", "sources", F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(k)) for k, t in errors])), ",").alias("errors"), F.lit("staging_only_unconfirmed" if unsure else "").alias("warnings")).withColumn("ok", F.col("errors") == "")


def applied(plan: DataFrame, path: str, apply: bool = False, **options: str) -> DataFrame:
    """SNK-12: the plan; written below path, which must be new, only if it is to be applied."""
    if apply:
        plan.write.options(**options).parquet(path)
        return plan.sparkSession.read.parquet(path)
    return plan
