"""Batch retrieval (JON-04, JON-09, JON-12, WIN-06..08, AGG-18..21, SET-05, SRT-*, PIP-10..12).

Searches take a stated query set against all rows. Queries are read in blocks of bounded size, which every task gets with its
code; a task scores a batch of rows against a block at once and hands on the k best of each query, so the corpus is read
once a block and neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.functions.text import hash_key
from textloom.sources.scratch import bounded_batches

#: Queries of one block, and the characters or numbers of all its queries.
QUERIES, BLOCK_SIZE = 4096, 4 << 20
#: Scores, rows times queries, that a task works out at once.
SCORES = 4 << 20


def in_blocks(queries: DataFrame, size: Column, search: Callable[[pd.DataFrame], DataFrame]) -> DataFrame:
    """search() of all queries, block by block; the rows of a query_id are in one block. size: characters or numbers of a query.

    Each block is read when the plan is made and then held with it, so who has hundreds of blocks calls a search for each part.
    """
    n, total = queries.agg(F.count("*"), F.sum(size)).first()
    blocks = max(1, -(-n // QUERIES), -(-(total or 0) // BLOCK_SIZE))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(queries.filter(block == k).toPandas()) for k in range(blocks)])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of each column, ties by id: (scores, ids). Rows that are no candidates have a score of -inf."""
    order = np.lexsort((np.broadcast_to(ids[:, None], scores.shape) if ids.ndim == 1 else ids, -scores), axis=0)[:k]
    return np.take_along_axis(scores, order, 0), np.take_along_axis(np.broadcast_to(ids[:, None], scores.shape) if ids.ndim == 1 else ids, order, 0)


def _ranked(corpus: DataFrame, query_ids: np.ndarray, k: int, item: str, score: str, scored: Callable[[pd.DataFrame], np.ndarray], kind: str) -> DataFrame:
    """(query_id, rank, item, score). scored: a batch of the corpus, which has the item's id first -> scores, a row each, a column for each query."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top, who = np.full((0, len(query_ids)), -np.inf), np.zeros((0, len(query_ids)), np.int64)
        step = max(1, SCORES // max(1, len(query_ids)))
        for b in (whole.iloc[i : i + step] for whole in batches for i in range(0, len(whole), step)):
            own, ids = best(scored(b), b.iloc[:, 0].to_numpy(np.int64), k)
            top, who = best(np.concatenate([top, own]), np.concatenate([who, ids]), k)
        row, column = np.nonzero(top > -np.inf)
        yield pd.DataFrame({"query_id": query_ids[column], item: who[row, column], score: top[row, column].astype(kind)})

    found = corpus.mapInPandas(search, f"query_id long, {item} long, {score} {'double' if kind == 'f8' else 'int'}")
    w = W.partitionBy("query_id").orderBy(F.desc(score), item)
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unit(vectors: np.ndarray) -> np.ndarray:
    """MSR-28 for rows."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norm == 0, 1.0, norm)


def top_k(queries: DataFrame, corpus: DataFrame, k: int, *, vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """JON-09, SRT-01, FLT-16: (query_id, rank, vec_id, score): exact cosine, ties by vec_id; a batch and a block are one matrix product.

    floor: the least score; scores that are no numbers are left out. Vectors have one length.
    """

    def search(q: pd.DataFrame) -> DataFrame:
        matrix = unit(np.stack(q["v"].to_numpy()).astype(float)).T if len(q) else np.zeros((0, 0))

        def scored(b: pd.DataFrame) -> np.ndarray:
            s = unit(np.stack(b["v"].to_numpy()).astype(float)) @ matrix if len(q) else np.zeros((len(b), 0))
            return np.where(np.isnan(s) | (s < (-np.inf if floor is None else floor)), -np.inf, s)

        rows = corpus.select(F.col("vec_id").cast("long"), F.col(vector).alias("v"))
        return _ranked(rows, q["query_id"].to_numpy(np.int64), k, "vec_id", "score", scored, "f8")

    return in_blocks(queries.select(F.col("query_id").cast("long"), F.col(vector).alias("v")), F.size("v"), search).select("query_id", "rank", "vec_id", "score")


def confidence(hits: DataFrame) -> DataFrame:
    """AGG-19: per query best, mean of the first three, hits, confidence and label."""
    by = hits.groupBy("query_id").agg(F.max("score").alias("best"), F.avg(F.when(F.col("rank") <= 3, F.col("score"))).alias("top3"), F.count("*").alias("n"))
    c = F.col("best") * 0.55 + F.col("top3") * 0.35 + F.least(F.col("n"), F.lit(5)) / 5 * 0.10
    label = F.when((F.col("best") >= 0.45) & (F.col("top3") >= 0.38) & (F.col("n") >= 3), "high").when((F.col("best") >= 0.34) & (F.col("top3") >= 0.28), "medium").otherwise("low")
    return by.withColumn("confidence", c).withColumn("label", label)


def source_rollup(hits: DataFrame, source: str) -> DataFrame:
    """AGG-18."""
    chunks = F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"])
    return hits.groupBy("query_id", source).agg(F.max("score").alias("best"), F.count("*").alias("n"), F.array_join(chunks, ",").alias("chunks"))


def context(ranked: DataFrame, budget: int, *, first_always: bool, separator: int = 0, text: str = "text") -> DataFrame:
    """WIN-06, AGG-21: the ranked texts of a query up to the first that overflows the budget, joined in order."""
    w = W.partitionBy("query_id").orderBy("rank")
    used = F.sum(F.length(text) + separator).over(w.rowsBetween(W.unboundedPreceding, 0))
    over = ranked.withColumn("__used", used).withColumn("__over", (F.col("__used") > budget) & ~(F.lit(first_always) & (F.row_number().over(w) == 1)))
    kept = over.withColumn("__cut", F.min(F.when(F.col("__over"), F.col("rank"))).over(W.partitionBy("query_id"))).filter(F.col("__cut").isNull() | (F.col("rank") < F.col("__cut")))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("rank", text))), lambda x: x[text])
    return kept.groupBy("query_id").agg(F.count("*").alias("blocks"), F.array_join(parts, "\n\n" if separator else "").alias("context"))


def dedupe_hits(hits: DataFrame, k: int, key: str, text_key: str) -> DataFrame:
    """WIN-07, WIN-08: the best k after dropping later hits of an id or of a text."""
    by_id = hits.withColumn("__r", F.row_number().over(W.partitionBy("query_id", key).orderBy("rank"))).filter("__r = 1")
    by_text = by_id.withColumn("__r", F.row_number().over(W.partitionBy("query_id", text_key).orderBy("rank"))).filter("__r = 1")
    return by_text.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter(F.col("rank") <= k).drop("__r")


def lexical(queries: DataFrame, articles: DataFrame, k: int = 3, *, query: str = "query", text: str = "text") -> DataFrame:
    """JON-12, SRT-02: (query_id, rank, article_id, hits): words of the query, split at single spaces, that the article holds as substrings.

    The distinct words of a block of queries are sought in one pass over each article.
    """

    def search(q: pd.DataFrame) -> DataFrame:
        words = sorted({w for ws in q["ws"] for w in ws})
        number = {w: k for k, w in enumerate(words)}
        times = np.zeros((len(words), len(q)), np.int32)
        for column, ws in enumerate(q["ws"]):
            np.add.at(times[:, column], [number[w] for w in ws], 1)

        built: list = []  # the automaton, once for each task

        def scored(b: pd.DataFrame) -> np.ndarray:
            if not built:
                seek = ahocorasick.Automaton()
                for w in words:
                    if w:
                        seek.add_word(w, number[w])
                seek.make_automaton()
                built.append(seek)
            seek = built[0]
            met = np.zeros((len(b), len(words)), bool)
            met[:, [number[w] for w in words if not w]] = True  # an empty word is in every text
            for row, t in enumerate(b["t"]):
                if len(seek):
                    met[row, list({n for _, n in seek.iter(t)})] = True
            hits = (met.astype(np.float32) @ times.astype(np.float32)).astype(float)
            return np.where(hits > 0, hits, -np.inf)

        return _ranked(bounded_batches(articles).select(F.col("article_id").cast("long"), F.lower(text).alias("t")), q["query_id"].to_numpy(np.int64), k, "article_id", "hits", scored, "i4")

    return in_blocks(queries.select(F.col("query_id").cast("long"), F.split(F.lower(query), " ").alias("ws")), F.length(F.array_join("ws", " ")), search)


def cascade(queries: DataFrame, *answers: DataFrame) -> DataFrame:
    """SET-05: for each query the answers of the first source that has any; answers: (query_id, rank, item, score)."""
    both = None
    for k, a in enumerate(answers):
        a = a.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("item").cast("long").alias("item"), F.col("score").cast("double").alias("score"), F.lit(k).alias("source"))
        both = a if both is None else both.unionByName(a)
    first = F.min("source").over(W.partitionBy("query_id"))  # a few rows for each query
    return queries.select("query_id").join(both.withColumn("__first", first).filter("source = __first").drop("__first"), "query_id", "left")


def quality(hits: DataFrame, source: str, flagged: str) -> DataFrame:
    """AGG-20: (query_id, top, average, sources, flagged, label) of the ranked hits."""
    by = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.avg("score").alias("average"), F.count_distinct(source).alias("sources"), F.count_if(F.col(flagged)).alias("flagged"))
    good = (F.col("top") >= 0.42) & (F.col("average") >= 0.32) & (F.col("flagged") == 0)
    return by.withColumn("label", F.when(good, "good").when((F.col("top") >= 0.34) & (F.col("flagged") <= 1), "medium").otherwise("low"))


def dedupe_results(results: DataFrame, chunk_id: str, text: str, chars: int = 500) -> DataFrame:
    """WIN-08: of each query's results the first of each id or, without one, of each opening of the normalised text; those with neither go."""
    key = F.coalesce(F.nullif(F.col(chunk_id).cast("string"), F.lit("")), F.nullif(F.substring(hash_key(F.col(text)), 1, chars), F.lit("")))
    first = F.row_number().over(W.partitionBy("query_id", "__key").orderBy("rank"))
    return results.withColumn("__key", key).filter("__key is not null").withColumn("__first", first).filter("__first = 1").drop("__key", "__first")


def with_texts(vectors: DataFrame, chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """JON-01: vectors with their chunk's text, and a warning where there is none."""
    out = vectors.join(chunks.select(key, F.col(text).alias("__t")), key, "left")
    return out.withColumn("warning", F.when(F.col("__t").isNull(), "missing_chunk_text")).withColumn(text, F.coalesce("__t", F.lit(""))).drop("__t")


def source_label(*fields: Column) -> Column:
    """MSR-32: the first field that isn't empty."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in fields], F.lit("unknown"))


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """PIP-11: (query_id, prompt) of queries (query_id, query) and context()'s rows; without context it is empty."""
    out = queries.join(contexts.select("query_id", "context"), "query_id", "left")
    return out.select("query_id", F.concat(F.lit("USER_QUERY:\n"), F.coalesce("query", F.lit("")), F.lit("\n\nRETRIEVED_CONTEXT:\n"), F.coalesce("context", F.lit(""))).alias("prompt"))


def report(queries: DataFrame, hits: DataFrame, contexts: DataFrame, source: str) -> DataFrame:
    """PIP-10, PIP-12: a row for each query: retrieved, confidence, its label, sources with their best score, context_chunks, context_chars."""
    roll = source_rollup(hits, source).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("best")).alias("b"), F.col(source).alias("s")))), lambda x: x["s"]).alias("sources"))
    sure = confidence(hits).select("query_id", F.col("n").alias("retrieved"), F.round("confidence", 6).alias("confidence"), "label")
    used = contexts.select("query_id", F.col("blocks").alias("context_chunks"), F.length("context").alias("context_chars"))
    out = queries.select("query_id").join(sure, "query_id", "left").join(roll, "query_id", "left").join(used, "query_id", "left")
    return out.fillna({"retrieved": 0, "confidence": 0.0, "label": "low", "context_chunks": 0, "context_chars": 0})


def sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """SRT-03: n rows without replacement; the same ones for a seed and an order of the input."""
    return df.withColumn("__r", F.rand(seed)).orderBy("__r").limit(n).drop("__r")


def first_flagged(df: DataFrame, flag: Column, *order: str, n: int = 8) -> DataFrame:
    """SRT-04, SRT-05: the first n flagged rows in a fixed order."""
    return df.filter(flag).orderBy(*order).limit(n)
