"""Exact vector search through an index of clusters (JON-09, SRT-01), for query tables of any size.

Unit vectors are put into clusters around centres; a cluster's radius is the largest distance of a member from its centre. By the
triangle inequality no member is nearer to a query than the centre's distance less the radius. A query searches the
cluster of its nearest centre first; its k-th score then tells which other clusters can hold anything better.

Queries and vectors meet in groups of (cluster, part of it, block of queries), each of bounded size, so neither the driver nor a
task holds a cluster or the queries whole. What the driver gets is bounded by the number of centres, and a stated sample
for their choice; every vector is indexed, and results are those of a full search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from textloom.operators.retrieve import unit
from textloom.sources.scratch import stored

CENTERS, SAMPLE, ROWS, BLOCK = 64, 4096, 20_000, 1024


def finite(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has numbers only; others match nothing."""
    return df.filter(F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))), F.lit(False)))


def centers_of(corpus: DataFrame, vector: str, n: int = CENTERS, sample: int = SAMPLE, rounds: int = 5) -> np.ndarray:
    """Centres of n clusters at most, from a bounded sample; any centres give right results."""
    rows = finite(corpus, vector).select(F.col(vector).alias("v"), F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample).collect()
    if not rows:
        return np.zeros((1, 1))
    x = unit(np.stack([np.array(r["v"], float) for r in rows]))
    c = x[: min(n, len(x))].copy()
    for _ in range(rounds):
        near = (x @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)
        for k in np.unique(near):
            c[k] = x[near == k].mean(axis=0)
    return c


def distances(u: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((u**2).sum(axis=1)[:, None] + (c**2).sum(axis=1)[None] - 2 * u @ c.T, 0))


def index(corpus: DataFrame, centers: np.ndarray, vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, u), a stored table of unit vectors; those of length zero are cluster -1."""

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = unit(np.stack(b["v"].to_numpy()).astype(float))
                d = distances(u, centers)
                near = d.argmin(axis=1)
                zero = ~u.any(axis=1)
                yield pd.DataFrame({"vec_id": b["vec_id"], "cluster": np.where(zero, -1, near).astype(np.int32), "distance": d[np.arange(len(u)), near], "u": list(u)})

    rows = finite(corpus, vector).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return stored(rows.mapInPandas(assigned, "vec_id long, cluster int, distance double, u array<double>"), "vector-index")


def _searched(wanted: DataFrame, indexed: DataFrame, k: int, sizes: dict[int, int]) -> DataFrame:
    """(query_id, vec_id, score): the k best of each part of the clusters that queries (query_id, cluster, u) want."""
    asked = {r["cluster"]: r["n"] for r in wanted.groupBy("cluster").agg(F.count("*").alias("n")).collect()}  # a row for each cluster
    if not asked:
        return wanted.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    plan = [(c, -(-sizes[c] // ROWS), -(-n // BLOCK)) for c, n in asked.items() if c in sizes]
    plan = F.broadcast(wanted.sparkSession.createDataFrame(plan, "cluster int, parts int, blocks int"))
    by = ["cluster", "part", "block"]
    left = wanted.join(plan, "cluster").select("query_id", "u", "cluster", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    right = indexed.join(plan, "cluster").select("vec_id", "u", "cluster", F.pmod(F.xxhash64("vec_id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def scored(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("vec_id")
        # equal vectors tie in whatever group they are
        s, ids = np.round(np.stack(q["u"].to_numpy()) @ np.stack(v["u"].to_numpy()).T, 12), v["vec_id"].to_numpy()
        if s.shape[1] > k:  # all that reach the k-th score, ties too
            least = np.partition(s, -k, axis=1)[:, -k][:, None]
            row, column = np.nonzero(s >= least)
        else:
            row, column = np.nonzero(np.ones_like(s, bool))
        return pd.DataFrame({"query_id": q["query_id"].to_numpy()[row], "vec_id": ids[column], "score": s[row, column]})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scored, "query_id long, vec_id long, score double")
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def top_k_indexed(queries: DataFrame, corpus: DataFrame, k: int, *, vector: str = "embedding", centers: int = CENTERS) -> tuple[DataFrame, int]:
    """(rows, pairs): (query_id, rank, vec_id, score) by exact cosine, ties by vec_id, and how many pairs were scored."""
    c = centers_of(corpus, vector, centers)
    indexed = index(corpus, c, vector)
    stats = {r["cluster"]: (r["n"], r["radius"]) for r in indexed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("radius")).collect()}
    sizes = {x: n for x, (n, _) in stats.items()}
    known = np.array(sorted(x for x in sizes if x >= 0), np.int64)
    radius = np.array([stats[x][1] for x in known])

    def wanted(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                u = unit(np.stack(b["v"].to_numpy()).astype(float))
                d = distances(u, c[known]) if len(known) else np.zeros((len(u), 0))
                near = np.zeros_like(d, bool)
                if d.shape[1]:
                    near[np.arange(len(d)), d.argmin(axis=1)] = True
                if not first:
                    best = 1 - np.maximum(d - radius, 0) ** 2 / 2
                    best[~u.any(axis=1)] = 1
                    near = ~near & (best >= b["least"].to_numpy()[:, None] - 1e-9)
                row, column = np.nonzero(near)
                found = pd.DataFrame({"query_id": b["query_id"].to_numpy()[row], "cluster": known[column].astype(np.int32), "u": pd.Series(list(u[row]), dtype=object)})
                if not first and -1 in sizes:  # vectors of length zero score 0
                    low = np.flatnonzero(b["least"].to_numpy() <= 0)
                    found = pd.concat([found, pd.DataFrame({"query_id": b["query_id"].to_numpy()[low], "cluster": np.full(len(low), -1, np.int32), "u": pd.Series(list(u[low]), dtype=object)})])
                yield found

        return run

    schema = "query_id long, cluster int, u array<double>"
    q = finite(queries, vector).select(F.col("query_id").cast("long").alias("query_id"), F.col(vector).alias("v"))
    one = stored(q.mapInPandas(wanted(True), schema), "first-clusters")
    start = stored(_searched(one, indexed, k, sizes), "first-hits")
    least = start.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    rest = q.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    two = stored(rest.mapInPandas(wanted(False), schema), "other-clusters")
    pairs = sum(r["n"] * sizes[r["cluster"]] for t in (one, two) for r in t.groupBy("cluster").agg(F.count("*").alias("n")).collect())
    found = start.unionByName(_searched(two, indexed, k, sizes))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), pairs
