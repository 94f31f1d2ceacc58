"""Quality classifier: a generalised additive model with pairwise interactions.

``fit`` learns, on the driver, from a bounded sample of labelled rows: every feature is cut into quantile bins, and
cyclic boosting passes over the features again and again, each time adding a small tree over one feature's bins to
that feature's lookup table. The pairs that explain most of what is left get two-way tables in the same way. A
score is the sigmoid of an intercept plus one looked-up number for each table, added for a whole Arrow batch at
once. Features come from the text alone.

Defined cases: null texts count as empty; an empty text has all features 0 and gets the score that follows; with no
labelled rows, or with labels of one kind only, the score is the share of ones, held inside [0.01, 0.99] (0.5 without
rows); ties and repeated rows are scored each; further columns are kept, and those named like the added ones are
replaced; an empty table gives an empty result. A null id has no label and isn't held out; of documents that share a labelled
id one is learned from, that with the smallest features, so no id brings more than a row to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import table, text_or_empty

FEATURES = ["log_words", "word_bytes", "longest_word", "short_words", "upper", "digits", "symbols", "bangs", "stops", "commas", "line_words", "dup_lines", "distinct_words", "non_ascii"]

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 3
_KIND[ord("0") : ord("9") + 1] = 4
_KIND[list(b"#*$%&|<>")] = 5
_KIND[ord("!")] = 6
_KIND[list(b".?;:")] = 7
_KIND[ord(",")] = 8
_KIND[128:192] = 9
_KIND[192:] = 10


def features(text: str | None) -> np.ndarray:
    """The FEATURES of a whole text; zeros if it has no word."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    kind = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=11)
    size = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = max(1, kind[2] + kind[3] + kind[10])
    return np.array([
        np.log1p(n), size.mean(), size.max(), (size <= 3).mean(), kind[2] / letters, kind[4] / n, kind[5] / n, kind[6] / n, kind[7] / n, kind[8] / n,
        n / len(lines), 1 - len(set(lines)) / len(lines), len(set(words)) / n, kind[10] / letters,
    ])


@dataclass
class Gam:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.intercept)
        for j, (edges, values) in enumerate(zip(self.edges, self.tables)):
            f += values[np.searchsorted(edges, x[:, j])]
        for (a, b), values in zip(self.pairs, self.pair_tables):
            f += values[np.searchsorted(self.pair_edges[a], x[:, a]), np.searchsorted(self.pair_edges[b], x[:, b])]
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="lower"))


def _best_cut(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, int]:
    """The gain and place of the best cut of ordered bins with gradient and curvature sums g, h (along the last axis)."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + lam) + (all_g - left_g) ** 2 / (all_h - left_h + lam) - all_g**2 / (all_h + lam)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Values for ordered bins: at most that many runs of equal values, cut greedily."""
    runs, out = [(0, len(g))], np.zeros(len(g))
    while len(runs) < leaves:
        gain, k, r = max((*_best_cut(g[a:b], h[a:b], lam), (a, b)) for a, b in runs)
        if gain <= 1e-9:
            break
        runs.remove(r)
        runs += [(r[0], r[0] + k), (r[0] + k, r[1])]
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """Values for a grid: the better axis is cut once, and each side then along the other axis."""
    best, out = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        _, k = _best_cut(a.sum(1), b.sum(1), lam)
        values, total = np.zeros_like(a), 0.0
        for rows in (slice(0, k), slice(k, None)):
            if a[rows].size:
                gain, cut = _best_cut(a[rows].sum(0), b[rows].sum(0), lam)
                total += gain
                for columns in (slice(0, cut), slice(cut, None)):
                    values[rows, columns] = a[rows, columns].sum() / (b[rows, columns].sum() + lam)
        if total > best:
            best, out = total, values.T if turn else values
    return out, best


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = 64, rounds: int = 120, rate: float = 0.1, leaves: int = 3, pairs: int = 6, pair_bins: int = 12, pair_rounds: int = 60, lam: float = 1.0) -> Gam:
    n = len(y)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if n else 0.5
    model = Gam(float(np.log(share / (1 - share))))
    if not n or y.min() == y.max():
        return model
    width = x.shape[1]
    model.edges = [_cuts(x[:, j], bins) for j in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.edges)]
    f = np.full(n, model.intercept)

    def sums(place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return np.bincount(place, y - p, size), np.bincount(place, p * (1 - p), size)

    for _ in range(rounds):
        for j in range(width):
            step = rate * _tree(*sums(at[j], len(model.tables[j])), leaves, lam)
            model.tables[j] += step
            f += step[at[j]]
    model.pair_edges = [_cuts(x[:, j], pair_bins) for j in range(width)]
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    shape = lambda a, b: (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
    place = lambda a, b: coarse[a] * shape(a, b)[1] + coarse[b]

    def grid(a: int, b: int) -> tuple[np.ndarray, float]:
        s = shape(a, b)
        g, h = sums(place(a, b), s[0] * s[1])
        return _pair_tree(g.reshape(s), h.reshape(s), lam)

    ranked = sorted(((grid(a, b)[1], a, b) for a in range(width) for b in range(a + 1, width)), reverse=True)
    model.pairs = [(a, b) for _, a, b in ranked[:pairs]]
    model.pair_tables = [np.zeros(shape(a, b)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            step = rate * grid(a, b)[0]
            model.pair_tables[k] += step
            f += step[coarse[a], coarse[b]]
    return model


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = 20_000, text: str = "text", key: str = "doc_id", label: str = "quality", **how) -> Gam:
    """labels: (key, label 0/1). At most max_rows of them, those of the smallest hashes, are learned from.

    The sampled keys, at most max_rows longs, are broadcast; the features of their documents come to the driver.
    """
    picked = labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("double").alias("__y")).orderBy(F.xxhash64(key), key).limit(max_rows)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(_matrix(b["__t"]), columns=FEATURES)
            yield out.assign(__k=b["__k"].to_numpy(), __y=b["__y"].to_numpy())

    rows = docs.select(key, text_or_empty(text).alias("__t")).join(F.broadcast(picked), key)
    schema = T.StructType([*(T.StructField(c, T.DoubleType()) for c in FEATURES), T.StructField("__k", T.LongType()), T.StructField("__y", T.DoubleType())])
    got = rows.select(F.xxhash64(key).alias("__k"), "__t", "__y").mapInPandas(measured, schema)
    got = got.groupBy("__k").agg(F.min(F.struct(*FEATURES, "__y")).alias("x")).select("__k", "x.*").toPandas().sort_values("__k", kind="stable")
    return fit(got[FEATURES].to_numpy(), got["__y"].to_numpy(), **how)


def score(docs: DataFrame, model: Gam, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the threshold on)."""
    docs = docs.drop("score", "predicted")

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(_matrix(b[text]))
            yield b.assign(score=s, predicted=(s >= threshold).astype("int32"))

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInPandas(scored, schema)


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train_on_labels(spark: SparkSession, docs: DataFrame, sf_dir: str, **how) -> Gam:
    return train(docs, table(spark, sf_dir, "labels").filter(~held_out()), **how)


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_on_labels(spark, docs, sf_dir)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
