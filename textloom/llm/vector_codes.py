"""Vector code compression: product quantisation whose nearest entries come out of memoised grid cells.

Components become integers, floor(1024 * x), and a vector is cut into four parts. Each part position has a codebook of 256
entries, first the parts of the 256 smallest ids; each of four rounds assigns all parts to their nearest entries and
replaces the entries by the floors of their parts' means. A last assignment gives the codes.

A part is assigned through the grid cell that it lies in. The first part in a cell has the cell worked out: for every
entry, the smallest and the largest squared distance to the cell's box; entries whose smallest one is above the least of
the largest are nearest to no point of the box, and go. What is left is kept under the cell's key, and the parts in
that cell are compared exactly, in integers, with these entries only; ties go to the lower index. Distances to boxes are
sums over components of table look-ups, in floating point and with a margin, so no entry is lost to rounding.
The width of cells follows the distances between the codebook's entries. Each task has its own memo for a round, of
bounded size.

Spark runs a round as one pass over the stored table of integers; tasks give sums and counts for each entry, at most
4 x 256 rows a task, which are added by a grouping; the driver gets 4 x 256 rows of sums, whatever the number of vectors.

Defined cases: rows with a null vector, or with null, NaN or infinite components, go; so do empty vectors, those
whose length isn't a multiple of four and those of another length than most (of lengths alike in number, the
largest); null ids come last in the order of ids, and equal ids are ordered by their components; equal rows are coded each; with
fewer than 256 vectors the codebooks have as many entries; integers beyond a long, and errors beyond one, are
a long's limit; an empty table gives an empty result; columns beyond those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import batches_of, discard, table, with_keyed, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Below this size of components, floating point holds the sums of 16 squared differences exactly.
EXACT = 1 << 23
LONG = (1 << 63) - 1


class Cells:
    """Nearest entries of one codebook (entries: integers, k x d), by memoised grid cells."""

    def __init__(self, entries: np.ndarray, most: int = 100_000):
        self.entries, self.most, self.pairs = entries, most, max(1, (1 << 20) // max(1, entries.shape[1]))
        self.near = entries.astype(np.float64)
        self.exact = entries.shape[1] * len(entries) < 2**15 and bool(np.abs(self.near).max(initial=0) < EXACT)
        gaps = ((self.near[:, None, :] - self.near[None, :, :]) ** 2).sum(axis=2)
        gaps[gaps == 0] = np.inf
        nearest = gaps.min(axis=1, initial=np.inf)
        nearest = nearest[np.isfinite(nearest)]
        # the diagonal of a cell is about half the distance from an entry to its nearest one
        width = np.sqrt(np.median(nearest) / entries.shape[1]) / 2 if len(nearest) else 32.0
        self.shift = int(np.clip(np.floor(np.log2(max(width, 1.0))), 0, 61))
        self.cells = self.compared = self.asked = 0
        self.clear()

    def clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.kept = [np.zeros(0, np.uint16)]
        self.sizes: list[int] = []

    def survivors(self, cells: np.ndarray) -> np.ndarray:
        """Which entries, for each cell, may be nearest to a point of its box."""
        kind = np.float32 if self.exact and np.abs(cells).max(initial=0) < EXACT >> self.shift else np.float64
        least = np.zeros((len(cells), len(self.near)), kind)
        most = np.zeros_like(least)
        for j in range(cells.shape[1]):
            places, at = np.unique(cells[:, j], return_inverse=True)
            low = (places << self.shift).astype(np.float64)[:, None]
            high, e = low + ((1 << self.shift) - 1), self.near[None, :, j]
            least += (np.maximum(np.maximum(low - e, e - high), 0) ** 2).astype(kind)[at]
            most += (np.maximum(np.abs(e - low), np.abs(high - e)) ** 2).astype(kind)[at]
        bound = most.min(axis=1, keepdims=True)
        return least <= bound + bound * 1e-4 + 1

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, entries): how many entries each part has left, and these, one part's after another's."""
        cells = parts >> self.shift
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, 8 * cells.shape[1]))).ravel().tolist()
        if len(self.slots) + len(keys) > self.most:
            self.clear()
        new = {k: i for i, k in enumerate(keys) if k not in self.slots}
        rows = np.fromiter(new.values(), np.int64, len(new))
        for k in range(0, len(rows), 1024):
            stay = self.survivors(cells[rows[k : k + 1024]])
            self.kept.append(np.nonzero(stay)[1].astype(np.uint16))
            self.sizes.extend(stay.sum(axis=1).tolist())
        for key in new:
            self.slots[key] = len(self.slots)
        self.kept = [np.concatenate(self.kept)]
        sizes = np.array(self.sizes, np.int64)
        starts = np.cumsum(sizes) - sizes
        slot = np.fromiter(map(self.slots.__getitem__, keys), np.int64, len(keys))
        n = sizes[slot]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[slot], n)
        self.cells, self.asked, self.compared = self.cells + len(new), self.asked + len(keys), self.compared + len(at)
        return n, self.kept[0][at].astype(np.int64)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of each part; parts: integers, n x d."""
        n, entry = self.candidates(parts)
        small = self.exact and np.abs(parts.astype(np.float64)).max(initial=0) < EXACT
        x, e = (parts, self.entries.astype(np.int64)) if small else (parts.astype(object), self.entries.astype(object))
        row = np.repeat(np.arange(len(parts)), n)
        both = np.empty(len(row), np.int64 if small else object)
        for k in range(0, len(row), self.pairs):
            i, c = row[k : k + self.pairs], entry[k : k + self.pairs]
            both[k : k + self.pairs] = ((x[i] - e[c]) ** 2).sum(axis=1) * len(e) + c
        best = np.minimum.reduceat(both, np.cumsum(n) - n)
        return (best % len(e)).astype(np.int64), best // len(e)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, c) of the rows that are kept, as a stored table; c: integer components."""
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).filter(F.coalesce(finite, F.lit(False)))
    kept = written(kept.filter((F.size("v") > 0) & (F.size("v") % PARTS == 0)).select("id", "label", F.transform("v", lambda x: F.floor(x.cast("double") * SCALE)).alias("c")), "vectors")
    usual = kept.groupBy(F.size("c").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return kept.filter(F.size("c") == (usual["n"] if usual else 0))


def _parts(b: pd.DataFrame) -> np.ndarray:
    whole = np.stack(b["c"].to_numpy()).astype(np.int64)
    return whole.reshape(len(b), PARTS, -1)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, sums, n) of each task: the sums of the components of the parts next to an entry, and their number."""

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [Cells(x) for x in books]
        sums, n = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            if not len(b):
                continue
            parts = _parts(b)
            small = np.abs(parts.astype(np.float64)).max() < EXACT
            for p, own in enumerate(cells):
                entry, _ = own.nearest(parts[:, p])
                n[p] += np.bincount(entry, minlength=books.shape[1])
                add = np.zeros(books.shape[1:], np.int64 if small else object)
                np.add.at(add, entry, parts[:, p] if small else parts[:, p].astype(object))
                sums[p] += add.astype(object)
        part, entry = np.nonzero(n)
        yield pd.DataFrame({"part": part, "entry": entry, "sums": [[Decimal(int(v)) for v in x] for x in sums[part, entry]], "n": n[part, entry]})

    return vectors.select("c").mapInPandas(added, "part int, entry int, sums array<decimal(38,0)>, n long")


def trained(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, place) of integers, from a stored table of integer_vectors()."""
    first = vectors.orderBy(F.asc_nulls_last("id"), "c").select("c").limit(entries).collect()
    if not first:
        return np.zeros((PARTS, 0, 1), np.int64)
    books = np.stack([np.array(r["c"], np.int64).reshape(PARTS, -1) for r in first], axis=1)
    for _ in range(rounds):
        found = _sums(vectors, books).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(books.shape[2])])
        books = books.copy()
        with batches_of(vectors.sparkSession, 5000):
            rows = found.collect()  # at most 4 x 256
        for r in rows:
            books[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(books.shape[2])]
    return books


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code array<int>, error) of each vector."""

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [Cells(x) for x in books]
        for b in batches:
            if len(b):
                parts = _parts(b)
                found = [own.nearest(parts[:, p]) for p, own in enumerate(cells)]
                error = sum(d.astype(object) for _, d in found)
                yield pd.DataFrame({"id": b["id"], "label": b["label"], "code": list(np.stack([e for e, _ in found], axis=1).astype(np.int32)), "error": np.array([min(x, LONG) for x in error], np.int64)})

    kinds = dict(vectors.dtypes)
    return vectors.mapInPandas(assigned, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")


def books_text(books: np.ndarray) -> str:
    """All entries' components by part, entry and place, with commas."""
    return ",".join(map(str, books.ravel().tolist()))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    books = trained(vectors)
    codes = written(coded(vectors, books), "codes", batch_rows=5000)
    discard(vectors)
    # a label's null is told apart by a second key
    keyed = codes.select(F.col("id").alias("vec_id"), "label", "code", "error", F.xxhash64("label").alias("k"), F.col("label").isNull().alias("none"))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    labels = keyed.groupBy("k", "none").agg(total.alias("label_error"), F.count("*").alias("n"))
    code = F.array_join(F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return with_keyed(keyed, labels, ["k", "none"]).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Assignments and means as relations: one for each round."""
    near = "min(list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + e.i)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT x.vec_id, x.p, any_value(x.v) AS v, {near} AS best FROM x JOIN e{k} e USING (p) GROUP BY x.vec_id, x.p)")
        if k < ROUNDS:
            steps.append(f"""s{k} AS (SELECT p, best % 256 AS i, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(d) FROM dims) + 1)) AS j) GROUP BY ALL),
n{k} AS (SELECT p, i, list((s - (((s % n) + n) % n)) // n ORDER BY j) AS v FROM s{k} GROUP BY p, i),
e{k + 1} AS MATERIALIZED (SELECT e{k}.p, e{k}.i, coalesce(n{k}.v, e{k}.v) AS v FROM e{k} LEFT JOIN n{k} USING (p, i))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor(y::DOUBLE * {SCALE})::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), dims AS (SELECT max(len(c)) // {PARTS} AS d FROM kept),
x AS MATERIALIZED (SELECT vec_id, p, c[p * d + 1 : p * d + d] AS v FROM kept, dims, (SELECT unnest(range({PARTS})) AS p)),
e0 AS MATERIALIZED (SELECT p, i, v FROM (SELECT p, v, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i FROM x) WHERE i < {ENTRIES}),
{", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, i)) AS h FROM e{ROUNDS}),
codes AS (SELECT vec_id, string_agg(printf('%02x', (best % 256)::INTEGER), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


OP11_SQL = _sql()
