"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has 64 bits: bit b is set if it is set in over half of the hashes of its shingles of four words.
Fingerprints that differ in at most four bits are linked; classes are what links connect.

Distinct fingerprints are cut into segments of 22, 21 and 21 bits. The binary Golay code is perfect: each 23-bit word is at most
three bits from one codeword. A segment's fuzzy keys are the codeword indices of all words at most one bit from it (one
index, or six), so two segments at most two bits apart share the index of the word half way between them. Of a pair
with at most four differing bits,

* either a segment is equal; the other two have four errors at most, so one of them has two at most: keys (equal
  segment, fuzzy key of another one), 33 bits and more;
* or every segment has an error, hence none has over two: keys (fuzzy key of each segment), 36 bits.

So all linked pairs share a key, in some 180 keys for a fingerprint, and rows that share one are compared. Tasks give no pairs but, for
each fingerprint, the smallest one that its links lead to. A key with over 4,096 fingerprints isn't held by a task: its
rows are dealt into blocks, and each pair of blocks is a group of its own.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any other; texts of fewer than four
words have one shingle of all; a null id has a fingerprint and links, but is no component's id while
another one is; rows that share an id each have their own text's component; equal rows are each returned; an empty table gives an
empty result; columns beyond id and text are not read. Texts of any length are hashed in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import discard, table, text_or_empty, with_keyed, written
from textloom.llm.graph import components

WIDTH, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
BLOCK = 4096
#: Generator polynomial of the binary Golay code of length 23.
GENERATOR = 0xC75


def _remainders(n: int) -> np.ndarray:
    """Of n * x**11 by the generator, for 12-bit n."""
    out = np.arange(n, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


_REMAINDER = _remainders(1 << 12)
_ERROR = np.zeros(1 << 11, np.int64)
for _i in range(23):
    for _j in range(_i, 23):
        for _k in range(_j, 23):
            _e = (1 << _i) | (1 << _j) | (1 << _k)
            _ERROR[_REMAINDER[_e >> 11] ^ (_e & 0x7FF)] = _e


def decoded(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (words ^ _ERROR[_REMAINDER[words >> 11] ^ (words & 0x7FF)]) >> 11


def fuzzy(segment: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, fresh): the codeword indices of the words at most one bit from each segment, in ascending order, and which aren't repeats."""
    flips = np.r_[0, 1 << np.arange(bits)].astype(np.int64)
    found = np.sort(decoded(segment[:, None] ^ flips), axis=1)
    return found, np.c_[np.ones(len(found), bool), found[:, 1:] != found[:, :-1]]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every key of each fingerprint (int64)."""
    whole = prints.view(np.uint64)
    segments = [(whole >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    near, rows, keys = [], [], []
    for own, (_, bits) in zip(segments, SEGMENTS):
        found, fresh = fuzzy(own, bits)
        row, at = np.nonzero(fresh)
        n = fresh.sum(axis=1)
        near.append((row, found[row, at], n, np.cumsum(n) - n))
    for i, equal in enumerate(segments):
        for j in range(3):
            if i != j:
                row, index, *_ = near[j]
                rows.append(row)
                keys.append((3 * i + j + 1 << 36) | (equal[row] << 12) | index)
    row, key = near[0][:2]
    for _, index, n, start in near[1:]:
        times = n[row]
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[row], times)
        row, key = np.repeat(row, times), np.repeat(key, times) << 12 | index[at]
    return np.concatenate([*rows, row]), np.concatenate([*keys, key])


def fingerprint(text: str) -> int:
    """Of a text's lower-cased words' shingles, as unsigned integer."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.fromiter(accumulate(map(len, words)), np.int64, len(words)) + np.arange(len(words))
    starts = np.r_[0, ends[:-1] + 1]
    if len(words) > WIDTH:
        starts, ends = starts[: 1 - WIDTH], ends[WIDTH - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 14):
        parts = map(whole.__getitem__, map(slice, starts[k : k + (1 << 14)].tolist(), ends[k : k + (1 << 14)].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", min(1 << 14, len(starts) - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp long) of each row."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "fp": np.fromiter(map(fingerprint, b["t"]), np.uint64, len(b)).view(np.int64)})

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("id"), text_or_empty(text).alias("t")).mapInPandas(hashed, f"id {kind}, fp long")


def compared(group: np.ndarray, prints: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fp, low) of the rows whose links lead to a smaller one: rows of one group (groups are runs) are compared, of a side each if sides are given."""
    left, right = [], []
    i, shift = np.arange(len(prints)), 0
    whole = prints.view(np.uint64)
    while len(i):
        shift += 1
        i = i[i + shift < len(prints)]
        i = i[group[i] == group[i + shift]]
        apart = i if side is None else i[side[i] != side[i + shift]]
        near = apart[np.bitwise_count(whole[apart] ^ whole[apart + shift]) <= DISTANCE]
        left.append(near)
        right.append(near + shift)
    if not sum(map(len, left)):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, at = np.unique(prints, return_inverse=True)
    p, q = at[np.concatenate(left)], at[np.concatenate(right)]
    low, before = np.arange(len(names)), None
    while before is None or (low != before).any():
        before = low.copy()
        np.minimum.at(low, p, low[q])
        np.minimum.at(low, q, low[p])
    some = np.flatnonzero(low != np.arange(len(names)))
    return names[some], names[low[some]]


def swept(rows: DataFrame, by: list[str], most: int | None = None, sides: bool = False) -> DataFrame:
    """(u, v, key): the links of groups of rows that agree in the columns by, or, where key isn't null, the rows of keys with over ``most`` fingerprints as they are."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(parts: list[pd.DataFrame]) -> pd.DataFrame:
            b = pd.concat(parts, ignore_index=True)
            new = np.r_[True, (b[by].to_numpy()[1:] != b[by].to_numpy()[:-1]).any(axis=1)] if len(b) else np.zeros(0, bool)
            u, v = compared(np.cumsum(new), b["fp"].to_numpy(np.int64), b["own"].to_numpy() if sides else None)
            return pd.DataFrame({"u": u, "v": v, "key": pd.array([None] * len(u), "Int64")})

        def raw(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"u": b["fp"], "v": b["fp"], "key": b["key"].astype("Int64")})

        held: list[pd.DataFrame] = []  # rows of the last group so far
        n, last, passing = 0, None, False
        for b in batches:
            if not len(b):
                continue
            names = b[by].to_numpy()
            same = (names == names[-1]).all(axis=1)
            cut = 0 if same.all() else len(b) - int(np.argmin(same[::-1]))
            first = (names == last).all(axis=1) if last is not None else np.zeros(len(b), bool)
            head = int(np.argmin(first)) if not first.all() else len(b)
            if passing and head:
                yield raw(b.iloc[:head])
                b, cut = b.iloc[head:], max(0, cut - head)
                if not len(b):
                    continue
                passing, held, n = False, [], 0
            elif passing:
                passing = False
            if cut or (held and not head):
                yield links([*held, b.iloc[:cut]])
                held, n = [], 0
            held.append(b.iloc[cut:])
            n, last = n + len(b) - cut, names[-1]
            if most is not None and n > most:
                for x in held:
                    yield raw(x)
                held, n, passing = [], 0, True
        if held:
            yield links(held)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(runs, "u long, v long, key long")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """(key, fp, own, one, two): copies of the rows of large keys, for each pair of blocks that holds the row's own one."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    rows = with_keyed(rows, sizes, ["key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("key", "fp", "own", F.least("own", "x").alias("one"), F.greatest("own", "x").alias("two"))


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v) of fingerprints (fp, distinct): links that connect the same ones as all pairs at most four bits apart."""

    def exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            for k in range(0, len(fp), 1000):
                row, key = keys_of(fp[k : k + 1000])
                yield pd.DataFrame({"key": key, "fp": fp[k : k + 1000][row]})

    rows = prints.select("fp").mapInPandas(exploded, "key long, fp long")
    found = written(swept(rows, ["key"], most=block), "links", batch_rows=50_000)
    out = found.filter("key is null").select("u", "v")
    large = found.filter("key is not null").select("key", F.col("u").alias("fp"))
    if large.isEmpty():
        return out
    rows = in_blocks(large, block)
    within = rows.filter("one = two").drop("own")
    across = rows.filter("one < two")
    by = ["key", "one", "two"]
    both = swept(within, by).unionByName(swept(across, by, sides=True))
    return out.unionByName(written(both, "block-links", batch_rows=50_000).select("u", "v"))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, fp, component_id) of each row: its fingerprint, and the smallest id that links lead to."""
    own = written(fingerprints(docs, key, text), "prints")
    prints = written(own.groupBy("fp").agg(F.count("*").alias("n"), F.min("id").alias("low")), "fps")
    label = components(links(prints, block)).select(F.col("node").alias("fp"), "label")
    prints = written(prints.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    classes = prints.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    of = with_keyed(prints.withColumnRenamed("n", "rows"), classes, ["label"]).select("fp", F.col("rows").alias("n"), "component_id")
    return with_keyed(own, of, ["fp"]).select(F.col("id").alias(key), "fp", "component_id")


def op12_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
