"""Removal of repeated byte strings by a distributed suffix sort over a difference cover.

Wanted: every byte of a 200-byte string (``length``) that also starts somewhere else. A suffix sort of all positions
would need a row for each byte (two thirds of them in the first round of sampled triples); so the cover that is
sampled here is chosen by content, one position in 64, and suffixes are told apart only to the depth that is asked for:

1. Sample. Of the 128 eight-byte grams that start in a window's first 128 places, the one with the smallest hash
   marks the window's sample position. Equal windows have it at the same place, so two suffixes that agree for 200
   bytes meet at a common sample position, which is what a difference cover is for. A sample stands for all windows
   that it marks, which start 0 to 127 places before it.
2. Sort and name. A sample's name is the fingerprint of the bytes that all its possible windows share; behind it
   stands the fingerprint of all bytes that its own windows cover, then its place. Samples are range-partitioned and sorted by all of
   these, so that a name with any number of samples is spread over as many tasks as it fills, and neighbours are compared: a
   neighbour with the same name and bytes repeats all windows; without a neighbour of the same name none is repeated.
   Only the first and the last row of each task are compared across tasks.
3. Recurse on the names. Samples of one name whose bytes differ, one or two for each of the differing byte strings,
   are cut into narrower runs of windows (16, then 4), which are sorted, named and compared in the same way.
4. Merge what remains: single windows, sorted by the 128-bit fingerprint of their 200 bytes and their distance from
   the sample. Adjacent prefixes of 200 bytes that are equal are repeats.

No join has a name as its key. Removed runs are judged on the input. Matches don't cross documents, as windows don't.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; rows that share an id are told
apart by their text, and equal rows are copies of each other; an empty table gives an empty result; columns beyond
id and text are not read. Any order serves that puts equal strings side by side: it is that of 64-bit fingerprints.
A repeat is two equal fingerprints, 128 bits together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import discard, table, text_or_empty, written

LENGTH, GRAM, WINDOW = 200, 8, 128
#: Windows in a run at each level, by their distance from the sample.
WIDTHS = (WINDOW, 16, 4, 1)
#: Rows that a task hands on at once; they are of bounded size.
AT_ONCE = 1 << 14

_MUL = np.uint64(0x9E3779B97F4A7C15)
_HIGH, _LOW, _HALF = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF), np.uint64(32)


def samples(raw: bytes, length: int = LENGTH, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last): the sample positions, and the first and last start of the windows of each."""
    n = len(raw) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    grams = np.ndarray((len(raw) - GRAM + 1,), "<u8", raw, strides=(1,)) * _MUL
    grams ^= grams >> _HALF
    grams *= _MUL
    grams &= _HIGH
    grams |= np.arange(len(grams), dtype=np.uint64)
    grams = grams[: n + window - 1]
    size = -(-len(grams) // window) * window
    cells = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    cells[: len(grams)] = grams
    cells = cells.reshape(-1, window)
    ahead = np.minimum.accumulate(cells, axis=1).ravel()
    back = np.minimum.accumulate(cells[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(back[:n], ahead[window - 1 : window - 1 + n]) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return place[first], first, np.r_[first[1:], n] - 1


def runs(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that windows starting in [first, last] cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order]) + length
    new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
    return a[new], b[np.r_[new[1:], len(a)] - 1]


def _row_key(text: Column) -> Column:
    return F.xxhash64(text)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """docs without the text under its name, with d and r, which tell documents apart, and t, the text."""
    t = text_or_empty(text)
    names = {"d": F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))), "r": _row_key(t), "t": t}
    return docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("own"), *[c.alias(n) for n, c in names.items()])


def named(raw: bytes, at: int, low: int, high: int, width: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(name, whole, low, high) for each run of width windows among those that start low to high places before a sample at position at."""
    for k in range(low // width, high // width + 1):
        a, b = max(low, k * width), min(high, (k + 1) * width - 1)
        name = xxhash.xxh3_64_intdigest(raw[at - k * width : at - (k + 1) * width + 1 + length], seed=k)
        yield name, xxhash.xxh3_64_intdigest(raw[at - b : at - a + length], seed=b + 1), a, b


NAMES = "name long, whole long, d long, r long, place long"
#: A sample's position and its nearest and furthest windows' distance in one number.
_at = lambda: F.shiftright("place", 16)
_low = lambda: F.shiftright("place", 8).bitwiseAND(F.lit(255))
_high = lambda: F.col("place").bitwiseAND(F.lit(255))


def _names(name, whole, d, r, place) -> pd.DataFrame:
    own = lambda x: np.array(x, np.uint64).view(np.int64)
    return pd.DataFrame({"name": own(name), "whole": own(whole), "d": d, "r": r, "place": place}).astype("int64")


def neighbours(names: DataFrame) -> DataFrame:
    """(d, r, place, up, down) of the rows that agree with the row before (up) or behind (down) in sorted order: 1 by name, 2 by name and whole."""
    key = ["name", "whole", "d", "r", "place"]

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, no, held, up = TaskContext.get().partitionId(), 0, None, 0

        def out(b: pd.DataFrame, up: np.ndarray, down: np.ndarray, last: bool) -> pd.DataFrame:
            nonlocal no
            b = b.assign(task=np.int32(task), no=np.arange(no, no + len(b)), up=up, down=down, edge=False)
            b["edge"] = (b["no"] == 0) | last
            no += len(b)
            return b

        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            name, whole = b["name"].to_numpy(), b["whole"].to_numpy()
            same = (name[1:] == name[:-1]).astype(np.int8)
            same += same * (whole[1:] == whole[:-1])
            ups = np.r_[np.int8(up), same]
            if len(b) > 1:
                yield out(b.iloc[:-1], ups[:-1], same, False)
            held, up = b.iloc[-1:], ups[-1]
        if held is not None:
            yield out(held, np.array([up], np.int8), np.zeros(1, np.int8), True)

    met = names.repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(marked, f"{NAMES}, task int, no long, up tinyint, down tinyint, edge boolean")
    met = met.filter("edge or up > 0 or down > 0").select("d", "r", "place", "up", "down", "edge", *[F.when(F.col("edge"), F.col(c)).alias(c) for c in ("name", "whole", "task", "no")])
    met = written(met, "neighbours", batch_rows=AT_ONCE)
    tasks = Window.orderBy("task", "no")  # two rows of each task

    def across(move: Callable[[str], Column]) -> Column:
        there = {c: move(c).over(tasks) for c in ("task", "name", "whole")}
        return F.when((there["task"] != F.col("task")) & (there["name"] == F.col("name")), F.when(there["whole"] == F.col("whole"), 2).otherwise(1)).otherwise(0).cast("tinyint")

    edges = met.filter("edge").withColumns({"__up": across(F.lag), "__down": across(F.lead)})
    edges = edges.select("d", "r", "place", F.greatest("up", "__up").alias("up"), F.greatest("down", "__down").alias("down"))
    return met.filter("not edge").select("d", "r", "place", "up", "down").unionByName(edges)


def repeated_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(d, r, first, last): ranges of starts of repeated windows; docs as _documents() gives them."""
    shared = length - WINDOW + 1

    def sampled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            name, whole, d, r, place = [], [], [], [], []
            for one, two, t in zip(b["d"], b["r"], b["t"]):
                raw = t.encode("utf-8", "surrogatepass")
                at, first, last = samples(raw, length)
                low, high = at - last, at - first
                name += [xxhash.xxh3_64_intdigest(raw[a : a + shared]) for a in at.tolist()]
                whole += [xxhash.xxh3_64_intdigest(raw[f : e + length], seed=h + 1) for f, e, h in zip(first.tolist(), last.tolist(), high.tolist())]
                d.append(np.full(len(at), one))
                r.append(np.full(len(at), two))
                place.append(at << 16 | low << 8 | high)
                if len(name) > AT_ONCE:
                    yield _names(name, whole, *map(np.concatenate, (d, r, place)))
                    name, whole, d, r, place = [], [], [], [], []
            if name:
                yield _names(name, whole, *map(np.concatenate, (d, r, place)))

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, r, t, places in zip(b["d"], b["r"], b["t"], b["places"]):
                raw = t.encode("utf-8", "surrogatepass")
                for k in range(0, len(places), AT_ONCE):
                    rows += [(d, r, p, raw[(p >> 16) - (p & 255) : (p >> 16) - (p >> 8 & 255) + length]) for p in places[k : k + AT_ONCE].tolist()]
                    if len(rows) > AT_ONCE:
                        yield pd.DataFrame(rows, columns=["d", "r", "place", "raw"])
                        rows = []
            yield pd.DataFrame(rows, columns=["d", "r", "place", "raw"])

    def finer(width: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for d, r, place, raw, runs in zip(b["d"].tolist(), b["r"].tolist(), b["place"].tolist(), b["raw"], b["runs"]):
                    for p in runs.tolist():
                        rows += [(n, w, d, r, p >> 16 << 16 | low << 8 | high) for n, w, low, high in named(raw, place & 255, p >> 8 & 255, p & 255, width, length)]
                yield _names(*(zip(*rows) if rows else [()] * 5))

        return cut

    names = written(docs.filter(F.octet_length("t") >= length).select("d", "r", "t").mapInPandas(sampled, NAMES), "names")
    out = parts = None
    for width, below in zip(WIDTHS, [*WIDTHS[1:], 0]):
        met = neighbours(names)
        discard(names)
        alike = met.filter("up = 2 or down = 2").select("d", "r", (_at() - _high()).cast("int").alias("first"), (_at() - _low()).cast("int").alias("last"))
        out = alike if out is None else out.unionByName(alike)
        apart = met.filter("up = 1 or down = 1").select("d", "r", "place")
        if not below or apart.isEmpty():
            break
        if parts is None:
            those = apart.groupBy("d", "r").agg(F.collect_set("place").alias("places"))
            parts = written(docs.select("d", "r", "t").join(those, ["d", "r"]).mapInPandas(covered, "d long, r long, place long, raw binary"), "parts")
            cut = parts.withColumn("runs", F.array("place"))
        else:
            those = apart.groupBy("d", "r", _at().alias("at")).agg(F.collect_set("place").alias("runs"))
            cut = parts.withColumn("at", _at()).join(those, ["d", "r", "at"]).drop("at")
        names = written(cut.mapInPandas(finer(below), NAMES), "names", batch_rows=AT_ONCE // 8)
    return out


def _kept(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """What remains between the removed runs."""
    edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(raw)]
    return [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """docs with raw, the text's remaining bytes, in the text's place, and with n_bytes, n_removed and n_spans.

    as_text: the text stays under its name instead, as what remains of it without the pieces of characters that were cut.
    """
    columns = docs.columns
    docs = _documents(docs.drop("n_bytes", "n_removed", "n_spans", *([] if as_text else ["raw"])), key, text)
    spans = repeated_windows(docs, length).groupBy("d", "r").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    joined = (lambda parts: "".join(x.decode("utf-8", "ignore") for x in parts)) if as_text else b"".join

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, spans in zip(b["t"], b["spans"]):
                raw, n = t.encode("utf-8", "surrogatepass"), 0
                parts, removed = [raw], 0
                if spans is not None:
                    a, e = runs(np.array([x["first"] for x in spans]), np.array([x["last"] for x in spans]), length)
                    parts, removed, n = _kept(raw, a, e), int((e - a).sum()), len(a)
                rows.append((joined(parts), len(raw), removed, n))
            yield b[["own"]].assign(**dict(zip(["kept", "n_bytes", "n_removed", "n_spans"], map(list, zip(*rows)) if rows else [[]] * 4)))

    kind = "string" if as_text else "binary"
    schema = T.StructType([docs.schema["own"], *T.StructType.fromDDL(f"kept {kind}, n_bytes long, n_removed long, n_spans long").fields])
    out = docs.join(spans, ["d", "r"], "left").select("own", "t", "spans").mapInPandas(cut, schema)
    own = [F.col("kept").alias(text) if c == text else F.col(f"own.`{c}`") for c in columns if c in docs.schema["own"].dataType.names or c == text] if as_text else ["own.*", F.col("kept").alias("raw")]
    return out.select(*own, "n_bytes", "n_removed", "n_spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("raw", 256).alias("kept_sha256"))
