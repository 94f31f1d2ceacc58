"""Document fingerprints by I-Match with randomised lexicons.

Terms are the lower-cased words between white space, hashed to 64 bits. Document frequencies are counted for each
term over all documents: documents are dealt by ranges of keys, each range gives its distinct terms with their counts,
these meet by ranges of hashes, and a range of keys gets back a bit for each of its own terms, whether it is in the
band, so no task holds the lexicon of the whole corpus. A text keeps its distinct terms whose inverse document frequency, as a share of
log N, lies in the band.

A lexicon subset (family, level) is a pseudo-random share of 2 ** -level of all terms. The text's terms in it are sorted
and hashed, and a hash survives only edits that touch none of them; so a text of 2 ** n to 2 ** (n + 1) kept terms uses the
subsets of levels n + 1, n + 2 and n + 3 of each family, which hold one of its terms or few. The fingerprint is n and the list
of these hashes, 0 where the text has no term in the subset. The likeness of two fingerprints is the share of equal
hashes among the subsets that both use and one at least has terms in.

Defined cases: a null text counts as empty; texts that keep no term have the hash of all their distinct
terms instead, and are alike (1) if it is equal, else not (0); equal texts have equal fingerprints; a null key sorts
first; rows that share a key are ordered by a hash of their text, then by text; a table of one row is its own next document; an empty
table gives an empty result; columns beyond key and text are not read. A range of keys is held
in memory where it is compared; a key that many rows share is split over ranges by that hash, rows equal in key and text are in one.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, text_or_empty

#: Families of nested lexicon subsets, and how many levels of each a text uses.
FAMILIES, LEVELS = 24, 3
BAND = (0.2, 0.95)
#: Ranges of hashes at least, and bytes of text for each where there are more; the terms of a range, with the counts of all documents, are held in memory at once.
SLICES, SLICE_BYTES = 256, 1 << 30
#: Bytes of text in a range of keys, which is held in memory where it is compared.
RANGE_BYTES = 16 << 20
#: Hashes that a range of keys gathers before it counts them.
GATHERED = 1 << 22

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([xxhash.xxh3_64_intdigest(b"lexicon", seed=k) for k in range(FAMILIES)], np.uint64)


def terms(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the words."""
    own = set(text.lower().split())
    out = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in own), np.uint64, len(own))
    return np.unique(out)


def borders(head: str, rest: str) -> np.ndarray:
    """Terms among which are all of head + rest that neither whole text may have: the words at the seam and at rest's end."""
    x, y, last = "".join(head.rsplit(None, 1)[-1:]), "".join(rest.split(None, 1)[:1]), "".join(rest.rsplit(None, 1)[-1:])
    return terms(f"{x} {y} {x}{y} {last}")


def edit(text: str, after: str) -> tuple[str, str]:
    """What stays of a text whose second half is replaced, and the part of the next one that is put there."""
    half = len(text) // 2
    return text[: len(text) - half], after[:half]


def counted(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and the sum of the counts of each."""
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return own, np.bincount(at, np.concatenate(counts), len(own)).astype(np.int64)


def planes(values: np.ndarray) -> bytes:
    """Integers as all their first bytes, then all their second ones and so on: small ones compress well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def slices_for(size: int) -> int:
    """A power of two: how many ranges of hashes a corpus of that many bytes has."""
    return max(SLICES, 1 << (-(-size // SLICE_BYTES) - 1).bit_length() if size > SLICE_BYTES else 1)


def slices(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n ranges, a power of two, begins among sorted hashes, and the end."""
    return np.searchsorted(hashes >> np.uint64(32), np.arange(n + 1, dtype=np.uint64) << np.uint64(32 - n.bit_length() + 1))


def lexicon_of(own: list[np.ndarray], found: pd.DataFrame, n_slices: int) -> np.ndarray:
    """The terms of a part that are in the band. own: all terms that lexicons() finds in it; found: its rows of lexicons()."""
    hashes = np.unique(np.concatenate(own))
    cuts, inside = slices(hashes, n_slices), np.zeros(len(hashes), bool)
    for k, bits in zip(found["slice"], found["bits"]):
        inside[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[k + 1] - cuts[k])
    return hashes[inside]


def lexicons(dealt: DataFrame, n: int, n_slices: int = SLICES, band: tuple[float, float] | None = None) -> DataFrame:
    """Rows (part, slice, bits): for the sorted distinct terms of each part of with_next() in a slice, whether their frequency among all n documents is in the band.

    Terms of a halo row, and those that only edited texts have, are looked up and not counted.
    """
    band = band or BAND

    def occurring(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, own, size = None, None, ([], []), 0

        def sliced() -> pd.DataFrame:
            hashes, counts = counted(*own)
            cuts = slices(hashes, n_slices)
            rows = [(k, part, planes(np.diff(hashes[i:j], prepend=np.uint64(0))), planes(counts[i:j].astype("<i4"))) for k, (i, j) in enumerate(zip(cuts, cuts[1:])) if i < j]
            return pd.DataFrame(rows, columns=["slice", "part", "hashes", "counts"]).astype({"slice": "int32", "part": "int32"})

        for b in batches:
            for p, halo, text in zip(b["part"], b["halo"], b["__t"]):
                if p != part:
                    if part is not None:
                        yield sliced()
                    part, last, own, size = p, None, ([], []), 0
                found = [(terms(text), 0 if halo else 1)] + ([] if last is None else [(borders(*edit(last, text)), 0)])
                for h, count in found:
                    own[0].append(h)
                    own[1].append(np.full(len(h), count, np.int64))
                    size += len(h)
                if size > GATHERED:
                    h, counts = counted(*own)
                    own, size = ([h], [counts]), 0
                last = text
        if part is not None:
            yield sliced()

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def kept(k: int, rows: list[tuple[int, bytes, bytes]]) -> pd.DataFrame:
            own = [np.cumsum(from_planes(h, "<u8"), dtype=np.uint64) for _, h, _ in rows]
            hashes, counts = counted(own, [from_planes(c, "<i4") for *_, c in rows])
            inside = in_band(n, counts, band)
            out = [(part, k, np.packbits(inside[np.searchsorted(hashes, h)]).tobytes()) for (part, *_), h in zip(rows, own)]
            return pd.DataFrame(out, columns=["part", "slice", "bits"]).astype({"part": "int32", "slice": "int32"})

        at, rows = None, []
        for b in batches:
            for k, *row in zip(b["slice"], b["part"], b["hashes"], b["counts"]):
                if k != at and rows:
                    yield kept(at, rows)
                    rows = []
                at = k
                rows.append(row)
        if rows:
            yield kept(at, rows)

    found = dealt.mapInPandas(occurring, "slice int, part int, hashes binary, counts binary")
    return found.repartition("slice").sortWithinPartitions("slice").mapInPandas(chosen, "part int, slice int, bits binary")


def in_band(n: int, df: np.ndarray, band: tuple[float, float] = BAND) -> np.ndarray:
    """Whether a term's inverse document frequency is in the band, as a share of log n."""
    idf = np.log(max(n, 2) / np.maximum(df, 1)) / np.log(max(n, 2))
    return (df > 0) & (idf >= band[0]) & (idf <= band[1])


def fingerprint(own: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """The text's octave of kept terms plus 1, and a 32-bit hash for each of its lexicon subsets, by level, then family.

    own: the text's terms; lexicon: the sorted terms in the band, the text's at least.
    """
    at = np.searchsorted(lexicon, own)
    kept = own[np.append(lexicon, np.uint64(0))[at] == own] if len(lexicon) else own[:0]
    out = np.zeros(1 + LEVELS * FAMILIES, np.uint32)
    if not len(kept):
        out[1] = xxhash.xxh3_64_intdigest(own.tobytes()) & 0xFFFFFFFF
        return out
    octave = len(kept).bit_length() - 1
    mixed = (kept[None, :] ^ _SEEDS[:, None]) * _MUL
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MUL
    out[0] = octave + 1
    family, term = np.nonzero(mixed < np.uint64(2 ** (63 - octave)))
    high = mixed[family, term]
    for k in range(LEVELS):
        inside = high < np.uint64(2 ** (63 - octave - k))
        own_family = family[inside]
        raw, cuts = kept[term[inside]].tobytes(), np.searchsorted(own_family, np.arange(FAMILIES + 1)) * 8
        for f in np.unique(own_family).tolist():
            out[1 + k * FAMILIES + f] = (xxhash.xxh3_64_intdigest(raw[cuts[f] : cuts[f + 1]], seed=(octave + k) * FAMILIES + f) & 0xFFFFFFFF) or 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if a[0] == 0 or b[0] == 0:
        return float((a == b).all())
    shift = int(b[0]) - int(a[0])
    if abs(shift) >= LEVELS:
        return 0.0
    x, y = a[1 + max(shift, 0) * FAMILIES :], b[1 + max(-shift, 0) * FAMILIES :]
    n = min(len(x), len(y))
    x, y = x[:n], y[:n]
    met = (x != 0) | (y != 0)
    return float((x == y)[met].mean()) if met.any() else float((a == b).all())


def with_next(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ranges: int | None = None, size: int | None = None) -> DataFrame:
    """Rows (part, halo, sort key, key, text), dealt by part and sorted: each part holds a range of keys, and behind it, as a
    row with halo 1, the document that follows its last one; behind the last range that is the first document of all.

    Ranges follow the size of all texts. Only keys are read to find them; the texts are shuffled once. One number for
    each range comes to the driver.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if ranges is None:
        size = (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) if size is None else size  # one number
        ranges = max(2 * tasks, -(-size // RANGE_BYTES))
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("__k"), F.col(key), text_or_empty(text).alias("__t")).withColumn("__h", F.xxhash64("__t"))
    cuts = docs.agg(F.percentile_approx("__k", [k / ranges for k in range(1, ranges)], 100 * ranges)).first()[0] if ranges > 1 else []
    keys, times = np.unique(np.array(cuts or [], np.int64), return_counts=True)
    # a key that is met m times among the cuts is cut m - 1 times more, by its hash
    edges = [(int(k), -(2**63) + i * 2**64 // int(m)) for k, m in zip(keys, times) for i in range(int(m))]

    def places_of(k: pd.Series, h: pd.Series) -> np.ndarray:
        own = k.to_numpy(np.int64)
        out = np.searchsorted(np.array([e[0] for e in edges], np.int64), own)
        there = np.flatnonzero(np.isin(own, keys))
        out[there] = [bisect.bisect_right(edges, x) for x in zip(own[there].tolist(), h.to_numpy(np.int64)[there].tolist())]
        return out

    @F.pandas_udf("int")
    def part(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(places_of(k, h).astype(np.int32))

    first = sorted((r["p"], tuple(r["x"])) for r in docs.groupBy(part("__k", "__h").alias("p")).agg(F.min(F.struct("__k", "__h")).alias("x")).collect())
    before = {x: first[i - 1][0] for i, (_, x) in enumerate(first)}
    starts = {k for k, _ in before}

    @F.pandas_udf("array<struct<part:int,halo:int>>")
    def places(k: pd.Series, h: pd.Series) -> pd.Series:
        halo = [before.get(x) if x[0] in starts else None for x in zip(k, h)]
        return pd.Series([[{"part": int(p), "halo": 0}] + ([] if b is None else [{"part": b, "halo": 1}]) for p, b in zip(places_of(k, h), halo)])

    out = docs.select("*", F.inline(places("__k", "__h")))
    return out.repartition(max(tasks, ranges // 4), F.col("part")).sortWithinPartitions("part", "halo", "__k", "__h", "__t").select("part", "halo", "__k", "__h", F.col(key).alias("__id"), "__t")


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dealt, n_slices = with_next(docs, size=size), slices_for(size)

    def compared(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["halo", "__k", "__h", "__t"])
        every = [terms(t) for t in texts["__t"]]
        lexicon = lexicon_of([*every, *(borders(*edit(t, after)) for t, after in zip(texts["__t"], texts["__t"][1:]))], found, n_slices)
        rows, last = [], None
        for halo, key, text, found_terms in zip(texts["halo"], texts["__k"].where(texts["__id"].notna(), None).astype("Int64"), texts["__t"], every):
            own = fingerprint(found_terms, lexicon)
            if last is not None:
                edited = "".join(edit(last[1], text))
                mark = fingerprint(terms(edited), lexicon)
                rows.append((last[0], len(last[1]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), last[2].tobytes().hex(), mark.tobytes().hex(), likeness(last[2], mark), likeness(last[2], own)))
            last = None if halo else (key, text, own)
        return pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.groupBy("part").cogroup(lexicons(dealt, n, n_slices).groupBy("part")).applyInPandas(compared, schema)
