"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Documents with the same set of shingles become one node; only nodes are joined.
2. Every set is embedded as 64 sampled tokens (minima under 64 hash functions): two sets share a token at a given
   place with probability J.
3. A run splits all nodes by the tokens at places that a hash of the path so far chooses, 1 / 0.8 places a bucket in
   the mean, so a pair of similarity 0.8 keeps one common child in the mean. A bucket is left as a leaf when it is
   small, when a split of its parent hardly split it (its members are alike), or at the last level. Runs are
   repeated until a pair at the threshold is met with the target recall: a branching process gives the chance of
   one run, averaged over how many of the 64 tokens such a pair shares (see ``runs_for``).
4. Leaves are compared by brute force: first the 64 tokens, then, for the pairs these leave, the whole sets. Leaves
   too large for one task are cut into blocks, and each pair of blocks is a task's group. A pair that meets in
   several leaves belongs to the smallest, so it is verified and counted once.

Tasks give no pairs but, for each node, its links and the smallest node that its links lead to, which is all that
components and counts need; so a group of n near copies gives n rows. In leaves too large for one task, nodes within half
the distance that the threshold allows from the leaf's first node are at home there: by the triangle inequality
(Jaccard's distance is a metric) they are all linked to each other, so their links are counted by the group's size and
never compared, and a clique of close copies costs work in proportion to its nodes. Only others are compared by blocks.

Defined cases: texts with fewer than five words have one shingle of all their words; null, empty and blank texts
have none, link to nothing and are a class of their own each; rows that share an id are told apart by their texts, so each has
the class of its text; equal rows count as copies; a null id counts as an id made of its text; an empty table gives an
empty result; columns beyond id and text are not read. Nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table, text_or_empty, written
from textloom.llm.graph import components

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.999
PLACES, LEVELS, LEAF, BLOCK, SALTS = 64, 3, 48, 2048, 64

_MUL = np.uint64(0x9E3779B97F4A7C15)
_A = np.array([xxhash.xxh3_64_intdigest(b"a", seed=k) | 1 for k in range(PLACES)], np.uint64)
_B = np.array([xxhash.xxh3_64_intdigest(b"b", seed=k) for k in range(PLACES)], np.uint64)


class Words(dict):
    """64-bit hashes of words, kept while there are at most 300,000."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def shingles(text: str, hashes: Words, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of width lower-cased words."""
    words = text.lower().split()
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    n = max(1, len(w) - width + 1)
    out = w[:n].copy()
    for k in range(1, min(width, len(w))):
        out ^= out >> np.uint64(32)
        out *= _MUL
        out += w[k : n + k]
    out ^= out >> np.uint64(29)
    out *= _MUL
    return np.unique(out ^ (out >> np.uint64(32)))


def sampled(own: np.ndarray) -> np.ndarray:
    """The set's token at each place, as int32."""
    low = np.full(PLACES, 2**32 - 1, np.uint64)
    for k in range(0, len(own), 4096):
        np.minimum(low, ((own[None, k : k + 4096] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1), out=low)
    return low.astype(np.uint32).view(np.int32)


def likely(threshold: float) -> int:
    """Sampled tokens that a pair at the threshold shares at least, but for four standard deviations."""
    return int(PLACES * threshold - 4 * math.sqrt(PLACES * threshold * (1 - threshold)))


def runs_for(recall: float, threshold: float = THRESHOLD, levels: int = LEVELS) -> int:
    """Runs that meet a pair at the threshold with that recall.

    The pair shares a binomial number of the sampled tokens. Given it, q is the chance that a bucket at a level still
    leads to a common leaf.
    """
    more, chances = 1 / threshold - 1, []
    for k in range(likely(threshold), PLACES + 1):
        q = 1.0
        for _ in range(levels):
            miss = 1 - k / PLACES * q
            q = 1 - ((1 - more) * miss + more * miss**2)
        chances.append((math.comb(PLACES, k) * threshold**k * (1 - threshold) ** (PLACES - k), q))
    if recall >= sum(p for p, _ in chances):
        raise ValueError(f"a recall of {recall} is out of reach with {PLACES} sampled tokens")
    return next(n for n in itertools.count(1) if sum(p * (1 - (1 - q) ** n) for p, q in chances) >= recall)


def children(path: Column, tokens: Column, more: float) -> Column:
    """Keys of the buckets below path that the tokens lead to: one place always, a second one with chance ``more``."""
    place = lambda j: F.pmod(F.xxhash64(path, F.lit(j)), F.lit(PLACES)).cast("int")
    key = lambda j: F.xxhash64(path, place(j), F.get(tokens, place(j)))
    second = F.pmod(F.xxhash64(path, F.lit(-1)), F.lit(1000)) < int(1000 * more)
    return F.when(second, F.array(key(0), key(1))).otherwise(F.array(key(0)))


def node_of(own: np.ndarray) -> int:
    """A set's node."""
    return int.from_bytes(xxhash.xxh3_128_digest(own.tobytes())[:8], "little", signed=True)


def _id(key: str, text: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.xxhash64(text))


def nodes_of(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, node) for each document, and for each node (node, low, n, tokens): its smallest id, documents and sampled tokens."""

    def embedded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for b in batches:
            sets = [shingles(t, hashes) for t in b["t"]]
            node = pd.array([node_of(s) if len(s) else None for s in sets], "Int64")
            yield pd.DataFrame({"id": b["id"], "text_hash": b["text_hash"], "node": node, "tokens": [sampled(s) if len(s) else None for s in sets]})

    t = text_or_empty(text)
    rows = docs.select(_id(key, text).alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))
    rows = written(rows.mapInPandas(embedded, "id long, text_hash long, node long, tokens array<int>"), "embedded")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.any_value("tokens").alias("tokens"))
    return rows.select("id", "text_hash", "node"), written(nodes, "nodes")


def leaves_of(nodes: DataFrame, runs: int, threshold: float, levels: int = LEVELS, leaf: int = LEAF, alike: float = 0.5) -> DataFrame:
    """(leaf, node, size) of all leaves with at least two nodes. alike: a bucket with that share of its parent's nodes isn't split again."""
    more = 1 / threshold - 1
    start = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: children(F.xxhash64(F.lit("run"), r), F.col("tokens"), more))
    front, out = nodes.select("node", F.explode(F.flatten(start)).alias("leaf"), F.lit(None).cast("long").alias("above")), None
    for level in range(1, levels + 1):
        sizes = front.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")
        front = written(front.join(sizes, "leaf"), "level")
        done = (F.col("size") <= leaf) | F.coalesce(F.col("size") >= alike * F.col("above"), F.lit(False)) | F.lit(level == levels)
        closed = front.filter(done).select("leaf", "node", "size")
        out = closed if out is None else out.unionByName(closed)
        if level < levels:
            front = front.filter(~done).join(nodes.select("node", "tokens"), "node").select("node", F.explode(children(F.col("leaf"), F.col("tokens"), more)).alias("leaf"), F.col("size").alias("above"))
    return out


def grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted batches, cut anew so that no group of equal ``by`` is split."""
    rest: list[pd.DataFrame] = []
    for b in batches:
        same = (b[by] == b[by].iloc[-1]).all(axis=1).to_numpy()
        tail = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if tail == 0 and rest and (rest[-1][by].iloc[-1] == b[by].iloc[0]).all():
            rest.append(b)
            continue
        if tail == 0:
            if rest:
                yield pd.concat(rest, ignore_index=True)
            rest = [b]
            continue
        yield pd.concat([*rest, b.iloc[:tail]], ignore_index=True)
        rest = [b.iloc[tail:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


GROUP = ["leaf", "one", "two"]


def blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds (one, two, own): the pair of blocks that a copy of the row is for, and the row's own block.

    Leaves of at most block nodes have one block. In larger ones the nodes of the most frequent home have blocks of
    their own, which meet those of the other nodes and not each other.
    """
    small = rows.filter(F.col("size") <= block).select("*", *[F.lit(0).alias(c) for c in ("own", "one", "two")]).drop("size")
    large = rows.filter(F.col("size") > block)
    homes = large.groupBy("leaf", "home").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.max(F.struct("k", "home")).alias("most"))
    parts = lambda n: F.ceil(n / block).cast("int")
    k = F.col("most.k")
    large = large.join(homes, "leaf").withColumns({"__d": parts(k), "__e": parts(F.col("size") - k), "__main": F.col("home") == F.col("most.home")})
    place = lambda n: F.pmod(F.xxhash64("node", F.lit("block")), F.greatest(n, F.lit(1))).cast("int")
    large = large.withColumn("own", F.when(F.col("__main"), place(F.col("__d"))).otherwise(F.col("__d") + place(F.col("__e"))))
    first = F.when(F.col("__main"), F.col("__d")).otherwise(F.lit(0))
    meets = F.filter(F.sequence(F.lit(0), F.col("__d") + F.col("__e")), lambda x: (x >= first) & (x < F.col("__d") + F.col("__e")))
    large = large.withColumn("__x", F.explode(meets)).withColumn("one", F.least("own", "__x")).withColumn("two", F.greatest("own", "__x"))
    return small.unionByName(large.drop("__x", "__d", "__e", "__main", "most", "size"))


def candidates(b: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of a group's rows that share at least that many tokens, that are not of one home, nor of one block while the group is for two, and that meet in no smaller leaf."""
    ids = pd.factorize(pd.MultiIndex.from_frame(b[GROUP]))[0] if len(b) > 1 else np.zeros(len(b), int)
    tokens = np.stack(b["tokens"].to_numpy())
    own, two, home = b["own"].to_numpy(), b["one"].to_numpy() != b["two"].to_numpy(), b["home"].to_numpy()
    width = max(len(x) for x in b["leaves"])
    leaves = np.stack([np.pad(np.asarray(x, np.int64), (0, width - len(x)), mode="edge") for x in b["leaves"]])
    leaf = b["leaf"].to_numpy()
    left, right = [], []
    for shift in range(1, len(b)):
        i = np.flatnonzero(ids[:-shift] == ids[shift:])
        if not len(i):
            break
        for k in range(0, len(i), 8192):
            p = i[k : k + 8192]
            q = p + shift
            apart = (~two[p] | (own[p] != own[q])) & (home[p] != home[q])
            p, q = p[apart], q[apart]
            near = (tokens[p] == tokens[q]).sum(axis=1) >= least
            p, q = p[near], q[near]
            if len(p):
                common = (leaves[p][:, :, None] == leaves[q][:, None, :]).any(axis=2)
                first = np.where(common, leaves[p], np.iinfo(np.int64).max).min(axis=1)
                left.append(p[first == leaf[p]])
                right.append(q[first == leaf[p]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] and sets[right]; left is ascending runs of a group's rows."""
    out = np.zeros(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(left[order])) + 1) if len(left) else []:
        own = sets[left[run[0]]]
        if len(run) < 4:
            for k in run:
                out[k] = len(np.intersect1d(own, sets[right[k]], assume_unique=True))
        else:
            sizes = [len(sets[right[k]]) for k in run]
            found = np.isin(np.concatenate([sets[right[k]] for k in run]), own, kind="sort")
            out[run] = np.add.reduceat(found, np.r_[0, np.cumsum(sizes)[:-1]])
    return out


def homes_of(texts_of: Callable[[DataFrame], DataFrame], nodes: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """(node, home, n) of the nodes of large leaves (leaf, node) that are within half the distance of a first node of theirs."""
    first = large.groupBy("leaf").agg(F.min("node").alias("home"))
    pairs = written(large.join(first, "leaf").groupBy("node").agg(F.min("home").alias("home")), "first")
    texts = written(texts_of(pairs.select("node").unionByName(pairs.select(F.col("home").alias("node"))).distinct()), "large-texts")
    # a home's nodes are spread over SALTS tasks, each of which gets its text
    salted = pairs.join(texts, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    own = salted.join(texts.select(F.col("node").alias("home"), F.col("t").alias("home_t"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).join(pairs.select("home").distinct(), "home"), ["home", "salt"])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, last, whole = Words(), None, None
        for b in batches:
            kept = []
            for node, home, t, h in zip(b["node"], b["home"], b["t"], b["home_t"]):
                if h != last:
                    last, whole = h, shingles(h, hashes)
                s = shingles(t, hashes)
                both = len(np.intersect1d(s, whole, assume_unique=True))
                union = len(s) + len(whole) - both
                # rows of other texts with the same id are no node's
                kept.append(node_of(s) == node and node_of(whole) == home and union - both <= (1 - threshold) / 2 * union - 1e-9)
            yield b.loc[kept, ["node", "home"]]

    found = own.sortWithinPartitions("home").mapInPandas(near, "node long, home long").distinct()
    return written(found.join(nodes.select("node", "n"), "node"), "homes")


def links(docs: DataFrame, nodes: DataFrame, leaves: DataFrame, key: str, text: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(node, to, links): for each leaf and node with links there, the smallest node they lead to in the leaf, and the documents at their other ends."""
    least = likely(threshold)

    def texts_of(some: DataFrame) -> DataFrame:
        """(node, t) of some nodes; rows of other texts with a node's smallest id are among them."""
        ids = some.join(nodes.select("node", F.col("low").alias("id")), "node")
        own = docs.select(_id(key, text).alias("id"), text_or_empty(text).alias("t")).join(ids.select("id").distinct().hint("merge"), "id", "left_semi")
        return ids.join(own.hint("merge"), "id").select("node", "t")

    large = leaves.filter(F.col("size") > block).select("leaf", "node")
    homes = None if large.isEmpty() else homes_of(texts_of, nodes, large, threshold)
    leaves = leaves.distinct()
    leaves = leaves.withColumn("home", F.col("node")) if homes is None else leaves.join(homes.select("node", F.col("home").alias("__h")), "node", "left").withColumn("home", F.coalesce("__h", "node")).drop("__h")
    of = leaves.groupBy("node").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    rows = blocks(leaves.join(nodes.select("node", "tokens"), "node").join(of, "node"), block)

    def likely_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in grouped(batches, GROUP):
            p, q = candidates(b, least)
            yield b.iloc[np.unique(np.r_[p, q])][[*GROUP, "own", "node", "home"]]

    def sort(df: DataFrame) -> DataFrame:
        return df.repartition(*GROUP).sortWithinPartitions(*GROUP, "node")

    picked = written(sort(rows).mapInPandas(likely_rows, "leaf long, one int, two int, own int, node long, home long"), "likely")
    texts = texts_of(picked.select("node").distinct())
    full = picked.join(nodes.select("node", "n", "tokens"), "node").join(of, "node").join(texts.hint("merge"), "node")

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Words()
        for b in grouped(batches, GROUP):
            sets = [shingles(t, hashes) for t in b["t"]]
            # rows of other texts with the same id go
            own = np.array([len(s) > 0 and node_of(s) == k for s, k in zip(sets, b["node"])]) & ~b.duplicated([*GROUP, "node", "t"]).to_numpy()
            sets = [s for s, x in zip(sets, own) if x]
            b = b[own].reset_index(drop=True)
            first = ~b.duplicated([*GROUP, "node"]).to_numpy()
            sets, b = [s for s, x in zip(sets, first) if x], b[first].reset_index(drop=True)
            if not len(b):
                continue
            p, q = candidates(b, least)
            size = np.array([len(s) for s in sets])
            both = shared(sets, p, q)
            sure = both >= threshold * (size[p] + size[q] - both) - 1e-9
            p, q = p[sure], q[sure]
            node, n = b["node"].to_numpy(), b["n"].to_numpy()
            count = np.bincount(p, n[q], len(b)) + np.bincount(q, n[p], len(b))
            low, before = node.copy(), None
            while before is None or (low != before).any():
                before = low.copy()
                np.minimum.at(low, p, low[q])
                np.minimum.at(low, q, low[p])
            has = np.flatnonzero(count)
            yield pd.DataFrame({"node": node[has], "to": low[has], "links": count[has].astype(np.int64)})

    found = written(sort(full).mapInPandas(verified, "node long, to long, links long"), "links")
    if homes is None:
        return found
    sizes = homes.groupBy("home").agg(F.sum("n").alias("all"), F.count("*").alias("k")).filter("k > 1")
    return found.unionByName(homes.join(sizes, "home").select("node", F.col("home").alias("to"), (F.col("all") - F.col("n")).alias("links")))


def near_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(key, text_hash, class_id, class_key, set_id, n_links) for each document: the smallest id of its group of linked
    documents, a number of that group (null for blank texts), the smallest id of the documents with its set of shingles,
    and how many other documents are similar to it. text_hash, xxhash64 of the text, tells rows apart that share an id."""
    rows, nodes = nodes_of(docs.select(key, text), key, text)
    found = links(docs, nodes, leaves_of(nodes, runs_for(recall, threshold), threshold), key, text, threshold, block)
    label = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    own = nodes.select("node", "low", "n").join(degree, "node", "left").join(label, "node", "left").withColumn("class_key", F.coalesce("label", "node"))
    classes = own.groupBy("class_key").agg(F.min("low").alias("class_id"))
    own = own.join(classes, "class_key").select("node", F.col("low").alias("set_id"), "class_id", "class_key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.join(own, "node", "left")
    return out.select(F.col("id").alias(key), "text_hash", F.coalesce("class_id", "id").alias("class_id"), "class_key", F.coalesce("set_id", "id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "set_id", "n_links")
