"""Vector codes, SimHash classes and conversation tries on small cases, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import prefix_trie, simhash, vector_codes


def coded_by_hand(rows):
    """{id: (code, error)}, codebooks of rows (id, label, vector) by brute force in Python's integers."""
    kept = [(k, label, [math.floor(1024 * x) for x in v]) for k, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    size = len(kept[0][2]) // 4
    cut = lambda v: [v[i * size : (i + 1) * size] for i in range(4)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:256]
    books = [[cut(r[2])[p] for r in first] for p in range(4)]
    for _ in range(5):
        found = [[min((sum((a - b) ** 2 for a, b in zip(cut(v)[p], e)), i) for i, e in enumerate(books[p])) for p in range(4)] for _, _, v in kept]
        final, members = [list(b) for b in books], defaultdict(list)
        for (_, _, v), f in zip(kept, found):
            for p in range(4):
                members[p, f[p][1]].append(cut(v)[p])
        for (p, i), parts in members.items():
            books[p][i] = [sum(x) // len(parts) for x in zip(*parts)]
    out = [(k, label, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for (k, label, _), f in zip(kept, found)]
    return out, hashlib.sha256(",".join(str(x) for b in final for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("scale", [1.0, 50_000.0])
def test_vector_codes_are_brute_force(spark, tmp_path, scale):
    rng = random.Random(4)
    vector = lambda: [float(np.float32(rng.gauss(0, 0.1) * scale)) for _ in range(8)]
    rows = [(k, k % 3 if k % 5 else None, vector()) for k in range(400, 20, -1)]
    rows += [(7, 1, None), (8, 1, []), (9, None, [0.1] * 7 + [None]), (10, 2, [0.1] * 7 + [math.nan]), (11, 2, [math.inf] * 8), (30, 1, vector()), (None, 1, vector())]
    rows += [rows[3], rows[3]] + [(1000 + k, 7, rows[9][2]) for k in range(40)]
    spark.createDataFrame([(k, v, label) for k, label, v in rows], VECTORS).withColumn("code", F.lit("mine")).withColumn("n", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()
    want, digest = coded_by_hand(rows)
    total = Counter()
    for _, label, _, error in want:
        total[label] += error
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter((k, code, error, total[label]) for k, label, code, error in want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_vector_codes_of_few_rows_and_none(spark, tmp_path):
    for name, rows in {"few": [(1, [0.5] * 4, 1), (2, [1.5] * 4, None), (3, [1.0] * 3, 1)], "none": []}.items():
        spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    got = {r["vec_id"]: (r["code"], r["error"]) for r in vector_codes.op11_vector_codes(spark, f"{tmp_path}/few").collect()}
    assert got == {1: ("00000000", 0), 2: ("01010101", 0)}
    assert vector_codes.op11_vector_codes(spark, f"{tmp_path}/none").count() == 0


def test_a_cell_keeps_every_entry_that_may_be_nearest():
    rng = np.random.default_rng(3)
    entries = rng.integers(-400, 400, (256, 6))
    cells = vector_codes.Cells(entries, most=50)
    parts = np.r_[rng.integers(-500, 500, (300, 6)), entries[rng.integers(0, 256, 300)] + rng.integers(-3, 3, (300, 6))]
    for k in range(0, 600, 40):
        index, distance = cells.nearest(parts[k : k + 40])
        d = ((parts[k : k + 40, None] - entries) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert cells.compared < 0.5 * 256 * cells.asked
    repeated = vector_codes.Cells(entries)
    repeated.nearest(np.repeat(parts[:5], 20, axis=0))
    assert repeated.cells <= 5 and repeated.asked == 100


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def connected(prints):
    """{fingerprint: smallest one that is connected to it} by comparing all."""
    names = sorted(set(prints))
    low = dict(zip(names, names))
    for i, a in enumerate(names):
        for b in names[:i]:
            if (a ^ b).bit_count() <= 4 and low[a] != low[b]:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {k: new if v == old else v for k, v in low.items()}
    return low


def test_golay_words_are_three_bits_from_a_codeword_at_most():
    words = np.random.default_rng(2).integers(0, 1 << 23, 2000)
    index = simhash.decoded(words)
    back = (index << 11) | simhash._REMAINDER[index]
    assert np.bitwise_count(back ^ words).max() == 3
    assert (simhash.decoded(back) == index).all()
    a = np.arange(1 << 12) << 11 | simhash._REMAINDER
    assert min(np.bitwise_count(a[1:])) == 7


def test_pairs_four_bits_apart_share_a_key():
    rng = np.random.default_rng(1)
    one = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    two = one.copy()
    for i in range(len(two)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            two[i] ^= np.uint64(1 << int(b))
    keys = [defaultdict(set), defaultdict(set)]
    for own, prints in zip(keys, (one, two)):
        for row, key in zip(*(x.tolist() for x in simhash.keys_of(prints.view(np.int64)))):
            own[row].add(key)
    assert all(keys[0][i] & keys[1][i] for i in range(2000))


@pytest.mark.parametrize("block", [4096, 8])
def test_links_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(150)} | {0}
    for base in [0, *rng.sample(sorted(prints), 8)]:
        last = base
        for _ in range(25):  # clusters and chains
            last = (base if rng.random() < 0.5 else last) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
            prints.add(last)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(x),) for x in prints], "fp long").repartition(3), block).collect()
    low = {x: x for x in prints}
    for u, v in found:
        u, v = u & (1 << 64) - 1, v & (1 << 64) - 1
        old, new = max(low[u], low[v]), min(low[u], low[v])
        low = {k: new if x == old else x for k, x in low.items()}
    assert low == connected(prints)


def test_simhash_is_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeÉßX") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \t\x0b\n ", "One", "one", "two words", "a b c d", "a B c D", "  a b c d e"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([5, 60, 200, 400]))]
        texts.append(" ".join(base))
        for _ in range(4):
            w = list(base)
            w[rng.randrange(len(w))] = "edited"
            texts.append("  ".join(w))
    texts.append(" ".join(word() for _ in range(40_000)))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[-2]), (None, texts[20]), (5, texts[5]), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("label", F.lit("x")).repartition(4)
    low = connected([slow_print(t) for _, t in rows])
    smallest = {}
    for k, t in rows:
        if k is not None:
            smallest[low[slow_print(t)]] = min(k, smallest.get(low[slow_print(t)], k))
    got = simhash.near_components(docs).collect()
    assert Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == Counter((k, slow_print(t), smallest[low[slow_print(t)]]) for k, t in rows)
    assert len(smallest) < len({slow_print(t) for _, t in rows})
    assert simhash.near_components(docs.filter("false")).count() == 0


def trie_by_hand(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    out = Counter()
    for path, m in members.items():
        below = [p for p in members if p[: len(path)] == path]
        n_children = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        out[m[0], len(path), members[path[:-1]][0] if path else None, len(m), n_children(path), sum(n_children(p) == 0 for p in below), saved, digest] += 1
    return out


TALKS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment, limit", [(1024, 4 << 20), (3, 4 << 20), (4, 300)])
def test_prefix_trie_is_brute_force(spark, segment, limit):
    rng = random.Random(11)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["hi", "ä ö", "", None, "yes please"]))
    rows = []
    long = [say() for _ in range(14)]
    for c in [*range(40), -3, -10, -12, 101]:
        talk = long[: rng.randint(1, 14)] if c % 3 else [say() for _ in range(rng.randint(1, 9))]
        if c % 7 == 0:
            talk = [*talk[:-1], say()]
        rows += [(c, k if k else None, *t) for k, t in enumerate(talk)]
    rows += [(200, k, "user", "alone") for k in range(30)] + [(203, k, "user", "alone") for k in range(25)] + [(None, 1, "user", "lost")]
    docs = spark.createDataFrame(rows, TALKS).withColumn("depth", F.lit("x")).withColumn("pos", F.lit(1)).repartition(3)
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(docs, segment, limit).collect())
    want = trie_by_hand(rows)
    assert got == want
    assert max(want.values()) == 1


def test_prefix_trie_of_ties_one_turn_and_none(spark):
    rows = [(5, None, "user", "b"), (5, None, "user", "b"), (5, 1, None, None), (6, 1, "user", "x"), (6, 1, "user", "x")]
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, TALKS)).collect())
    assert got == trie_by_hand(rows)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALKS)).count() == 0


def test_more_slices_change_no_fingerprint(spark, tmp_path, monkeypatch):
    from textloom.llm import imatch

    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 60, 200])))) for k in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    few = sorted(map(tuple, imatch.op9_imatch(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(imatch, "SLICE_BYTES", 16)
    assert imatch.slices_for(20_000) == 2048
    assert sorted(map(tuple, imatch.op9_imatch(spark, str(tmp_path)).collect())) == few
