"""The operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import gzip
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

import corpus_pipeline
from textloom.llm import chat_format, imatch, ngram_jaccard, quality_gam, quality_rules, registry, sentence_pieces, source_mixing, suffix_dedup, token_shards, warc
from textloom.llm.bpe_words import TOKENIZERS
from textloom.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 40, 120, 400])) for _ in range(25)]
    near = []
    for t in base[:8]:
        w = t.split()
        w[len(w) // 2] = "changed"
        near.append(" ".join(w))
    passage = words(rng, 60)
    texts = [None, "", "   ", "é" * 300, *base, *base[:5], *near, *(f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}" for _ in range(4)), "z" * 900, words(rng, 3000)]
    out = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[6], (None, base[9], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("ids", F.lit(7)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_ngram_jaccard_is_brute_force(spark, docs, rows, none):
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_jaccard.near_classes(docs).collect())
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t, *_ in rows]
    alike = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    links = [sum(alike(sets[i], sets[j]) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    own = {k: k for k, *_ in rows if k is not None}
    known = [r for r in got.elements() if r[0] in own]
    assert Counter((k, n) for k, _, n in known) == Counter((r[0], links[i]) for i, r in enumerate(rows) if r[0] is not None)
    classes = {k: c for k, c, _ in known}
    for i in range(len(rows) - 1):
        for j in range(i):
            assert (classes[rows[i][0]] == classes[rows[j][0]]) == (group[i] == group[j] or rows[i][0] == rows[j][0])
    assert ngram_jaccard.near_classes(none).count() == 0


def test_rows_of_one_id_keep_their_own_classes(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 60) for _ in range(3))
    d = spark.createDataFrame([(1, a), (1, b), (2, b), (3, c), (1, a), (4, a + " tail")], "doc_id long, text string")
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_jaccard.near_classes(d).collect())
    assert got == Counter({(1, 1, 2): 2, (1, 1, 1): 1, (2, 1, 1): 1, (3, 3, 0): 1, (4, 1, 2): 1})
    keys = {(r["doc_id"], r["text_hash"]): r["class_key"] for r in ngram_jaccard.near_classes(d).collect()}
    assert len(set(keys.values())) == 3


def test_blocks_of_a_large_leaf_meet(spark):
    rng = random.Random(1)
    w = words(rng, 150).split()
    texts = []
    for k in range(60):
        x = list(w)
        x[k * 2] = f"new{k}"
        texts.append((k, " ".join(x)))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = ngram_jaccard.near_classes(d, block=16).collect()
    assert {r["class_id"] for r in got} == {0} and all(r["n_links"] == 59 for r in got)


def test_cliques_are_counted_by_home(spark, seed=1):
    """Close copies of one text, further ones, and ones of these, in leaves far above the block, with repeated rows and ids."""
    rng = random.Random(seed)
    w = [f"{x}{k}" for k, x in enumerate(words(rng, 300).split())]

    def changed(base, n):
        x = list(base)
        for k in rng.sample(range(2, 298), n):
            x[k] = f"new{rng.randrange(10**9)}"
        return x

    far = changed(w, 6)
    texts = [" ".join(changed(w, rng.choice([1, 1, 2]))) for _ in range(70)] + [" ".join(changed(far, rng.choice([1, 2, 4]))) for _ in range(30)] + [" ".join(changed(w, rng.choice([5, 8, 12]))) for _ in range(20)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(500, texts[0]), (501, texts[75]), (3, words(rng, 50)), (90, texts[1])]
    rng.shuffle(rows)
    sets = [frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (t.split() for _, t in rows)]
    links = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = ngram_jaccard.near_classes(d, block=16).collect()
    hashed = {r["text"]: r["h"] for r in d.select("text", F.xxhash64("text").alias("h")).collect()}
    assert Counter((r["doc_id"], r["text_hash"], r["n_links"]) for r in got) == Counter((k, hashed[t], n) for (k, t), n in zip(rows, links))
    assert len(set(links)) > 5 and Counter(map(tuple, got)) == Counter(map(tuple, ngram_jaccard.near_classes(d).collect()))


def test_runs_reach_the_recall():
    assert ngram_jaccard.runs_for(0.999) > ngram_jaccard.runs_for(0.9) >= 2


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(1, 30)] + [(50, 40), (40, 50), (7, 7)], "u long, v long")
    assert {r["node"]: r["label"] for r in components(e).collect()} == {k: 1 for k in range(1, 31)} | {40: 40, 50: 40}


def test_quality_gam(spark, docs, none, sf):
    x = np.random.default_rng(0).random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x[:2000], y[:2000], rounds=20, pairs=2, pair_rounds=60)
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9  # only a pair can tell
    sf = sf.replace("sf0.001", "sf0.01")  # enough labels to tell
    got = quality_gam.op2_quality_gam(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.9 * len(got)
    labels = spark.createDataFrame([(1, 1), (4, None)], "doc_id long, quality int")
    out = quality_gam.score(docs, quality_gam.train(docs, labels))
    assert out.count() == docs.count() and out.filter("not score between 0 and 1 or score is null").count() == 0 and dict(out.dtypes)["score"] == "double"
    assert quality_gam.score(none, quality_gam.train(none, labels)).count() == 0


def test_gam_is_brute_force(spark):
    """Scores by plain look-ups; the first tree of each feature by trying every cut; loss falls with every round."""
    rng = np.random.default_rng(3)
    x, y = np.round(rng.random((300, 4)), 2), (rng.random(300) < 0.4).astype(float)
    m = quality_gam.fit(x, y, bins=8, rounds=4, pairs=3, pair_bins=4, pair_rounds=3)
    for row, s in zip(x, m.score(x)):
        f = m.intercept + sum(t[sum(e < v for e in edges)] for v, edges, t in zip(row, m.edges, m.tables))
        f += sum(t[sum(e < row[a] for e in m.pair_edges[a]), sum(e < row[b] for e in m.pair_edges[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        assert abs(s - 1 / (1 + math.exp(-f))) < 1e-9
    one = quality_gam.fit(x, y, bins=8, rounds=1, leaves=2, rate=1.0, pairs=0)
    f = np.full(len(y), one.intercept)
    for j in range(4):
        p = 1 / (1 + np.exp(-f))
        def fitted(left):
            value = lambda side: (y - p)[side].sum() / ((p * (1 - p))[side].sum() + 1.0)  # noqa: B023, E731
            gain = sum((y - p)[side].sum() ** 2 / ((p * (1 - p))[side].sum() + 1.0) for side in (left, ~left))  # noqa: B023
            return gain, np.where(left, value(left), value(~left))
        best = max((fitted(x[:, j] <= e) for e in one.edges[j] if (x[:, j] > e).any()), key=lambda g: g[0])
        assert np.allclose(one.tables[j][np.searchsorted(one.edges[j], x[:, j])], best[1])
        f = f + best[1]
    loss = lambda k: (lambda s: -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())(quality_gam.fit(x, y, rounds=k, pairs=2, pair_rounds=k).score(x))
    assert loss(1) > loss(3) > loss(9)


def test_gam_rows_that_share_an_id(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d e"), (1, "a b"), (None, "x"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1)], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = quality_gam.op2_quality_gam(spark, str(tmp_path)).collect()
    assert len(got) == 5 and all(r["held_out"] is not None and r["score"] is not None for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert {r["held_out"] for r in got if r["doc_id"] == 1} == {zlib.crc32(b"1") % 5 == 0}


def test_sources_meet_their_weights(spark, docs, none):
    d = spark.createDataFrame([(k, "x" * 50, "a" if k % 3 else "b") for k in range(3000)], "doc_id long, text string, source string")
    got = source_mixing.mix(d, weight=F.when(F.col("__source") == "a", 1.0).otherwise(3.0))
    n = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["b"] / (n["a"] + n["b"]) - 0.75) < 0.03 and abs(sum(n.values()) - 3000) < 250
    assert got.collect() == source_mixing.mix(d.repartition(5), weight=F.when(F.col("__source") == "a", 1.0).otherwise(3.0)).collect()
    many = source_mixing.mix(d.limit(300), target=40.0, weight=F.lit(1.0)).groupBy("doc_id").count().agg(F.avg("count"), F.variance("count")).first()
    assert many[0] > 16 and many[1] > 8
    assert set(source_mixing.mix(docs.withColumn("rate", F.lit("x"))).columns) == {*docs.columns, "copy", "rate", "mix_key"}
    assert source_mixing.mix(none).count() == 0


def test_shards(spark, docs, rows, none, tmp_path):
    path, how = f"file://{tmp_path}/shards", {"tokenizer": f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "length": 32, "per_shard": 10}
    d = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    index = token_shards.write_shards(d, path, **how)
    n = index.count()
    assert sorted(r["slot"] for r in index.collect()) == list(range(n))
    coder = token_shards.byte_pieces(how["tokenizer"])
    want = Counter(k for _, t, *_ in rows for k in np.frombuffer(coder.encode(t or ""), "<u2").tolist())
    read = token_shards.read_shards(spark, path).collect()
    found = Counter(k for r in read for k in np.frombuffer(bytes(r["tokens"]), "<u2").tolist())
    assert found - Counter({coder.eos: found[coder.eos]}) == want and len(read) == n
    assert token_shards.read_shards(spark, path, start=15).count() == n - 15
    sizes = [os.path.getsize(tmp_path / "shards" / f) for f in os.listdir(tmp_path / "shards") if f.endswith(".bin")]
    assert sorted(sizes)[1:] == [640] * (len(sizes) - 1)
    for n in (1, 2, 3, 17, 1000):
        assert sorted(token_shards.permute(np.arange(n), n).tolist()) == list(range(n))
    token_shards.write_shards(none, f"file://{tmp_path}/none", tokenizer=how["tokenizer"])
    assert token_shards.read_shards(spark, f"file://{tmp_path}/none").count() == 0


def feistel(i, n, seed):
    """The permutation in plain numbers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    while True:
        left, right = i >> half, i % 2**half
        for r in range(token_shards.ROUNDS):
            f = (right + seed * 0x9E3779B9 + r * 0x85EBCA6B + 1) * 0x9E3779B97F4A7C15 % 2**64
            f = (f ^ f >> 31) * 0xD6E8FEB86659FD93 % 2**64
            left, right = right, left ^ (f >> 29) % 2**half
        i = left << half | right
        if i < n:
            return i


def test_slots_hold_their_sequences(spark, tmp_path):
    """Two corpora, one behind the other, in one folder: each slot has the sequence that the permutation puts there."""
    path, how = f"file://{tmp_path}/s", {"tokenizer": f"{TOKENIZERS}/byte_bpe_50k.tiktoken", "length": 16, "per_shard": 4}
    coder, rng = token_shards.byte_pieces(how["tokenizer"]), random.Random(3)
    for size, seed in ((60, 1), (60, 2), (25, 2)):
        texts = [words(rng, rng.randint(0, 40)) for _ in range(size)]
        index = token_shards.write_shards(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, seed=seed, **how)
        raw = b"".join(coder.encode(t) + np.uint16(coder.eos).tobytes() for t in texts)
        n = -(-len(raw) // 32)
        raw += np.uint16(coder.eos).tobytes() * ((n * 32 - len(raw)) // 2)
        got = {r["slot"]: bytes(r["tokens"]) for r in token_shards.read_shards(spark, path).collect()}
        assert got == {feistel(i, n, seed): raw[32 * i : 32 * i + 32] for i in range(n)}
        assert {r["slot"]: r["shard"] for r in index.collect()} == {s: s // 4 for s in range(n)}


def test_the_mark_of_a_space_decodes_to_a_space(spark):
    docs = spark.createDataFrame([(1, "a\u2581b"), (2, "a b")], "doc_id long, text string")
    got = {r["doc_id"]: (r["ids_sha256"], r["round_trip"]) for r in sentence_pieces.encoded_digests(docs, MODEL).collect()}
    assert got[1][0] == got[2][0] and (got[1][1], got[2][1]) == (False, True)


def test_pieces_in_spark(spark, docs, rows, none, monkeypatch):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    monkeypatch.setattr(sentence_pieces.scan, "__defaults__", (4,))
    e = sentence_pieces.encode(docs, path=MODEL, chunk=100)
    assert dict(e.dtypes)["ids"] == "array<int>" and e.count() == len(rows)
    want = Counter((k, str(sp.encode(t or ""))) for k, t, *_ in rows)
    assert Counter((r["doc_id"], str(list(r["ids"]))) for r in e.collect()) == want
    assert sentence_pieces.encoded_digests(docs, MODEL).filter("not round_trip").count() == 0
    assert sentence_pieces.encode(none, path=MODEL).count() == 0


@pytest.mark.parametrize("kind", [1, 2])
def test_chunk_algebra(tmp_path, kind):
    """A hand-made model of each kind against the library, cut everywhere."""
    rng = random.Random(kind)
    m = sentencepiece_model_pb2.ModelProto()
    m.ParseFromString(open(MODEL, "rb").read())
    del m.pieces[259:]
    own = ["▁", *"abcd", *{"".join(rng.choice("▁abcd" if k == 0 else "abcd") for k in range(rng.randint(2, 5))) for _ in range(60)}]
    for k, p in enumerate(sorted(set(own), key=lambda p: (len(p), p)) if kind == 2 else own):
        x = m.pieces.add()
        x.piece, x.score = p, -float(k) if kind == 2 else -rng.uniform(2, 9) * (0.3 + 0.5 * len(p))
    m.trainer_spec.model_type = kind
    m.trainer_spec.vocab_size = len(m.pieces)
    path = tmp_path / "m.model"
    path.write_bytes(m.SerializeToString())
    p = sentence_pieces.Pieces(str(path))
    for _ in range(40):
        t = "".join(rng.choice("abcdabcdabcd z") for _ in range(rng.randint(1, 60)))
        s, pad = p.escaped(t), 2 * p.longest
        for c in (1, 3, 7):
            cut = [(s[max(0, a - pad) : a + c + pad], min(a, pad), min(a, pad) + min(c, len(s) - a)) for a in range(0, len(s), c)]
            states = sentence_pieces.chain([p.transfer(*x) for x in cut])
            got, want = [k for x, (i, o) in zip(cut, states) for k in p.chunk_ids(x[0], x[1], i, x[2], o)], p.sp.encode(t)
            if kind == 2:
                assert got == want
            else:  # paths of equal score may differ
                worth = lambda ids: sum(p.scores.get(p.sp.id_to_piece(k), p.unknown_score) for k in ids)
                assert abs(worth(got) - worth(want)) < 1e-6 and p.decode(np.array(got)) == t
    a, b, c = ({x: {y: float(rng.randint(-9, 9)) for y in range(3)} for x in range(3)} for _ in range(3))
    assert sentence_pieces.product(sentence_pieces.product(a, b), c) == sentence_pieces.product(a, sentence_pieces.product(b, c))


def test_scan_is_a_fold(spark):
    """States of a parallel scan over three levels, against the fold over a whole document."""
    rng = random.Random(4)
    state = [sentence_pieces.CLEAN, (-1, 1, 7), (-2, 2, 9)]
    rows, want = [], {}
    for r, n in ((1, 100), (2, 1), (3, 5), (4, 25)):
        own = [{x: {y: float(rng.randint(-9, 9)) for y in state if rng.random() < 0.9 or y == state[0]} for x in state} for _ in range(n)]
        rows += [(r, k, sentence_pieces._packed(m)) for k, m in enumerate(own)]
        found = sentence_pieces.chain(own)
        want[r] = sum(m[x][y] for m, (x, y) in zip(own, found))
        assert found[0][0] == found[-1][1] == sentence_pieces.CLEAN
    d = spark.createDataFrame(rows, "row long, no int, matrix string")
    got = sentence_pieces.scan(d, fan=4).collect()
    assert len(got) == len(rows)
    matrix = {(r, k): sentence_pieces._unpacked(m) for r, k, m in rows}
    found = {(g["row"], g["no"]): [tuple(x) for x in sentence_pieces.json.loads(g["states"])] for g in got}
    for r, worth in want.items():
        own = [found[r, k] for k in range(sum(x == r for x, *_ in rows))]
        assert own[0][0] == own[-1][1] == sentence_pieces.CLEAN and all(a[1] == b[0] for a, b in zip(own, own[1:]))
        assert sum(matrix[r, k][x][y] for k, (x, y) in enumerate(own)) == worth  # as good a path; equal ones may differ


def test_warc(spark, none, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "same"), (2, "http://b\n", "same"), (3, None, None), (4, "", ""), (5, "http://c", "é" * 70000), (2, "http://b\n", "same"), (None, "x", "y")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    assert warc.write_warc(pages, path, file_bytes=1000).agg(F.sum("captures")).first()[0] == 7
    c = warc.captures(warc.read_records(spark, path))
    got = sorted((r["p"], r["response"]["type"]) for r in c.filter("request.http like 'GET%'").select(F.coalesce(warc.page_id(), F.lit(-1)).alias("p"), "response").collect())
    assert got == [(-1, "response"), (1, "response"), (2, "revisit"), (2, "revisit"), (3, "response"), (4, "revisit"), (5, "response")]
    assert c.filter(F.col("response.payload") == F.lit(("é" * 70000).encode())).count() == 1
    assert warc.captures(warc.read_records(spark, path)).filter("metadata.id is null").count() == 0
    warc.write_warc(pages, f"file://{tmp_path}/x", min_bytes=1)
    assert warc.read_records(spark, f"file://{tmp_path}/x").filter("type = 'revisit'").count() == 2


def test_warc_of_others(spark, tmp_path):
    """Archives of other writers: lower-case names, no blank behind the colon, several concurrent-to, no gzip, one gzip member for all."""
    def rec(kind, name, body, *more):
        head = [f"warc-type:{kind}", f"WARC-RECORD-ID: <{name}>", f"Content-Length:   {len(body)}", *more]
        return ("WARC/1.0\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    one = rec("warcinfo", "i", b"x") + rec("response", "a", http + b"hello\r\n\r\nyou") + rec("Response", "b", http) + rec("metadata", "m", b"page-id: 5", "WARC-Concurrent-To: <a>", "warc-concurrent-to:<b>") + rec("metadata", "k", b"page-id: 6", "WARC-Concurrent-To: <a>")
    two = rec("request", "q", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <c>") + b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <c>\r\n\r\n" + http + b"rest"
    (tmp_path / "one.warc").write_bytes(one)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(two))
    (tmp_path / "none.warc").write_bytes(b"")
    got = {r["record_id"]: r for r in warc.captures(warc.read_records(spark, f"file://{tmp_path}")).withColumn("page", warc.page_id()).collect()}
    assert {k: (r["page"], bytes(r["response"]["payload"]), r["n_requests"], r["n_metadata"]) for k, r in got.items()} == {"<a>": (6, b"hello\r\n\r\nyou", 0, 2), "<b>": (5, b"", 0, 1), "<c>": (None, b"rest", 1, 0)}
    assert got["<c>"]["request"]["id"] == "<q>" and got["<b>"]["response"]["payload_digest"] == warc.base32_sha1(b"")


def test_null_page_id_is_the_response(spark, tmp_path):
    spark.createDataFrame([(None, "x", "same"), (3, "y", "same"), (4, "z", "other")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = warc.op6_warc(spark, str(tmp_path)).collect()
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got} == {(None, "response", None), (3, "revisit", None), (4, "response", None)} and {r["payload_bytes"] for r in got} == {4, 5}


def test_chats(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    rows = [
        (1, 0, None, None, [("a", "search", '{"limit": 2, "query": "é"}'), ("b", "search", '{"query": "x", "limit": 1, "after": "a"}')], None),
        (1, 1, "tool", "hit", None, "a"),
        (1, 2, "tool", "hit again", None, "a"),
        (1, 3, "tool", "lost", None, "zz"),
        (2, 0, "user", "", [("c", "search", '{"query": 1, "limit": 1}'), ("d", "other", "{}"), ("e", "lookup", "nope"), ("f", "lookup", '{"query": "q", "after": "g"}'), ("g", "lookup", '{"query": "q", "after": "f"}')], None),
    ]
    m = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content string, calls {call}, answers string")
    got = {(r["kind"], r["call_id"], r["turn"]): r for r in chat_format.format_chats(m).collect()}
    a, b = got["call", "a", 0], got["call", "b", 0]
    assert a["valid"] and a["linked"] and a["level"] == 0 and b["level"] == 1 and not b["linked"]
    assert a["json"] == '{"arguments":{"limit":2,"query":"é"},"id":"a","tool":"search"}'
    assert not got["result", "zz", 3]["linked"] and got["result", "a", 2]["linked"]
    assert [got["call", k, 0]["valid"] for k in "cdefg"] == [False, False, False, True, True]
    assert got["call", "f", 0]["level"] is None and got["call", "e", 0]["json"] == '{"arguments":"nope","id":"e","tool":"lookup"}'
    assert got["message", None, 0]["json"] in ('{"content":"","role":"unknown"}', '{"content":"","role":"user"}')
    assert chat_format.format_chats(m.limit(0)).count() == 0


def test_levels_of_chains(spark):
    rows = [(1, f"c{i}", f"c{i - 1}" if i else None) for i in range(37)] + [(1, f"t{i}", "c20") for i in range(5)]
    rows += [(2, "x", "y"), (2, "y", "z"), (2, "z", "x"), (2, "w", "x"), (2, "self", "self"), (2, "m", "gone"), (2, "n", "m"), (2, "c1", "c0"), (None, "a", None)]
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()
    want = {(1, f"c{i}"): i for i in range(37)} | {(1, f"t{i}"): 21 for i in range(5)} | {(None, "a"): 0}
    assert len(got) == len(want) and {(r["conv_id"], r["call_id"]): r["level"] for r in got} == want


@pytest.mark.parametrize("seed", range(2))
def test_levels_of_lists(spark, seed):
    """Several needs a call, some in a cycle or missing, against a plain search."""
    rng = random.Random(seed)
    ids = [f"c{k}" for k in range(40)]
    needs = {x: {rng.choice(ids[:k] if k and rng.random() < 0.96 else [*ids, "gone"]) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} for k, x in enumerate(ids)}
    level, more = {}, True
    while more:
        new = {x: 1 + max((level[y] for y in n), default=-1) for x, n in needs.items() if x not in level and all(y in level for y in n)}
        level |= new
        more = bool(new)
    rows = [(7, x, y) for x, n in needs.items() for y in (n or {None})]
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()
    assert {r["call_id"]: r["level"] for r in got} == level and len(got) == len(level)


def test_a_cycle_beside_deep_needs_has_no_level(spark):
    """Over 31 rounds for calls that each need the three before; a cycle elsewhere doubles its weights meanwhile."""
    rows = [(1, f"c{k}", f"c{k - j}" if k else None) for k in range(36) for j in (1, 2, 3) if k >= j or (j == 1 and not k)]
    rows += [(2, "v", "w"), (2, "w", "v"), (2, "x", "y"), (2, "y", "z"), (2, "z", "x"), (2, "u", "z"), (2, "t", None)]
    got = chat_format.levels(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in got} == {(1, f"c{k}"): k for k in range(36)} | {(2, "t"): 0}


def test_calls_keep_their_own_needs(spark):
    call = "array<struct<id:string,name:string,arguments:string>>"
    rows = [
        (1, 0, [("a", "lookup", '{"query":"q"}'), ("b", "lookup", '{"query":"q","after":"a"}'), ("d", "lookup", '{"query":"q","after":["b"]}'), ("d", "lookup", '{"query":"q","after":"a"}')]),
        (1, 1, [("e", "lookup", '{"query":"q","after":["a","d"]}'), ("f", "lookup", '{"query":"q","after":["a","gone"]}'), ("g", "lookup", '{"query":"q","after":[1]}')]),
        (1, 1, [("e", "lookup", '{"query":"q","after":["a","d"]}')]),
        (None, 0, [("a", "lookup", '{"query":"q"}'), ("b", "lookup", '{"query":"q","after":"a"}')]),
    ]
    m = spark.createDataFrame([(c, t, "user", None, x, None, "mine") for c, t, x in rows], f"conv_id long, turn long, role string, content string, calls {call}, answers string, level string")
    got = [r for r in chat_format.format_chats(m).collect() if r["kind"] == "call"]
    assert Counter((r["conv_id"], r["call_id"], r["level"], r["valid"]) for r in got) == Counter(
        {(1, "a", 0, True): 1, (1, "b", 1, True): 1, (1, "d", 2, True): 1, (1, "d", 1, True): 1, (1, "e", 3, True): 2, (1, "f", None, True): 1, (1, "g", None, False): 1, (None, "a", 0, True): 1, (None, "b", None, True): 1}
    )


def test_arguments_have_one_form(spark):
    same = ['{"n":1e2}', '{ "n" : 100 }', '{"n":100.0}', '{"n":1.00E+2}']
    more = [r'{"n":"1e2 \" 1.50","m":[1.50,-0.0,2e-3]}', '{"n":1e40}', '{"n":-12.5,"b":{"z":1,"a":true}}']
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*same, *more]], "raw string").select(F.to_json(F.try_parse_json(chat_format.one_form(F.col("raw"))))).collect()]
    assert got[:4] == ['{"n":100}'] * 4 and got[4] == r'{"m":[1.5,0,0.002],"n":"1e2 \" 1.50"}' and got[6] == '{"b":{"a":true,"z":1},"n":-12.5}'
    schema = {"type": "object", "additionalProperties": False, "required": ["a"], "properties": {"a": {"type": "object", "required": ["k"], "properties": {"k": {"enum": ["x", 2]}}}, "l": {"type": "array", "items": {"type": "integer"}}}}
    cases = {'{"a":{"k":"x"}}': True, '{"a":{"k":2.0,"more":1}}': True, '{"a":{"k":"y"}}': False, '{"a":{}}': False, '{"a":3}': False, '{"a":{"k":"x"},"l":[1,2]}': True, '{"a":{"k":"x"},"l":[1,"2"]}': False, '{"a":{"k":"x"},"l":[1.5]}': False, '{"a":{"k":"x"},"z":1}': False, "[1]": False, "3": False}
    d = spark.createDataFrame([(x,) for x in cases], "raw string").withColumn("v", F.try_parse_json(chat_format.one_form(F.col("raw"))))
    assert {r["raw"]: r["ok"] for r in d.select("raw", chat_format.valid(F.lit("t"), F.col("v"), {"t": schema}).alias("ok")).collect()} == cases


def brute_repeats(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, y in zip(t, gone) if not y)
        yield len(t), sum(gone), sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()


def test_repeats_are_brute_force(spark, docs, rows, none):
    got = suffix_dedup.remove_repeats(docs.withColumn("raw", F.lit(1)))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["raw"]).hexdigest()) for r in got.collect()) == Counter((r[0], *x) for r, x in zip(rows, brute_repeats([(t or "").encode() for _, t, *_ in rows], 200)))
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_repeats_of_one_passage(spark, seed):
    """Pieces of one passage between unlike surroundings, in more tasks than a name has rows."""
    rng = random.Random(seed)
    passage = words(rng, 200)
    texts = []
    for k in range(60):
        a = rng.randrange(len(passage) - 150)
        texts.append(words(rng, rng.randint(0, 30)) + passage[a : a + rng.randint(150, 600)] + words(rng, rng.randint(0, 30)) + "ab" * rng.choice([0, 0, 150]))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)).collect()
    want = {k: x for k, x in enumerate(brute_repeats([t.encode() for t in texts], 200))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["raw"]).hexdigest()) for r in got} == want


def test_fingerprints(spark, docs, rows, none, tmp_path):
    for name, d in (("full", docs.drop("score", "ids")), ("none", none)):
        d.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = imatch.op9_imatch(spark, f"{tmp_path}/full").collect()
    hashed = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t, *_ in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = [(k, t) for k, _, t in sorted((-(2**63) if k is None else k, hashed[t or ""], t or "") for k, t, *_ in rows)]
    want = Counter()
    for i, (k, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        want[None if k == -(2**63) else k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by = defaultdict(set)
    for r in got:
        by[next(t or "" for k, t, *_ in rows if k == r["doc_id"])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by.values())
    assert imatch.op9_imatch(spark, f"{tmp_path}/none").count() == 0


def test_imatch_counts_each_term(spark, tmp_path):
    """Fingerprints against document frequencies of single terms; the words of one document only share their first 20 bits with others'."""
    rng, by = random.Random(9), defaultdict(list)
    for k in range(40_000):
        by[xxhash.xxh3_64_intdigest(f"w{k}".encode()) >> 44].append(f"w{k}")
    alike = [ws[:2] for ws in by.values() if len(ws) > 1][:300]
    texts = [" ".join([*words(rng, 60).split(), *(p[k % 2] for p in alike[k // 2 :: 20])]) for k in range(40)]
    texts = [f"{t} {texts[0][:40]}\n" if k % 3 else t for k, t in enumerate(texts)]
    own = [set(t.lower().split()) for t in texts]
    df = Counter(w for ws in own for w in ws)

    def fingerprint(text):
        every = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w in set(text.lower().split()))
        kept = sorted(xxhash.xxh3_64_intdigest(w.encode()) for w in set(text.lower().split()) if df[w] and 0.2 <= np.log(40 / df[w]) / np.log(40) <= 0.95)
        if not kept:
            return 0, {0: xxhash.xxh3_64_intdigest(np.array(every, np.uint64).tobytes()) & 0xFFFFFFFF}
        octave, out = int(np.log2(len(kept))), {}
        for level in range(octave + 1, octave + 4):
            for f in range(imatch.FAMILIES):
                m = [h for h in kept if (lambda x: (x ^ (x >> 29)) * 0x9E3779B97F4A7C15 % 2**64)((h ^ int(imatch._SEEDS[f])) * 0x9E3779B97F4A7C15 % 2**64) < 2.0 ** (64 - level)]
                if m:
                    out[level, f] = xxhash.xxh3_64_intdigest(np.array(m, np.uint64).tobytes(), seed=(level - 1) * imatch.FAMILIES + f) & 0xFFFFFFFF
        return octave + 1, out

    def written_out(mark):
        octave, own = mark
        return np.array([octave, *(own.get((octave + k, f) if octave else (k or f), 0) for k in range(imatch.LEVELS) for f in range(imatch.FAMILIES))], np.uint32).tobytes().hex()

    def near(a, b):
        if not a[0] or not b[0]:
            return float(a == b)
        both = {(k, f) for k in range(max(a[0], b[0]), min(a[0], b[0]) + 3) for f in range(imatch.FAMILIES)} & (a[1].keys() | b[1].keys())
        return sum(a[1].get(x) == b[1].get(x) for x in both) / len(both) if both else 0.0

    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for r in imatch.op9_imatch(spark, str(tmp_path)).collect():
        t, after = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 40]
        own, edited = fingerprint(t), fingerprint(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        assert r["fingerprint"] == written_out(own) and r["edited_fingerprint"] == written_out(edited)
        assert abs(r["near_edited"] - near(own, edited)) < 1e-9 and abs(r["near_next"] - near(own, fingerprint(after))) < 1e-9


def test_imatch_tells_edits_from_others(spark, sf):
    got = imatch.op9_imatch(spark, sf.replace("sf0.001", "sf0.01")).agg(F.avg("near_edited"), F.avg("near_next"), F.avg((F.col("near_edited") > F.col("near_next")).cast("int"))).first()
    assert got[0] > 0.15 and got[1] < 0.05 and got[2] > 0.9


def test_shared_keys_are_split(spark):
    """A key that most rows share fills several ranges; each row has its successor."""
    d = spark.createDataFrame([(None if k % 4 else k, f"text {k} {k % 50}") for k in range(400)], "doc_id long, text string")
    got = imatch.with_next(d, ranges=8).collect()
    own = Counter(r["part"] for r in got if not r["halo"])
    assert sum(own.values()) == 400 and len(own) >= 6 and max(own.values()) < 120
    whole = sorted((r["__k"], r["__h"], r["__t"]) for r in got if not r["halo"])
    for p in own:
        part = sorted((r["halo"], r["__k"], r["__h"], r["__t"]) for r in got if r["part"] == p)
        last = max(x[1:] for x in part if not x[0])
        after = next(x[1:] for x in part if x[0])
        assert after == whole[(whole.index(last) + 1) % 400]


def test_rules(spark, docs, none):
    m = quality_rules.measures(docs)
    a = quality_rules.cascade(m, quality_rules.order_rules(m, quality_rules.default_rules(), times=2))
    b = quality_rules.cascade(m, quality_rules.default_rules()[::-1])
    assert {r["doc_id"]: r["failed_rule"] is None for r in a.collect()} == {r["doc_id"]: r["failed_rule"] is None for r in b.collect()}
    t = spark.createDataFrame([("a b c a b c x",), ("a a a a a",), (None,), ("x\ny y\nx\n\n\n",)], "text string")
    got = [(r["n_words"], r["n_repeat_words"], r["n_dup_lines"]) for r in quality_rules.measures(t).collect()]
    assert got == [(7, 6, 0), (5, 5, 0), (0, 0, 0), (4, 0, 1)]
    assert quality_rules.cascade(quality_rules.measures(none), quality_rules.order_rules(quality_rules.measures(none), quality_rules.default_rules())).count() == 0


def test_rules_are_sampled_where_the_rows_lie(spark):
    rows = spark.range(0, 9000, 1, 6).withColumn("part", F.spark_partition_id())
    got = quality_rules.drawn(rows, 0.2, 7)
    assert got.rdd.getNumPartitions() == 1 and {r["part"] for r in got.select("part").distinct().collect()} == set(range(6))
    assert "Exchange SinglePartition" in got._jdf.queryExecution().executedPlan().toString() and "Coalesce" not in got._jdf.queryExecution().executedPlan().toString()


def test_rules_are_ordered_by_rejections_per_cost(spark):
    assert quality_rules.ranked([1.0, 1.0, 10.0], [(5, (True, False, True)), (4, (True, True, False)), (3, (False, False, True)), (2, (False, True, False))]) == [0, 1, 2]
    assert quality_rules.ranked([1.0, 0.1], [(5, (True, False)), (4, (True, True))]) == [1, 0]
    assert quality_rules.ranked([1.0, 1.0, 1.0], [(6, (True, True, False)), (1, (True, False, False)), (2, (False, False, True))]) == [0, 2, 1]  # the second rejects nothing behind the first
    d = spark.createDataFrame([(k, f"word {k} " * 300) for k in range(200)], "doc_id long, text string")
    dear = F.size(F.array_distinct(F.transform(F.split("text", ""), lambda c: F.md5(c)))) > 3
    rules = [quality_rules.Rule("dear", dear), quality_rules.Rule("cheap", F.col("doc_id") % 2 == 0), quality_rules.Rule("never", F.col("doc_id") < 0)]
    assert [r.name for r in quality_rules.order_rules(d, rules, times=5)] == ["cheap", "dear", "never"]
    own = quality_rules.measures(d.withColumn("__words", F.lit("mine")).withColumn("n_words", F.lit("x")))
    assert own.filter("`__words` = 'mine' and n_words = 600").count() == 200


def test_shards_of_a_mix_follow_its_size(spark, monkeypatch):
    d = spark.createDataFrame([(k, "x" * 50, None if k % 2 else "b") for k in range(400)], "doc_id long, text string, source string")
    monkeypatch.setattr(source_mixing, "PARTITION", 1000)
    assert 15 <= source_mixing.mix(d).rdd.getNumPartitions() <= 30
    assert source_mixing.mix(d, partitions=3).rdd.getNumPartitions() == 3


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    from tests.test_oracle import rows as plain

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got, want = registry.queries()[name](spark, sf).toPandas(), c.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, sf)
    assert good.columns == docs.columns
    one = corpus_pipeline.near_duplicates(spark, good, sf)
    classes = ngram_jaccard.near_classes(good).select("class_id").distinct().count()
    assert one.count() == classes and one.columns == docs.columns
    cut = corpus_pipeline.repeated_passages(spark, one, sf)
    assert cut.count() == one.count() and cut.columns == docs.columns
    assert corpus_pipeline.run(spark, sf).filter("not round_trip").count() == 0
