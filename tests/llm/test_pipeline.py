"""The pipeline's stages against brute force, on rows with nulls, empty texts, repeated rows and repeated ids."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import MODEL, SCHEMA, words
from textloom.llm import ngram_jaccard, quality_gam, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = [words(rng, rng.choice([5, 60, 200])) for _ in range(14)]
    near = " ".join(["new", *base[3].split()[1:]])
    passage = words(rng, 60)
    texts = [None, "", " ", *base, near, base[4], f"{words(rng, 20)} � {passage} � end", f"{words(rng, 9)}é{passage}é{words(rng, 9)}", "é" * 500]
    out = [(k, t, "en", f"s{k % 2}" if k % 5 else None, len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[5], (6, words(rng, 30), "de", "s0", 1), (7, base[4] + " more", "de", "s1", 1), (None, base[5], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", node string").repartition(3)


def plain(df, columns=SCHEMA):
    return Counter(tuple(r[c.split()[0]] for c in columns.split(", ")) for r in df.collect())


def test_quality_keeps_what_is_scored_high(spark, sf, docs, rows):
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns
    model = quality_gam.train_on_labels(spark, docs, sf)
    want = Counter(r for r in rows if model.score(quality_gam.features(r[1])[None])[0] >= 0.3)
    assert plain(kept) == want


def test_near_duplicates_leave_one_of_a_group(spark, sf, docs, rows):
    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    every = list(dict.fromkeys(rows))
    sets = [shingles(r[1]) for r in every]
    group = list(range(len(every)))
    for i in range(len(every)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    got = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert got.columns == docs.columns
    found = plain(got)
    assert max(found.values()) == 1 and len(found) == len(set(group))
    for g in set(group):
        own = [r for r, x in zip(every, group) if x == g]
        ids = [r[0] for r in own if r[0] is not None]
        kept = [r for r in own if r in found]
        assert len(kept) == 1 and (None in (r[0] for r in own) or kept[0][0] == min(ids))


def test_passages_go_and_marks_stay(spark, sf, docs, rows):
    got = corpus_pipeline.repeated_passages(spark, docs, sf)
    assert got.columns == docs.columns
    raws = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(t[i : i + 200] for t in raws for i in range(len(t) - 199))
    want = Counter()
    for r, raw in zip(rows, raws):
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        parts, own = [], bytearray()
        for x, g in zip([*raw, 0], gone):
            if g or x == 0:
                parts.append(bytes(own).decode("utf-8", "ignore"))
                own = bytearray()
            else:
                own.append(x)
        text = "".join(parts)
        want[r[0], text, r[2], r[3], len(text)] += 1
    assert plain(got) == want and any("�" in (k[1] or "") for k in want) and any(k[1] == "" and k[0] == 21 for k in want)


def test_mix_draws_poisson_copies(spark, sf, docs, rows):
    got = corpus_pipeline.source_mix(spark, docs, sf)
    assert got.columns == docs.columns
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1] or "")
    weight = {k: math.sqrt(v) for k, v in size.items()}
    want = Counter()
    for r in rows:
        rate = weight[r[3]] / sum(weight.values()) * sum(size.values()) / size[r[3]]
        u = int(hashlib.md5(f"42:{'' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p, total = 0, math.exp(-rate), 0.0
        while total + p <= u:
            total += p
            n += 1
            p *= rate / n
        want[r] += n
    assert plain(got) == +want


def test_pieces_are_the_librarys(spark, sf, docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = corpus_pipeline.pieces(spark, docs, sf)
    want = Counter((r[0], len(ids := sp.encode(r[1] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), True) for r in rows)
    assert plain(got, "doc_id, n_tokens, ids_sha256, round_trip") == want


def test_empty_table(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, sf)
        assert out.count() == 0


def test_planted_pairs_are_met(spark):
    """At full depth, pairs at the threshold meet in a leaf as often as the runs are for."""
    rng = random.Random(2)
    texts, pairs = [], []
    for k in range(600):
        w = [f"w{rng.randrange(10**9)}" for _ in range(454)]  # 450 shingles
        other = list(w)
        for i in range(10):  # ten changed words cost fifty shingles: 400 of 500 in common
            other[20 + 44 * i] = f"v{rng.randrange(10**9)}"
        texts += [" ".join(w), " ".join(other)]
        a, b = (ngram_jaccard.shingles(t, ngram_jaccard.Words()) for t in texts[-2:])
        assert len(np.intersect1d(a, b)) / len(np.union1d(a, b)) == 0.8
        pairs.append((ngram_jaccard.node_of(a), ngram_jaccard.node_of(b)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, nodes = ngram_jaccard.nodes_of(docs, "doc_id", "text")
    leaves = ngram_jaccard.leaves_of(nodes, ngram_jaccard.runs_for(ngram_jaccard.RECALL), ngram_jaccard.THRESHOLD, leaf=0, alike=2.0)
    by = {}
    for r in leaves.select("leaf", "node").distinct().collect():
        by.setdefault(r["node"], set()).add(r["leaf"])
    met = sum(bool(by.get(a, set()) & by.get(b, set())) for a, b in pairs)
    assert met >= 0.99 * len(pairs)
    got = {r["doc_id"]: r["class_id"] for r in ngram_jaccard.near_classes(docs).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(600)) >= 0.99 * 600
