import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textloom.functions import measures as M
from textloom.functions import text as X
from textloom.operators import dedupe, lines, retrieve, segment, usage, validate
from textloom.queries import documents
from textloom.sources import sinks


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_normalisation(spark):
    t = F.col("t")
    assert one(spark, "a\r\nb  c\n\n\n\n\nd ", X.clean_spaces(t)) == "a\nb c\n\n\nd"
    assert one(spark, "exam-\nple and\nmore. Next\nLine", X.mend_lines(t)) == "example and more. Next\nLine"
    assert one(spark, "a\n\nb  c", X.clean_artifacts(t)) == "a b c"
    assert one(spark, "a\n\nb  c", X.clean_artifacts(t, preserve_paragraphs=True)) == "a\n\nb c"
    assert one(spark, "ТЕСТ, Ёж!", X.letter_key(t)) == "тест ёж"
    assert one(spark, "ﬁne", X.nfkc(t)) == "fine"
    assert one(spark, "стр. 12", X.is_page_marker(t)) and one(spark, "=== page 3 / 9 ===", X.is_page_marker(t))
    names = {"a.ocr.raw.cleaned.txt": "a", "a.b.ocr.cleaned.cleaned.txt": "a.b", "a.cleaned.txt": "a", "a.cleaned.cleaned.txt": "a", "a.b.txt": "a.b", "a": "a", ".txt": ".txt"}
    assert {k: one(spark, k, X.base_key(t)) for k in names} == names
    cuts = {"short": "short", "One two. three four five": "One two.", "abcdefghi jklmnop qrst": "abcdefghi.", "x" * 30: "x" * 15 + ".", "A. bcdefgh ijklmnopqrst": "A. bcdefgh."}
    assert {k: one(spark, k, X.cut_at_word(t, 15)) for k in cuts} == cuts
    assert one(spark, "", X.file_name(t)) == "file"


def test_lines_keep_their_paragraphs(spark):
    rows = {
        1: ("\n\n First \n\n\nsecond\r\n  \nFIRST\n\nthird\n\n", "\nFirst\n\nsecond\n\nthird\n", 0, 1, 8),
        2: ("Page 3 of 9\n\nbody\n12\n\nbody  \nwww.example.org", "\nbody\n", 3, 1, 2),
        3: ("", "", 0, 0, 1),
        4: ("a\nA\na b\nA  B", "a\na b", 0, 2, 0),
    }
    d = spark.createDataFrame([(k, v[0]) for k, v in rows.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["cleaned"], r["navigation"], r["repeated"], r["empty"]) for r in lines.clean_lines(d).collect()}
    assert got == {k: v[1:] for k, v in rows.items()}
    d = spark.createDataFrame([(1, "Head line\nx\nHead line\nHead line\ny\n Head line \nword\nword\nword\nword\nEnd it.\nEnd it.\nEnd it.\nEnd it."), (2, "Head line"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["removed_lines"]) for r in lines.without_repeated_lines(d).collect()}
    assert got == {1: ("x\ny\nword\nword\nword\nword\nEnd it.\nEnd it.\nEnd it.\nEnd it.", ["Head line"]), 2: ("Head line", []), 3: ("", [])}


def test_cleaner_scores(spark):
    t = F.col("t")
    score = lambda text: one(spark, text, M.cleaner_score(t, M.cleaner_signals(t, {"tests": ["quiz"]})))
    assert score("") == 0 and score(" \n ") == 0
    assert score("word " * 300) == 100 and score("word " * 100) == 85 and score("word " * 50) == 38 and score("quiz " * 300) == 88
    assert score("1234 " * 300) == 65
    signals = lambda text: one(spark, text, M.cleaner_signals(t, {}))
    assert "corrupted_ocr_or_mojibake" in signals("Рђж " * 120) and "corrupted_ocr_or_mojibake" not in signals("Рaж " * 10 + "latin " * 100)
    assert "repeated_patterns" in signals("word " * 80 + "______ " * 4) and "repeated_patterns" not in signals("word " * 80 + "!!!!!! " * 4)
    assert "repeated_lines" in signals("\n" * 7 + "word " * 80) and "low_semantic_density" not in signals("")
    assert [one(spark, x, M.cleaner_action(t)) for x in ("HIGH", "MEDIUM", "LOW", "REJECT")] == ["keep", "manual_review", "manual_review", "reject"]


def test_boundaries(spark):
    t = F.col("t")
    for n, score in ((299, 0.38), (300, 0.75), (999, 0.75), (1000, 1.0)):
        assert one(spark, "ab " * (n // 3) + "c" * (n % 3), M.intake_score(F.length(t), M.intake_signals(t))) == score
    assert one(spark, "", M.intake_signals(t)) == ["empty_text"]
    assert one(spark, "Глава 3", M.is_heading(t)) and one(spark, "Глава 3", M.paragraph_label(t)) == "heading"
    assert one(spark, "привет " * 10, M.script_language(t)) == "ru"


def test_context_modes(spark):
    r = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 3)], "query_id long, rank int, text string")
    assert retrieve.context(r, 5, first_always=True).first()["context"] == "x" * 10
    assert retrieve.context(r, 5, first_always=False, separator=2).count() == 0


def test_quota_and_expiry_edges(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    e = spark.createDataFrame([(k, 1, at(1), "video") for k in range(2)] + [(5, 1, at(8), "text"), (6, 1, at(8, 1), "text"), (7, 1, at(2), "free")], "event_id long, user_id long, ts timestamp, k string")
    got = {r["event_id"]: r["verdict"] for r in usage.gate(e, F.col("k")).collect()}
    assert got == {0: "allowed", 1: "quota", 5: "allowed", 6: "expired", 7: "allowed"}


def test_validation_and_ids(spark):
    v = spark.createDataFrame([(0, "a", [1.0, 2.0]), (2, "a", [1.0])], "vec_id long, chunk_id string, v array<double>")
    r = validate.index_checks(v, vec_id="vec_id", chunk_id="chunk_id", vector="v", dim=2).first()
    assert r["errors"] == "wrong_dimension,duplicate_chunk_id,vector_ids_not_sequential" and not r["ok"]
    assert validate.checked_dimension(v, "v", 2).count() == 1
    ids = sinks.dense_ids(spark.range(5, 205, 2).withColumnRenamed("id", "k"), "k").orderBy("k").collect()
    assert [r["vector_id"] for r in ids] == list(range(100))
    p = spark.createDataFrame([(1, "t", "a.txt"), (2, "t", "a.txt")], "id long, target string, name string")
    assert [r["target_name"] for r in sinks.copy_plan(p, "target", "name", "id").orderBy("id").collect()] == ["a.txt", "a__1.txt"]


def test_searches_go_through_blocks_of_queries(spark, monkeypatch):
    v = spark.createDataFrame([(k, [float((k * j) % 7 - 3) for j in (1, 2, 3)] if k % 7 else [1.0, 0.0, 0.5]) for k in range(30)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 11").withColumnRenamed("vec_id", "query_id")
    a = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k % 5, 9))) for k in range(20)], "article_id long, text string")
    words = spark.createDataFrame([(k, f"w{k % 6} w{k % 4} none") for k in range(11)], "query_id long, query string")
    both = lambda: (sorted(map(tuple, retrieve.top_k(q, v, 4).collect())), sorted(map(tuple, retrieve.lexical(words, a).collect())))
    whole = both()
    monkeypatch.setattr(retrieve, "QUERIES", 3)
    assert both() == whole and len(whole[0]) == 44 and len(whole[1]) == 33


def test_packed_chunk_names_the_copy_before_it(spark, monkeypatch, sf):
    ids = [3, 999, 1000, 1001, 2500, 7000]
    t = spark.createDataFrame([(k, 0, "Same  chunk" if k % 2 else "same chunk", 1) for k in ids] + [(4, 0, "another", 1)], "doc_id long, chunk_index int, chunk string, parts int")
    monkeypatch.setattr(segment, "token_chunks", lambda *a, **b: t)
    got = {r["doc_id"]: (r["duplicate_of"], r["n_same"]) for r in documents.chunk_token_packed(spark, sf).collect()}
    assert got == {4: (-1, 1)} | {k: (before * 100_000 if before else -1, 6) for before, k in zip([None, *ids], ids)}
    n = spark.createDataFrame([(None, "a"), (5, "a"), (6, "a")], "seq long, k string")
    assert sorted(((r["seq"] or 0), r["duplicate_of"], r["n_same"]) for r in dedupe.previous_duplicates(n, F.col("k"), "seq", 2).collect()) == [(0, None, 3), (5, None, 3), (6, 5, 3)]


@pytest.mark.parametrize("crowd", [32, 2])
def test_near_classes_are_brute_force(spark, crowd):
    import random

    rng = random.Random(6)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(rng.choice([3, 5, 30, 90]))) for _ in range(30)]
    texts = ["", None, "  ", *base, *base[:6]]
    for t in base[:20]:
        w = t.split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "new"
        texts += [" ".join(w), "head " + t, t.upper() + " tail"]
    long = [f"w{k}" for k in range(200)]
    texts += [" ".join([*long[:at], f"x{at}", *long[at + 1 :]]) for at in range(0, 200, 5)]  # a clique
    sets = {k: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for k, t in enumerate(texts) if (w := (t or "").lower().split())}
    linked = {k: [j for j in sets if j != k and len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j])] for k in sets}
    low = {k: k for k in sets}
    while any(low[j] < low[k] for k in sets for j in linked[k]):
        low = {k: min([low[k], *(low[j] for j in linked[k])]) for k in sets}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("node", F.lit(1))
    got = sorted(map(tuple, dedupe.near_classes(docs, crowd=crowd).collect()))
    assert got == sorted((k, low[k], len(linked[k])) for k in sets)
    assert dedupe.near_classes(docs.limit(0)).count() == 0


def shuffled(spark, job):
    """Bytes that the stages of job() write to shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def stages():
        found = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in map(found.apply, range(found.size()))}

    before = stages()
    job()
    return sum(size for at, size in stages().items() if at not in before)


def test_near_classes_leave_texts_like_none_out_early(spark):
    n, words = 400, 500
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr(f"array_join(transform(sequence(1, {words}), x -> concat('w', id, '_', x)), ' ')").alias("text"))
    size = shuffled(spark, lambda: dedupe.near_classes(docs).collect())
    assert size < n * words * 8  # all shingles once; they went through shuffles several times


@pytest.mark.parametrize("threshold", [0.25, 0.5, 0.8, 1.0])
def test_near_classes_at_the_very_threshold(spark, threshold):
    texts, want = [], []
    for k in range(1, 61):  # the shorter one has all its shingles in the longer one, the shares are just enough and just too few
        for short in {math.ceil(threshold * 5 * k - 1e-9), math.ceil(threshold * 5 * k - 1e-9) - 1} - {0}:
            at = len(texts)
            word = [f"t{at}_{j}" for j in range(5 * k + 4)]
            texts += [" ".join(word), " ".join(word[: short + 4]), " ".join(word)]
            linked = short >= threshold * 5 * k - 1e-9
            want += [(at, at, 2 if linked else 1), (at + 1, at if linked else at + 1, 2 if linked else 0), (at + 2, at, 2 if linked else 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, dedupe.near_classes(docs, threshold=threshold).collect())) == want


def test_canonical_choice(spark):
    d = spark.createDataFrame([(1, "a", 0.5, False, 10), (2, "a", 0.9, True, 10), (3, "a", 0.9, False, 10), (4, "a", 0.9, False, 20), (5, "b", 0.1, True, 1)], "doc_id long, base string, q double, raw boolean, n long")
    got = dedupe.canonical(d, "base", -F.col("q"), F.col("raw"), -F.col("n"), F.col("doc_id")).filter("canonical").collect()
    assert {r["doc_id"] for r in got} == {4, 5}


def test_search_edges(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, [float("nan"), 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"]) for r in retrieve.top_k(q, v, 3).orderBy("rank").collect()] == [(1, 1), (3, 2), (2, 3)]
    assert [r["vec_id"] for r in retrieve.top_k(q, v, 3, floor=0.05).orderBy("rank").collect()] == [1, 3]
    assert retrieve.top_k(q.limit(0), v, 3).count() == 0 and retrieve.top_k(q, v.limit(0), 3).count() == 0
    a = spark.createDataFrame([(1, "Abc abd"), (2, None), (3, "")], "article_id long, text string").fillna("")
    words = spark.createDataFrame([(7, "ab  bc ab"), (8, "zz")], "query_id long, query string")
    assert sorted(map(tuple, retrieve.lexical(words, a).select("query_id", "article_id", "hits").collect())) == [(7, 1, 4), (7, 2, 1), (7, 3, 1)]


def test_indexed_search_is_a_full_search(spark):
    import numpy as np

    from textloom.operators import vector_index

    rng = np.random.default_rng(5)
    middle = rng.normal(size=(12, 8))
    rows = [(k, (middle[k % 12] * 3 + rng.normal(size=8) * 0.2).tolist()) for k in range(600)]
    rows += [(600 + k, rows[k][1]) for k in range(5)] + [(700, [0.0] * 8), (701, [float("nan")] * 8), (702, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found, pairs = vector_index.top_k_indexed(q, v, 4, centers=12)
    whole = np.array([x for _, x in rows[:606]])
    u = whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-300)
    ids = np.array([k for k, _ in rows[:606]])
    for query, x in [(k, x) for k, x in rows if k % 50 == 0]:
        own = np.array(x)
        score = np.round(u @ (own / max(np.linalg.norm(own), 1e-300)), 9)
        want = [int(ids[i]) for i in np.lexsort((ids, -score))[:4]]
        assert [r["vec_id"] for r in found.filter(F.col("query_id") == query).orderBy("rank").collect()] == want
    assert pairs < 0.5 * q.count() * len(rows)
    assert vector_index.top_k_indexed(q, v.limit(0), 4)[0].count() == vector_index.top_k_indexed(q.limit(0), v, 4)[0].count() == 0


def test_costly_expressions_stand_once(spark):
    """Searches over whole texts are written down once, so that no plan works them out again for each use."""
    from textloom.operators import stabilize

    t = F.col("t")
    d = spark.createDataFrame([("a b",)], "t string")
    plan = lambda c: d.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(stabilize.tail_cut(t)).count("regexp_instr") + plan(stabilize.tail_cut(t)).count("regexpinstr") == 3
    assert plan(stabilize.paragraph_stats(t)).count("split(") == 1
    assert plan(M.line_shares(t, M.NUMBERED, M.CONTENTS, M.REFERENCE)).count("split(") == 1
    windows = segment.word_windows(d.select(X.clean_spaces(t).alias("text")))
    assert windows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_counted_characters(spark):
    from textloom.functions.text import count_chars

    texts = ["", "aZ яЁ 1é", "\U0001d41a\U0001f600b \t\n٣3", "Жж" * 50, None]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    for chars in (M.LETTERS, M.CYRILLIC, M.LATIN, r"\s", r"\d", r"\p{L}"):
        assert d.filter(~count_chars(F.col("t"), chars).eqNullSafe(F.regexp_count("t", F.lit(f"[{chars}]")))).count() == 0


def test_lines_are_searched_before_they_are_matched(spark):
    """The plain search in front of a pattern loses no line, and noise counts the runs that its pattern has."""
    texts = ["Intro text ..... 12", "abc  .. 3", "a. . 4", "(1999) Some book, with a long title", "no year, but a long title here", "in 2004. And what follows is long", "x 1 9 99. and what follows"]
    d = spark.createDataFrame([(x,) for x in texts], "t string")
    for p in (M.NUMBERED, M.CONTENTS, M.REFERENCE):
        assert d.filter((M.line_share(F.col("t"), p) > 0) != F.col("t").rlike(p)).count() == 0
    assert "contains" in str(M.line_shares(F.col("t"), M.CONTENTS)).lower()
    odd = "ab ==== c  @@ d **** \n@@@@@@ e=== [[[]]]"
    got = one(spark, odd, M.block_noise(F.col("t")))
    n, letters, runs = len(odd), sum(c.isalpha() for c in odd), 5
    assert got == pytest.approx(min(1.0, (1 - letters / n) * 0.65 + runs * 0.03))
