"""The corpus jobs on hand-made rows, with values worked out from the rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import cleaning, ingest, retrieve, stabilize, triage, usage
from textloom.sources import files, sinks


def test_restored_paragraphs():
    assert stabilize.restored("a\n\n b \n\n\n") == ("a\n\nb", 0)
    s = "Word word word word word. "  # 25 characters
    text, splits = stabilize.restored(s * 200)
    parts = text.split("\n\n")
    # 53 sentences are 53 * 26 = 1378, the 54th of 25 ends at 1403 > 1400
    assert [len(p) for p in parts] == [53 * 26 - 1] * 3 + [41 * 26 - 1] and splits == 3 + 3
    text, splits = stabilize.restored("Intro here. " + s * 100 + "Chapter 2. " + s * 20)
    assert text.split("\n\n")[-1].startswith("Chapter 2.") and splits == 1 + 2


def test_tails(spark):
    body, text = "word " * 1000, {}
    text["publisher_tail"] = body + "ISBN 12 " + "x" * 400
    text["bibliography_tail"] = body + "References\n" + "Smith, J. 1999. doi\n" * 30
    text["trailing_toc"] = body + "Contents\n" + "Глава 1\nГлава 2\nГлава 3\n" * 20
    text["short"] = body + "ISBN 12"
    text["early"] = "ISBN " + body
    text["few references"] = body + "References\n" + "y " * 300
    d = spark.createDataFrame(list(text.items()), "k string, t string").select("k", stabilize.tail_cut(F.col("t")).alias("x"))
    got = {r["k"]: (r["x"]["removed"], r["x"]["reason"]) for r in d.collect()}
    assert got == {k: (len(t) - len(body), k) if k.endswith(("tail", "toc")) else (0, "") for k, t in text.items()}


def test_forms_and_quality(spark):
    d = spark.createDataFrame([("a.txt", "Анкета: карта? жалобы: статус"), ("b", "ocr.raw ==== " + "�" * 30 + "x" * 10_000)], "n string, t string")
    a, b = d.select(stabilize.form_score(F.col("t"), F.col("n")).alias("f"), stabilize.source_quality(F.col("t"), stabilize.paragraph_stats(F.col("t"))["large"]).alias("q")).collect()
    # four markers, one question mark, two colons in less than 1,000 characters
    assert a["f"]["score"] == round(4 * 0.12 + 0.015 + 2 * 0.02, 2) and set(a["f"]["reasons"]) == {"survey", "card", "complaints", "status"} and a["q"] == 1.0
    assert b["q"] == 0.49


def test_stabilized(spark):
    w = " ".join(f"word{k}" for k in range(60))
    rows = [(1, "x.ocr.raw.cleaned.txt", w), (2, "x.cleaned.txt", w + " more"), (3, "y.txt", w), (4, "z.txt", None), (5, "x.md", "other text here")]
    got = {r["doc_id"]: r for r in stabilize.stabilized(spark.createDataFrame(rows, "doc_id long, filename string, text string")).collect()}
    assert {k: (r["duplicate_of"], r["duplicate_status"]) for k, r in got.items()} == {1: (2, "duplicate_candidate"), 2: (None, "canonical_or_unique"), 3: (None, "canonical_or_unique"), 4: (None, "canonical_or_unique"), 5: (None, "canonical_or_unique")}
    assert got[1]["readiness_after"] == 0.75 and got[3]["readiness_after"] == 1.0 and got[4]["chars_after"] == 0


def test_blocks():
    # a heading opens a block and goes for those behind it; 1200 + 1100 > 2200
    a, b = "a" * 1200, "b" * 1100
    assert stabilize.build_blocks(f"{a}\n\n{b}\n\nГлава 1\n\n{a}\n\n{b}\n\ntail") == [(None, a), (None, b), ("Глава 1", f"Глава 1\n\n{a}"), ("Глава 1", f"{b}\n\ntail")]
    long = "\n".join(["x" * 99] * 30)
    assert [len(x) for x in stabilize.block_paragraphs(long)] == [18 * 100 - 1, 12 * 100 - 1]
    assert stabilize.block_paragraphs("  \n\n ") == [] and stabilize.build_blocks("") == []
    lines = "\n".join(["x" * 1300, "1) item", "y" * 1400])
    assert stabilize.block_paragraphs(lines) == ["x" * 1300, "1) item\n" + "y" * 1400]


def test_cleaning_job(spark):
    docs = spark.createDataFrame([(1, "HEADING ONE\n\nkeep this\n\nHEADING TWO\n\ndrop this"), (2, None), (3, "HEADING\n\ndrop " + "x" * 100)], "doc_id long, text string")

    def classify(b):
        gone = F.col("text").contains("drop")
        return b.withColumns({"label": F.when(gone, "reject_toc").otherwise("keep_theory"), "action": F.when(gone, "reject").otherwise("keep"), "confidence": F.when(gone, 0.5).otherwise(1.0)})

    reports, blocks = cleaning.cleaned(docs, classify, preserve_paragraphs=True)
    got = {r["doc_id"]: r for r in reports.collect()}
    assert (got[1]["blocks"], got[1]["kept"], got[1]["rejected"], got[1]["_cleaned_text"]) == (2, 1, 1, "HEADING ONE\n\nkeep this")
    assert got[1]["confidence"] == round((22 + 0.5 * 22) / 44, 2) and got[1]["labels_removed"] == ["reject_toc"]
    assert got[2]["warnings"] == ["empty_or_unreadable_source"] and got[3]["warnings"] == ["large_removal_ratio_review_recommended"] and got[1]["warnings"] == []
    assert sorted(r["warning"] for r in cleaning.flat_warnings(reports).collect()) == ["2: empty_or_unreadable_source", "3: large_removal_ratio_review_recommended"]
    kept, rejected = cleaning.split(blocks)
    assert kept.unionByName(rejected).exceptAll(blocks).count() == 0 and kept.count() == 1 and rejected.count() == 2
    assert "_cleaned_text" not in cleaning.public(reports).columns
    many = spark.createDataFrame([(1, k, None, "t", "reject_toc" if k % 2 else "review_unclear", "reject" if k % 2 else "keep", 0.5) for k in range(20)], "doc_id long, block_index int, heading string, text string, label string, action string, confidence double")
    assert [r["block_index"] for r in cleaning.examples(many).orderBy("block_index").collect()] == [1, 3, 5, 7, 9]


def test_written_outputs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "keep\n\nthis")], "doc_id long, text string")
    reports, blocks = cleaning.cleaned(docs, lambda b: b.withColumns({"label": F.lit("x"), "action": F.lit("reject"), "confidence": F.lit(1.0)}))
    cleaning.write_cleaned(reports, blocks, f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/rejected").count() == 1 and "_cleaned_text" not in spark.read.json(f"file://{tmp_path}/out/metadata").columns
    plan = ingest.applied(reports, f"file://{tmp_path}/plan")
    assert not (tmp_path / "plan").exists() and plan.count() == 1
    assert ingest.applied(cleaning.public(reports), f"file://{tmp_path}/plan", apply=True).count() == 1
    for rows in ([(1, "a"), (2, "b")], [(2, "b"), (3, "c")]):
        sinks.append_new(spark.createDataFrame(rows, "id long, v string"), spark, f"file://{tmp_path}/log", "id")
    assert sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/log").collect()) == [1, 2, 3]


def test_category_rows(spark):
    """Each row of the category ladder, and the hints."""
    words = {"theory": ["теор"], "test": ["тест!"], "quest": ["анкет"], "exer": ["упраж"], "bib": ["isbn"], "article": ["статья"]}
    big = 600 << 10
    rows = {
        ("a.txt", "x", True, 1): ("duplicate", 0.98), ("a.pdf", "", False, 9): ("ocr_required", 0.92), ("preprocessing_report.md", "x", False, 1): ("unclear", 0.82), ("a.txt", "#" * 2100, False, 1): ("ocr_noise", 0.79),
        ("a.txt", "isbn " * 8, False, 1): ("bibliography", 0.73), ("литература.txt", "isbn isbn", False, 1): ("bibliography", 0.67), ("книга.txt", "x", False, big): ("book_theory", 0.84), ("a.txt", "теор " * 15, False, big): ("book_theory", 0.84), ("my_test.txt", "x", False, 1): ("test", 0.86),
        ("a.txt", "анкет анкет", False, 1): ("questionnaire", round(0.66 + 2 / 30, 6)), ("a.txt", "тест! " * 4, False, 1): ("test", 0.72), ("a.txt", "упраж " * 4, False, 1): ("exercise", 0.7), ("a.pdf", "x", False, 6 << 20): ("book_theory", 0.68), ("терапия.pdf", "x", False, 400_000): ("unclear", 0.5),
        ("a.txt", "теор " * 8 + "word " * 1600, False, 1): ("good_source", 0.7), ("a.txt", "статья " + "word " * 300, False, 1): ("article", round(0.58 + 1 / 80, 6)), ("a.doc", "", False, 1): ("unclear", 0.45), ("a.txt", "x", False, 1): ("unclear", 0.5),
    }
    d = spark.createDataFrame([(k, *v) for k, v in enumerate(rows)], "k int, filename string, text string, duplicate boolean, size long")
    got = {r["k"]: (r["category"], r["confidence"]) for r in triage.triage(d, words).collect()}
    assert list(got[k] for k in range(len(rows))) == list(rows.values())
    assert {r["category"]: (r["action"], r["target"]) for r in triage.triage(d, words).collect()}["test"] == ("copy_to_specialized_bucket", "sorted_sources/tests")
    hints = {("a.txt", "тест! " * 3, 1): "test_or_questionnaire", ("a.txt", "isbn " * 5, 1): "bibliography_like", ("a.txt", "упраж " * 3, 1): "exercise_like", ("a.pdf", "x", 6 << 20): "book_like", ("книга.bin", "x", 400 << 10): "book_like", ("a.md", "x", 30 << 10): "source_doc_like", ("a.md", "x", 1): "small_source_or_unclear", ("a.bin", "x", 1): "non_source_or_unclear"}
    d = spark.createDataFrame([(k, *v) for k, v in enumerate(hints)], "k int, filename string, text string, size long")
    assert [r["h"] for r in triage.measured(d, words).select("k", triage.audit_hint().alias("h")).orderBy("k").collect()] == list(hints.values())


def test_ingestion(spark):
    labels = [(x, a) for x in ("HIGH", "MEDIUM", "LOW", "REJECT", None) for a in ("keep", "manual_review", "reject")]
    d = spark.createDataFrame(labels, "l string, a string").select("l", "a", ingest.included(F.col("l"), F.col("a")).alias("in"))
    assert {(r["l"], r["a"]) for r in d.filter("in").collect()} == {(x, a) for x in ("HIGH", "MEDIUM") for a in ("keep", "manual_review")}
    chunks = spark.createDataFrame([(1, 0, "Same text", 1), (2, 0, "same  text", 2), (3, 0, "SAME TEXT", 3), (4, 0, "there", 4), (5, 0, "new", 5)], "item_id long, chunk_index int, chunk string, seq long")
    there = spark.createDataFrame([("there",)], "t string").select(F.sha1("t").alias("hash"))
    got = {r["item_id"]: (r["duplicate_status"], r["duplicate_of"]) for r in ingest.planned_chunks(chunks, there, kb="k", session="s").collect()}
    assert got == {1: ("canonical_or_unique", None), 2: ("duplicate_candidate_session", 1), 3: ("duplicate_candidate_session", 2), 4: ("duplicate_candidate_current", None), 5: ("canonical_or_unique", None)}
    e = ingest.embedded(chunks, lambda ts: np.array([[len(t), 1.0] for t in ts]), 2, text="chunk", batch=2).collect()
    assert {r["item_id"]: list(r["embedding"]) for r in e}[4] == [5.0, 1.0]
    with pytest.raises(Exception, match="embeddings of shape"):
        ingest.embedded(chunks, lambda ts: np.zeros((len(ts), 3)), 2, text="chunk").collect()
    s = spark.createDataFrame([("a",), ("b",), ("c",)], "session_id string")
    one, two = spark.createDataFrame([("a", "ok")], "session_id string, status string"), spark.createDataFrame([("a", "bad"), ("b", "bad")], "session_id string, status string")
    assert {r["session_id"]: (r["status"], r["report"]) for r in ingest.candidate_status(s, one, two).collect()} == {"a": ("ok", 0), "b": ("bad", 1), "c": (None, None)}
    assert ingest.required_status(two, "status", "bad").count() == 2
    with pytest.raises(Exception, match="unexpected status"):
        ingest.required_status(two, "status", "ok").collect()


def test_manifests(spark):
    rows = spark.createDataFrame([(0, "a", "x", 1, 2), (1, "b", "y", 1, 2)], "vector_id long, chunk_id string, text string, source_id int, embedding_dim int")
    good = {"index_type": "faiss.IndexFlatIP", "embedding_dim": 2, "vectors": 2, "kb_id": "k"}
    check = lambda *a, **k: ingest.manifest_checks(*a, dim=2, **k).first()
    assert check(rows, good, vectors=2)["ok"]
    other = {"kb_id": "x", "summary": {"planned_chunks": 3, "planned_sources": 1}, "quality_errors": [{"severity": "Critical"}, {"severity": "low"}], "safeguards": {"wrote_only_staging": True}}
    r = check(rows, good, other, vectors=5)
    assert r["errors"] == "vector_count,kb_id,planned_chunks,critical_quality_errors" and r["warnings"] == ""
    bad = spark.createDataFrame([(0, "a", " ", 1, 3), (2, "a", "y", 1, 2)], rows.schema)
    assert check(bad, {"schema_version": 2})["errors"] == "schema_version,index_type,manifest_dim,manifest_vectors,duplicate_chunk_id,empty_chunks,row_dim,vector_id"


def test_records_lack_what_they_lack(spark):
    r = spark.createDataFrame([("c", "t", ("s", "s", [0, 1], 0, 5)), ("", None, ("s", None, None, 0, 5)), (None, "t", None)], "chunk_id string, text string, metadata struct<source_file: string, canonical_source: string, paragraph_range: array<int>, chunk_index: int, token_estimate: int>")
    got = [x["warnings"] for x in ingest.record_warnings(r).collect()]
    assert got[0] == [] and got[1] == ["missing_chunk_id", "missing_text", "metadata_missing_canonical_source", "metadata_missing_paragraph_range"] and len(got[2]) == 7


def test_numbering_of_hot_keys(spark):
    d = spark.range(1000).select(F.col("id").alias("o"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "x").alias("k"), F.lit("n.txt").alias("f"))
    got = {}
    for r in sinks.numbered(d, ["k", "f"], "o", "n", buckets=8).collect():
        got.setdefault(r["k"], []).append((r["o"], r["n"]))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values()) and set(got) == {"hot", "x", None} and sum(map(len, got.values())) == 1000


def test_numbering_goes_by_columns_of_any_type(spark):
    d = spark.createDataFrame([(f"in/{k % 90}/{k}", "t", None if k % 3 else "f") for k in range(300)], "path string, t string, f string").repartition(5)
    got = {(r["f"], r["path"]): r["n"] for r in sinks.numbered(d, ["t", "f"], "path", "n").collect()}
    for f in (None, "f"):
        assert {p: n for (g, p), n in got.items() if g == f} == {p: k + 1 for k, p in enumerate(sorted(p for g, p in got if g == f))}
    assert sinks.numbered(d.limit(0), [], "path", "n").count() == 0


def test_users_and_reports(spark):
    s = spark.createDataFrame([(1, 10, "2024-01-01", "collecting"), (1, 11, "2024-01-02", "closed"), (1, 12, "2024-01-01", "awaiting_confirmation"), (2, 13, "2024-01-01", "closed")], "user_id long, session_id long, created_at string, status string")
    assert [(r["user_id"], r["session_id"]) for r in usage.latest_sessions(s).collect()] == [(1, 12)]
    u = spark.createDataFrame([(1, "Ann Lee", None), (2, None, "+49 30"), (3, "bob", "1")], "id long, name string, phone string")
    assert [r["id"] for r in usage.find_users(u, "NN l", "name", "phone").collect()] == [1] and [r["id"] for r in usage.find_users(u, "30", "name", "phone").collect()] == [2]
    d = spark.createDataFrame([("", None, "c"), ("a", "b", "c"), (None, "", "")], "a string, b string, c string")
    assert [r[0] for r in d.select(retrieve.source_label(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["c", "a", "unknown"]
    rows = spark.range(50).withColumn("flag", F.col("id") % 3 == 0)
    assert [r["id"] for r in retrieve.first_flagged(rows, F.col("flag"), "id").collect()] == [0, 3, 6, 9, 12, 15, 18, 21]
    assert len({r["id"] for r in retrieve.sample(rows, 7).collect()}) == 7


def test_roots_and_tables(spark, tmp_path):
    for p in ("a/one.txt", "a/b/two.txt", "c/three.md", "c/cleaned/four.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    got = files.scan_roots(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/a/b", f"file://{tmp_path}/c")
    assert {(r["title"], r["root"].rsplit("/", 1)[1]) for r in got.collect()} == {("one", "a"), ("two", "a"), ("three", "c")}
    (tmp_path / "t.json").write_text('[{"id": 1, "t": "x"}, {"id": 2}]')
    assert files.articles(spark, f"file://{tmp_path}/t.json", "id long, t string").count() == 2


def test_intake_cleaning(spark):
    rows = [(1, "ﬁrst line\nPage 3 of 9\n\n\nexam-\nple ■ end\nFIRST LINE\n" + "word " * 250), (2, None), (3, "short text")]
    got = {r["doc_id"]: r for r in cleaning.intake_cleaned(spark.createDataFrame(rows, "doc_id long, text string"), {"tests": ["quiz"]}).collect()}
    assert got[1]["cleaned"].startswith("first line\n\nexample end\nword word") and (got[1]["navigation"], got[1]["repeated"]) == (1, 1)
    assert (got[1]["score"], got[1]["label"], got[1]["action"]) == (100, "HIGH", "keep")
    assert (got[2]["score"], got[2]["label"], got[2]["action"]) == (0, "REJECT", "reject") and got[3]["score"] == 38 and got[3]["action"] == "manual_review"
    assert got[3]["tokens"] == 3


def test_rules_come_from_a_table(spark):
    d = spark.createDataFrame([(1, "Abc abd 12 x|y"), (2, None), (3, "")], "k long, text string").withColumn("one", F.lit("own"))
    rules = spark.createDataFrame([("a", "ab[cd]", "ab"), ("a", "zz+", "zz"), ("b", "[0-9]{2}", ""), ("b", "[|]", None), ("b", "[|]", None)], "family string, pattern string, anchor string")
    got = {r["k"]: (r["a"], r["b"], r["one"]) for r in triage.rule_counts(d, rules, F.col("text")).collect()}
    assert got == {1: (2, 2, "own"), 2: (0, 0, "own"), 3: (0, 0, "own")}
    assert triage.rule_counts(d, rules.limit(0), F.col("text")).columns == d.columns
    with pytest.raises(ValueError, match="over 2 rules"):
        triage.rule_counts(d, rules, F.col("text"), most=2)
    assert [triage.anchor(p) for p in ("tion", "[0-9]{3}", " [|] ", "ab+c", "(?:x)", "The ", "a.bcd")] == ["tion", "", "", "ab", "", "the ", "bcd"]
