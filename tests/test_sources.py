"""Sources, sinks, guards and streams on small files."""

import hashlib
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import dedupe, retrieve, usage, validate
from textloom.queries import retrieval
from textloom.sources import files, pages, sinks
from textloom.streaming import streams


def test_json_sources(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"id": 1, "t": "a"}\nbroken\n{"id": 2, "t": "b"}\n')
    path = f"file://{tmp_path}/rows.jsonl"
    assert sorted(r["id"] for r in files.json_lines(spark, path, "id long, t string", strict=False).collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.json_lines(spark, path, "id long, t string").collect()
    for k, status in enumerate(["open", "closed", "open"]):
        (tmp_path / f"s{k}.json").write_text(f'{{\n "session_id": "{k}",\n "status": "{status}"}}')
    assert sorted(r["session_id"] for r in files.sessions(spark, f"file://{tmp_path}/s*.json", "open", "session_id string, status string").collect()) == ["0", "2"]
    side = spark.createDataFrame([("a", '{"k": "v"}'), ("b", "nope"), ("c", None)], "title string, text string")
    docs = spark.createDataFrame([("a",), ("b",), ("x",)], "title string")
    assert {r["title"]: r["metadata"] for r in files.with_sidecar(docs, files.sidecars(side), "title").collect()} == {"a": {"k": "v"}, "b": {}, "x": {}}
    d = spark.createDataFrame([("a", "old", 1), ("a", "new", 2), ("b", "x", 1)], "id string, t string, row int")
    assert {r["id"]: r["t"] for r in files.last_texts(d, "id", "t", "row").collect()} == {"a": "new", "b": "x"}


def test_newest_csv(spark, tmp_path):
    import os

    for k, name in enumerate(("one", "two")):
        (tmp_path / f"{name}.csv").write_text(f"﻿a,b\n{name},{k}\n", encoding="utf-8")
        os.utime(tmp_path / f"{name}.csv", (1_700_000_000 + k, 1_700_000_000 + k))
    got = files.newest_csv(spark, f"file://{tmp_path}/two.csv", f"file://{tmp_path}/one.csv")
    assert [tuple(r) for r in got.collect()] == [("two", "1")] and got.columns == ["a", "b"]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, [1, 2], {"x": 1}), ("b", 2, [], {"x": 2}), ("b", 3, None, None)], "source string, n int, xs array<int>, s struct<x: int>")
    sinks.write_json_by(d, f"file://{tmp_path}/j", "source")
    assert (tmp_path / "j/source=b").exists() and spark.read.json(f"file://{tmp_path}/j").count() == 3
    sinks.write_report(d, f"file://{tmp_path}/r", ["n", "xs"])
    assert sorted(map(tuple, spark.read.option("header", True).csv(f"file://{tmp_path}/r").collect())) == [("1", "[1,2]"), ("2", "[]"), ("3", None)]
    sinks.write_summary(d.agg(F.sum("n").alias("n")), f"file://{tmp_path}/s")
    assert spark.read.json(f"file://{tmp_path}/s").first()["n"] == 6
    report = [r["value"] for r in sinks.markdown(d, "source", ["n"], "All", d.agg(F.count("*").alias("rows"))).collect()]
    assert report[0] == "# All\n- rows: 3\n" and report[1] == "## a\n- n: 1\n" and len(report) == 4
    path = f"file://{tmp_path}/p"
    sinks.replace_partitions(d.select("source", "n"), path, "source")
    sinks.replace_partitions(spark.createDataFrame([("b", 9)], "source string, n int"), path, "source")
    assert sorted((r["source"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 9)]
    new = sinks.put_fields(d, spark.createDataFrame([("a", 7)], "source string, x int"), "source", "s", "x")
    assert {(r["source"], r["s"]["x"] if r["s"] else None) for r in new.collect()} == {("a", 7), ("b", 2), ("b", None)}
    users = spark.createDataFrame([(1, datetime(2024, 1, 5)), (2, None), (3, datetime(2024, 1, 1))], "id long, expires_at timestamp")
    out = sinks.extend_expiry(users, spark.createDataFrame([(1,), (2,), (1,)], "id long"), "id", F.expr("TIMESTAMP '2024-01-02 00:00:00'"))
    assert {r["id"]: r["expires_at"] for r in out.collect()} == {1: datetime(2024, 1, 8), 2: datetime(2024, 1, 5), 3: datetime(2024, 1, 1)}


def test_guards(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, v array<double>")
    assert [r["id"] for r in validate.checked_dimension(v, "v", 2).collect()] == [1]
    with pytest.raises(Exception, match="another dimension"):
        validate.checked_dimension(v, "v", 2, strict=True).collect()
    assert validate.guarded("/kb/staging/x", "/kb/current") == "/kb/staging/x" and validate.guarded("/kb/current2", "/kb/current") == "/kb/current2"
    for path in ("/kb/current", "/kb/current/x"):
        with pytest.raises(ValueError, match="production"):
            validate.guarded(path, "/kb/current")
    a, b = spark.range(10).select(F.col("id").cast("string").alias("c")), spark.range(9, -1, -1).select(F.col("id").cast("string").alias("c"))
    assert validate.content_hash(a, "c").first() == validate.content_hash(b, "c").first() != validate.content_hash(a.limit(9), "c").first()
    ids = [f"c{k}" for k in range(50)]
    sha = lambda xs: hashlib.sha1("\n".join(xs).encode()).hexdigest()
    level = sorted(ids)
    while len(level) > 1:
        level = [sha(level[k : k + 4]) for k in range(0, len(level), 4)]
    d = spark.createDataFrame([(x,) for x in ids], "c string")
    for parts in (1, 7):
        assert tuple(validate.content_hash(d.repartition(parts), "c", 4).first()) == (level[0], 50)
    assert tuple(validate.content_hash(d, "c").first()) == (sha(sorted(ids)), 50) and tuple(validate.content_hash(d.limit(0), "c").first()) == (sha([]), 0)


def test_small_functions(spark):
    d = spark.createDataFrame([("a■b\x01c﻿d",)], "t string")
    assert d.select(X.strip_junk(F.col("t"))).first()[0] == "a b cd"
    assert [r[0] for r in spark.createDataFrame([(' a: "b"/c?',), ("x" * 200,)], "t string").select(X.file_name(F.col("t"))).collect()] == [" a_ _b__c_", "x" * 120]
    assert [r[0] for r in spark.createDataFrame([("https://x.org/a",), ("see https://x.org",), (" http://y ",)], "t string").select(X.is_url(F.col("t"))).collect()] == [True, False, True]
    html = '<h1>T</h1><div class="big content x"><p>one</p></div><p>no</p><article><b>two</b></article><div class="contents">no</div>'
    r = spark.createDataFrame([(html,)], "h string").select(pages.main_text(F.col("h")).alias("m"), pages.description(F.col("h")).alias("d")).first()
    assert r["m"] == "one two" and r["d"] == "one"
    nested = '<div class="text">a<div>b<br/><div class=\'content\'>c</div>d</div>e<script>var t="</div>";</script><!-- </div> --></div>f<section class="other text"><p>g<p>h</section><article>i</p>j'
    assert [" ".join(x.split()) for x in pages.container_texts(nested)] == ["a b c d e", "c", "g h", "i j"]
    assert pages.container_texts("") == pages.container_texts("x < y <b>z") == [] and pages.container_texts('<article>1 < 2<img src="a>b">3') == ["1 < 2 3"]
    k = spark.createDataFrame([(1, "x" * 1200 + "a"), (2, "X" * 1200 + " b"), (3, "y")], "doc_id long, text string")
    assert {r["doc_id"]: r["duplicate_of"] for r in dedupe.exact_duplicates(k, dedupe.opening(F.col("text"))).collect()} == {1: None, 2: 1, 3: None}
    assert dedupe.only_new(k, k, "doc_id").count() == 0 and dedupe.only_new(k, k, "doc_id", force=True).count() == 3
    h = spark.createDataFrame([(1, 1, "a", "t"), (1, 2, "a", "u"), (1, 3, "", "T "), (1, 4, None, "t"), (1, 5, None, " "), (2, 1, None, "t")], "query_id long, rank int, chunk_id string, text string")
    assert sorted((r["query_id"], r["rank"]) for r in retrieve.dedupe_results(h, "chunk_id", "text").collect()) == [(1, 1), (1, 3), (2, 1)]


def test_roles_and_warnings(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    users = spark.createDataFrame([(1, None), (2, "full_access"), (3, "demo")], "user_id long, role string")
    got = usage.access_role(users, spark.createDataFrame([(3,)], "user_id long")).withColumn("may", usage.may_ingest(F.col("role")))
    assert {r["user_id"]: (r["role"], r["may"]) for r in got.collect()} == {1: ("demo", False), 2: ("full_access", True), 3: ("admin", True)}
    e = spark.createDataFrame([(k, 1 + k % 2, at(1 + k), "video", "admin" if k % 2 else None) for k in range(10)], "event_id long, user_id long, ts timestamp, kind string, role string")
    assert {r["user_id"]: r["n"] for r in usage.gate(e, F.col("kind"), role=F.col("role")).filter("verdict = 'allowed'").groupBy("user_id").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 5}
    s = usage.lead_stats(e, F.expr("TIMESTAMP '2024-01-09 00:00:00'"), users=spark.createDataFrame([(1,), (2,), (3,)], "user_id long")).first()
    assert (s["users"], s["uses"], s["active"], s["expired"], s["not_activated"]) == (3, 10, 1, 1, 1)
    u = spark.createDataFrame([(1, at(2, 1), False), (2, at(2, 1), True), (3, at(2, 2), None), (4, at(1), False), (5, None, False)], "user_id long, expires_at timestamp, expiry_warned boolean")
    now = F.expr("TIMESTAMP '2024-01-01 00:00:00'")
    first = usage.warn_once(u, now)
    assert {r["user_id"]: (r["warn"], r["expiry_warned"]) for r in first.collect()} == {1: (True, True), 2: (False, True), 3: (False, False), 4: (False, False), 5: (False, False)}
    assert usage.warn_once(first.drop("warn"), now).filter("warn").count() == 0


def test_digest_stream(spark, tmp_path):
    events = spark.createDataFrame([(k, k % 3, datetime(2024, 1, 1 + k // 4, k % 4)) for k in range(12)], "event_id long, user_id long, ts timestamp")
    events.write.parquet(f"file://{tmp_path}/e")
    q = streams.digest(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["day"]["start"].day, r["n"], r["users"]) for r in spark.table("days").collect()) == [(1, 4, 3), (2, 4, 3), (3, 4, 3)]

def test_beginnings_read_few_bytes_and_no_protected_folder(spark, tmp_path):
    from textloom.sources import bounded

    for k in range(6):
        (tmp_path / f"in/{k}/deep").mkdir(parents=True)
        (tmp_path / f"in/{k}/deep/a{k}.txt").write_text("é" * 5000)
    for name in (".git", "0/node_modules/x", "3/deep/cleaned"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "hidden.txt").write_text("no")
    (tmp_path / "in/top.MD").write_bytes(b"ok \xff")
    (tmp_path / "in/none.exe").write_bytes(b"no")
    (tmp_path / "in/empty.csv").write_bytes(b"")
    root = f"file://{tmp_path}/in"
    for folders in ("1", "1000"):
        got = {r["title"]: r for r in bounded.beginnings(spark, root, 100, folders=folders).collect()}
        assert set(got) == {"top", "empty", *(f"a{k}" for k in range(6))}
        assert sum(len(r["content"]) for r in got.values()) == 6 * 100 + 4 and got["a1"]["length"] == 10_000
    reader = bounded.BeginningsReader({"path": root, "folders": "1"})
    assert len(reader.partitions()) == 7 and not any(".git" in (p.folder or "") for p in reader.partitions())
    texts = {r["title"]: (r["text"], r["ext"]) for r in bounded.bounded_texts(spark, root, 10).collect()}
    assert texts["a2"] == ("é" * 10, "txt") and texts["top"] == ("ok �", "md") and texts["empty"] == ("", "csv")
    (tmp_path / "bare").mkdir()
    assert bounded.beginnings(spark, f"file://{tmp_path}/bare").count() == 0


def test_index_content_hash_of_many_runs(spark, tmp_path):
    """Over leaf * leaf ids the hash is still that of the SQL, which knows two levels."""
    spark.range(20_050).selectExpr("id AS vec_id").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    got = retrieval.index_content_hash(spark, f"file://{tmp_path}").first()
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert (got["hash"], got["rows"]) == duck.execute(retrieval.INDEX_CONTENT_HASH).fetchone()
