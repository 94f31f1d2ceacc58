import io
import zipfile

import pytest
from pyspark.sql import functions as F

from textloom.sources import files, sinks
from textloom.streaming import streams


def docx(*paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "in" / ".git").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_bytes(b"ok \xff")
    (tmp_path / "in/b.docx").write_bytes(docx("one", "two"))
    (tmp_path / "in/c.docx").write_bytes(b"broken")
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/e.exe").write_bytes(b"no")
    (tmp_path / "in/.git/f.txt").write_bytes(b"no")
    got = {r["title"]: (r["text"], r["warning"]) for r in files.texts(files.files(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a": ("ok �", None), "b": ("one\n\ntwo", None), "c": ("", "docx: BadZipFile"), "d": ("", "ocr_required")}


def test_publish_and_roll_back(spark, tmp_path):
    root = str(tmp_path / "index")
    sinks.publish(spark.range(3), root, "v1")
    sinks.publish(spark.range(5), root, "v2")
    assert sinks.current(spark, root).count() == 5
    sinks.point(spark, root, "v1")
    assert sinks.current(spark, root).count() == 3
    assert sinks.roll_back(spark, root) == "v2" and sinks.current(spark, root).count() == 5
    history = [(r["version"], r["backup"]) for r in sinks.pointers(spark, root).orderBy("at").collect()]
    assert history == [("v1", None), ("v2", "v1"), ("v1", "v2"), ("v2", "v1")]
    bad = spark.createDataFrame([(False, "empty_text")], "ok boolean, errors string")
    with pytest.raises(ValueError, match="empty_text"):
        sinks.publish(spark.range(1), root, "v3", checks=bad)
    assert sinks.current(spark, root).count() == 5
    with pytest.raises(ValueError, match="no version"):
        sinks.roll_back(spark, f"{root}-none")


def test_append_new_skips_known(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_new(spark.range(3), spark, path, "id")
    sinks.append_new(spark.range(5), spark, path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_streams(spark, sf, tmp_path):
    src = str(tmp_path / "src")
    spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id"), F.col("user_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = streams.counters(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("update").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counted").first()[0] == spark.read.parquet(src).count()
