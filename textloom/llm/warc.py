"""WARC archives: writing pages as transactions, and assembling transactions from archives.

``write_warc`` gives each page a request, a response (or a revisit of an equal payload) and a metadata record, all
in one file, one gzip member a record; request and metadata name the response in WARC-Concurrent-To. Files have at
most ``file_bytes`` of uncompressed records plus one transaction, since a reader's task takes a file at a time; a
name holds the task's number, and a file appears under it only when it is whole, so a task that runs again
overwrites its own files with the same bytes.

``read_records`` reads archives, gzipped or not, with Spark's binary reader and splits them into records;
``captures`` brings request, response and metadata records together through the concurrent-to identifiers, each of
which a record may have several of, to one nested row for each capture. Archives are read once: the records meet in one
shuffle by the response's identifier, and only the columns asked for take part. A revisit gets the
length and the digest of its payload from the response that it refers to.

Defined cases: a null id counts as the smallest, so it is the response of equal payloads, and what refers to it has a null
refers_to; of several requests or metadata records of one response the one with the smallest identifier is in the
row, which has their numbers; header names have any case; a record without Content-Length reaches to the end of its
gzip member or file; a record without a type or an identifier is in no capture; a null or empty payload is a response or revisit like others, of 0 bytes; equal rows are told apart by
their place among those with the same id and payload; a null url is written as an empty one; a null id is written
as no id and read as null; an empty table gives no file and an empty result; columns beyond id, url and html are
not read. Records of other types, and requests or metadata without a response, are left out of captures.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import shared_dir, table, text_or_empty, with_keyed, written

FILE_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, http string, payload binary, payload_bytes long, payload_digest string, fields string"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(kind: str, page: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{kind}:{page}'.encode()).digest()[:16])}>"


def record(kind: str, page: str, uri: str, content_type: str, body: bytes, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id("response" if kind == "revisit" else kind, page), "WARC-Date": DATE, "WARC-Target-URI": uri, "Content-Type": content_type, "Content-Length": str(len(body))}
    head |= {k.replace("_", "-"): v for k, v in more.items()}
    head["WARC-Block-Digest"] = "sha1:" + base32_sha1(body)
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + body + b"\r\n\r\n"


def transaction(page: str, page_id: int | None, uri: str, html: bytes, digest: str, first: str | None) -> list[bytes]:
    """The records of one page; first: the page that this one is a revisit of."""
    uri = " ".join(uri.split())
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    own = record_id("response", page)
    if first is None:
        main = record("response", page, uri, "application/http; msgtype=response", http + html, WARC_Payload_Digest=f"sha1:{digest}")
    else:
        main = record("revisit", page, uri, "application/http; msgtype=response", http, WARC_Payload_Digest=f"sha1:{digest}", WARC_Profile=REVISIT, WARC_Refers_To=record_id("response", first))
    ask = f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode()
    about = (f"page-id: {page_id}\r\n" if page_id is not None else "\r\n").encode()
    return [record("request", page, uri, "application/http; msgtype=request", ask, WARC_Concurrent_To=own), main, record("metadata", page, uri, "application/warc-fields", about, WARC_Concurrent_To=own)]


def roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(k, digest, copy) -> first: for payloads of at least min_bytes, the page that the row is a revisit of."""
    keys = written(pages.select("k", "digest", "size"), "digests")
    first = keys.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("n")).filter("n > 1")
    return with_keyed(keys.distinct(), first, ["digest"]).select("k", "digest", F.when(F.col("k") > F.col("first"), F.col("first")).alias("first"))


def write_warc(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives below path; returns (file, captures)."""
    pages = pages.select(F.col(key).cast("long").alias("id"), text_or_empty(url).alias("url"), text_or_empty(html).alias("html"))
    pages = pages.withColumns({"k": F.coalesce("id", F.lit(-(2**63))), "digest": F.sha1("html"), "size": F.octet_length("html")})
    pages = pages.join(roles(pages, min_bytes), ["k", "digest"], "left").repartition("k", "digest").sortWithinPartitions("k", "digest")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        task, done, parts, size, count, last, copy = TaskContext.get().partitionId(), [], [], 0, 0, None, 0

        def close() -> None:
            nonlocal parts, size, count
            name = f"{root}/pages-{task:06d}-{len(done):05d}.warc.gz"
            own = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(own, compression=None) as out:
                out.write(b"".join(parts))
            store.move(own, name)
            done.append((name, count))
            parts, size, count = [], 0, 0

        for b in batches:
            for i, u, h, k, d, first in zip(b["id"], b["url"], b["html"], b["k"], b["digest"], b["first"]):
                copy = copy + 1 if (k, d) == last else 0
                last = (k, d)
                name = lambda k, copy=0: f"{k}:{d}:{copy}"  # noqa: B023, E731
                raw = h.encode("utf-8", "surrogatepass")
                for r in transaction(name(k, copy), None if pd.isna(i) else int(i), u, raw, base64.b32encode(bytes.fromhex(d)).decode(), None if pd.isna(first) else name(int(first))):
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    parts.append(z.compress(r) + z.flush())
                    size += len(r)
                count += 1
                if size >= file_bytes:
                    close()
        if parts:
            close()
        yield pd.DataFrame(done, columns=["file", "captures"])

    kept = pages.select("id", "url", "html", "k", "digest", "first")
    return written(kept.mapInPandas(write, "file string, captures long"), "warc-files")


def records_in(raw: bytes) -> Iterator[tuple]:
    """A RECORD for each of the WARC records that stand one behind the other in raw."""
    at = 0
    while True:
        while raw[at : at + 2] == b"\r\n":
            at += 2
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        h: dict[str, list[str]] = {}
        for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            h.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda name: h.get(name, [None])[0]  # noqa: B023, E731
        size = one("content-length") or ""
        at = min(len(raw), end + 4 + int(size)) if size.isdigit() else len(raw)
        yield parse(one, h.get("warc-concurrent-to", []), raw[end + 4 : at])


def parse(one: Callable[[str], str | None], concurrent: list[str], body: bytes) -> tuple:
    """A RECORD of a record's headers and block."""
    kind, http, payload, fields = (one("warc-type") or "").lower(), None, None, None
    if kind in ("request", "response", "revisit"):
        top, _, payload = body.partition(b"\r\n\r\n")
        http = top.decode("utf-8", "replace")
    else:
        fields = body.decode("utf-8", "replace")
    full = kind == "response"
    digest = base32_sha1(payload) if full else (one("warc-payload-digest") or "").removeprefix("sha1:") or None
    return (kind, one("warc-record-id"), concurrent, one("warc-refers-to"), one("warc-target-uri") or "", http, payload if full else None, len(payload) if full else None, digest, fields)


def members(content: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, one by one; an archive without gzip as it is."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], 1 << 16
        while not z.eof and at < len(view):
            parts.append(z.decompress(view[at : at + step]))
            at += step
        at = min(at, len(view)) - len(z.unused_data)
        yield b"".join(parts)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives below path. Payload and digest are the ones found, not those promised."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for content in b["content"]:
                found = (r for m in members(content) for r in records_in(m))
                while rows := list(itertools.islice(found, 512)):
                    yield pd.DataFrame(rows, columns=names).astype({"payload_bytes": "Int64"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(path)
    return files.select("content").mapInPandas(split, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """(record_id, request, response, metadata, n_requests, n_metadata): one nested row for each response or revisit record."""
    main = F.col("type").isin("response", "revisit")
    ends = records.withColumn("capture", F.explode(F.when(main, F.array("record_id")).otherwise(F.array_distinct("concurrent_to")))).filter("capture is not null")
    own = {c: F.any_value(F.when(main, F.col(c)), True) for c in ("type", "refers_to", "target_uri", "http", "payload", "payload_bytes", "payload_digest")}
    least = lambda kind, *more: F.min(F.when(F.col("type") == kind, F.struct(F.col("record_id").alias("id"), *more)))
    by = ends.groupBy("capture").agg(*[v.alias(f"r_{c}") for c, v in own.items()], least("request", "target_uri", "http").alias("request"), least("metadata", "fields").alias("metadata"), F.count_if(F.col("type") == "request").alias("n_requests"), F.count_if(F.col("type") == "metadata").alias("n_metadata"))
    return by.filter("r_type is not null").select(F.col("capture").alias("record_id"), "request", F.struct(*[F.col(f"r_{c}").alias(c) for c in own]).alias("response"), "metadata", "n_requests", "n_metadata")


def page_id():
    return F.regexp_extract("metadata.fields", r"page-id: (-?\d+)", 1).try_cast("long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), path)
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    own = captures(read_records(spark, path)).select("record_id", page_id().alias("page_id"), F.col("response.type").alias("type"), F.col("response.refers_to").alias("of"), F.col("response.payload_bytes").alias("n"), F.col("response.payload_digest").alias("digest"))
    own = written(own, "captures")
    responses, again = own.filter("type = 'response'"), own.filter("type = 'revisit'")
    first = responses.select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    first = first.join(again.groupBy("of").agg(F.count("*").alias("n")), "of")
    again = with_keyed(again.select("of", "page_id"), first, ["of"]).select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return responses.select("page_id", F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM p
), d AS (
  SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER) + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER), 1)), '') AS payload_digest,
    min(page_id) OVER (PARTITION BY hex) AS first FROM b
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
