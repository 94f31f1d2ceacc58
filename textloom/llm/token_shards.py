"""Training-order materialisation: token sequences in fixed-stride shards, in the order of a keyed permutation.

1. Documents are encoded once, ended with an end-of-text id and packed, one behind the other within a task, to
   sequences of equal length; the last sequence of a task is filled up with end-of-text ids. Sequences are written as
   a table with the task's number and their place in it, so an unstable order of the input does no harm.
2. That table's counts give each task an offset, so sequence i of task t has the index offset[t] + i below the whole
   number N.
3. The slot of an index is its image under a Feistel permutation of the next power of two, keyed by the seed, applied
   again while the image is N or more (cycle-walking): a permutation of 0 .. N - 1, computed where the row is.
4. Slots are dealt by ranges, which are known beforehand: a task gets adjacent shards and writes each of them as
   per_shard * length uint16 numbers in slot order, so slot s lies at s % per_shard * stride of shard s // per_shard,
   and a reader may start at any slot. A shard appears under its name only when it is whole, and a run writes all of its
   shards, whatever lies there. Last comes a manifest with the seed and the numbers of sequences; a reader
   needs it and opens no shard beyond it, so shards of an earlier, longer run are not read.

Sequences are shuffled zstd-compressed with a dictionary, the first DICTIONARY sequences of the table, which tasks get
with their code; any sequences would do, they only change the size of what is shuffled.

Defined cases: null and empty texts give a lone end-of-text id; texts of any length run over as many sequences as
they need; equal rows are written each; a null id is noted as null; an empty table gives no shard and an empty
result; columns beyond id and text are not read.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe_words import TOKENIZERS, byte_pieces
from textloom.llm.common import discard, shared_dir, table, text_or_empty, written

LENGTH, PER_SHARD, SEED, ROUNDS = 1024, 2048, 20240101, 6
#: What a task writes at most where shards are smaller.
TASK_BYTES = 64 << 20
#: How the table of sequences is written: it is the largest scratch table, read once.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "5", "parquet.page.size": str(8 << 20)}
#: Sequences in the dictionary that the shuffled ones are compressed with, 1 MB of tokens at most.
DICTIONARY = 512

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def permute(index: np.ndarray, n: int, seed: int = SEED) -> np.ndarray:
    """Images of 0 <= index < n under a permutation of 0 .. n - 1 that the seed keys."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> shift, x[todo] & low
        for r in range(ROUNDS):
            f = (right + np.uint64((seed * 0x9E3779B9 + r * 0x85EBCA6B + 1) % 2**64)) * _A
            f = (f ^ (f >> np.uint64(31))) * _B
            left, right = right, left ^ ((f >> np.uint64(29)) & low)
        x[todo] = (left << shift) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def _sequences(batches: Iterator[pd.DataFrame], path: str, length: int) -> Iterator[tuple[bytes, list, int]]:
    """(tokens, ids of its documents, tokens before the filling) of each sequence."""
    coder, size = byte_pieces(path), 2 * length
    end = np.uint16(coder.eos).tobytes()
    rest, owners = b"", []
    for b in batches:
        for k, t in zip(b["k"], b["t"]):
            rest += coder.encode(t) + end
            owners.append(None if pd.isna(k) else int(k))
            at = 0
            while len(rest) - at >= size:
                yield rest[at : at + size], owners, length
                at += size
                owners = owners[-1:] if len(rest) > at else []
            rest = rest[at:]
    if rest:
        yield rest + end * ((size - len(rest)) // 2), owners, len(rest) // 2


def write_shards(docs: DataFrame, path: str, *, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, seed: int = SEED) -> DataFrame:
    """Writes shards below path; returns (slot, shard, doc_ids, n_tokens), a row for each sequence."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, at, found = TaskContext.get().partitionId(), 0, _sequences(batches, tokenizer, length)
        while rows := list(itertools.islice(found, 1024)):
            yield pd.DataFrame({"task": task, "i": np.arange(at, at + len(rows)), "tokens": [r[0] for r in rows], "doc_ids": [r[1] for r in rows], "n_tokens": [r[2] for r in rows]})
            at += len(rows)

    packed = written(docs.mapInPandas(pack, "task int, i long, tokens binary, doc_ids array<long>, n_tokens int"), "sequences", **PACKED)
    counts = packed.groupBy("task").count().collect()  # one pair of numbers for each task
    n, starts = 0, np.zeros(max((r["task"] for r in counts), default=0) + 1, np.int64)
    for r in sorted(counts):
        starts[r["task"]] = n
        n += r["count"]

    @F.pandas_udf("long")
    def slot_of(task: pd.Series, i: pd.Series) -> pd.Series:
        return pd.Series(permute(starts[task.to_numpy()] + i.to_numpy(), n, seed))

    common = b"".join(bytes(r["tokens"]) for r in packed.select("tokens").limit(DICTIONARY).collect())

    def shared() -> zstandard.ZstdCompressionDict:
        return zstandard.ZstdCompressionDict(common, dict_type=zstandard.DICT_TYPE_RAWCONTENT)

    @F.pandas_udf("binary")
    def small(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = zstandard.ZstdCompressor(level=5, dict_data=shared())
        for tokens in batches:
            yield tokens.map(coder.compress)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        coder, shard, parts = zstandard.ZstdDecompressor(dict_data=shared()), None, []

        def close() -> None:
            name = f"{root}/shard-{shard:08d}.bin"
            own = f"{name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(own, compression=None) as out:
                out.write(b"".join(parts))
            store.move(own, name)  # in place of what an earlier attempt, or run, has left

        for b in batches:
            b.insert(0, "shard", b["slot"] // per_shard)
            for s, t in zip(b["shard"].tolist(), b["tokens"]):
                if s != shard:
                    if parts:
                        close()
                    shard, parts = s, []
                parts.append(coder.decompress(t))
            yield b.drop(columns="tokens")
        if parts:
            close()

    shards = max(1, -(-n // per_shard))
    # a task writes TASK_BYTES or less, one shard at least; small tables are dealt to as many tasks as shuffles have
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * length * 2 // TASK_BYTES)))
    rows = packed.select(slot_of("task", "i").alias("slot"), small("tokens").alias("tokens"), "doc_ids", "n_tokens")
    rows = rows.repartitionById(tasks, F.floor(F.floor(F.col("slot") / per_shard) * tasks / shards).cast("int")).sortWithinPartitions("slot")
    _manifest(path, None)
    index = written(rows.mapInPandas(write, "shard long, slot long, doc_ids array<long>, n_tokens int"), "shard-index")
    _manifest(path, {"seed": seed, "sequences": n, "length": length, "per_shard": per_shard})
    discard(packed)
    return index


def _manifest(path: str, found: dict | None) -> None:
    """Writes the manifest of the shards below path, or deletes it."""
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root)
    name = f"{root}/manifest.json"
    if store.get_file_info(name).type != fs.FileType.NotFound:
        store.delete_file(name)
    if found:
        with store.open_output_stream(name, compression=None) as out:
            out.write(json.dumps(found).encode())


def read_shards(spark: SparkSession, path: str, *, start: int = 0) -> DataFrame:
    """(slot, tokens) from slot ``start`` on; earlier shards are not opened."""
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        found = json.loads(f.read())
    n, length, per_shard = found["sequences"], found["length"], found["per_shard"]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path)
    files = files.withColumn("shard", F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long")).filter((F.col("shard") >= start // per_shard) & (F.col("shard") < -(-n // per_shard)))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, raw in zip(b["shard"], b["content"]):
                slots = s * per_shard + np.arange(len(raw) // (2 * length))
                kept = slots[slots >= start]
                yield pd.DataFrame({"slot": kept, "tokens": [raw[k : k + 2 * length] for k in ((kept - s * per_shard) * 2 * length).tolist()]})

    return files.select("shard", "content").mapInPandas(split, "slot long, tokens binary")


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sequence, in the shards as they are read back: slot, shard, its documents, tokens, SHA-256 of its bytes."""
    path = shared_dir(spark, "shards")
    index = write_shards(table(spark, sf_dir, "documents"), path, tokenizer=f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    found = read_shards(spark, path).select("slot", F.sha2("tokens", 256).alias("sha256"))
    return index.join(found, "slot", "left").select("slot", "shard", "doc_ids", "n_tokens", "sha256")
