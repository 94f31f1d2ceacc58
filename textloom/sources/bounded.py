"""A data source of file beginnings (SRC-01..03, SRC-05): folders are pruned while they are listed, and only so many bytes of a file are read."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from textloom.sources.files import EXTENSIONS, PROTECTED

#: Folders that the driver lists at most before tasks walk on from there; bytes and files of a task that gets files.
FOLDERS, SPLIT_BYTES, SPLIT_FILES = 1000, 64 << 20, 10_000


@dataclass
class Part(InputPartition):
    """What one task reads: files, and a folder that it walks."""

    files: list[tuple[str, int]] = field(default_factory=list)
    folder: str | None = None


class BeginningsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.most = options["path"], int(options.get("bytes", 4_000_000))
        self.folders = int(options.get("folders", FOLDERS))
        self.extensions = set(options.get("extensions", ",".join(EXTENSIONS)).split(","))
        self.protected = set(options.get("protected", ",".join(PROTECTED)).split(","))

    def listed(self, store: fs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """(folders, files) right below a folder; protected folders are never opened."""
        below = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)
        folders = [x.path for x in below if x.type == fs.FileType.Directory and x.base_name not in self.protected]
        return folders, [(x.path, x.size) for x in below if x.type == fs.FileType.File and x.extension.lower() in self.extensions]

    def partitions(self) -> list[Part]:
        store, root = fs.FileSystem.from_uri(self.uri)
        todo, parts, own, size = [root], [], [], 0
        listed = 0
        while todo and listed < self.folders:
            folders, files = self.listed(store, todo.pop(0))
            todo += folders
            listed += 1
            for path, n in files:
                if own and (size + min(n, self.most) > SPLIT_BYTES or len(own) == SPLIT_FILES):
                    parts.append(Part(own))
                    own, size = [], 0
                own.append((path, n))
                size += min(n, self.most)
        return [*parts, *([Part(own)] if own else []), *[Part(folder=x) for x in todo]] or [Part()]

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.uri)
        todo, files = [partition.folder] if partition.folder else [], list(partition.files)
        while todo or files:
            for path, size in files:
                with store.open_input_file(path) as f:
                    yield path, path.rsplit("/", 1)[-1].rsplit(".", 1)[0], path.rsplit(".", 1)[-1].lower(), size, f.read(self.most)
            files = []
            if todo:
                folders, files = self.listed(store, todo.pop())
                todo += folders


class Beginnings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "beginnings"

    def schema(self) -> str:
        return "path string, title string, ext string, length long, content binary"

    def reader(self, schema) -> BeginningsReader:
        return BeginningsReader(self.options)


def beginnings(spark: SparkSession, path: str, n_bytes: int = 4_000_000, **options: str) -> DataFrame:
    """(path, title, ext, length, content) of the files below path, content being the first n_bytes of each.

    The driver lists folders until there are enough of them, tasks walk the rest. path is one that Arrow's file systems open.
    """
    spark.dataSource.register(Beginnings)
    return spark.read.format("beginnings").option("path", path).option("bytes", n_bytes).options(**options).load()


def bounded_texts(spark: SparkSession, path: str, chars: int = 1_000_000, **options: str) -> DataFrame:
    """SRC-04, SRC-05: the same with text, the first ``chars`` characters of each file, for which four bytes each are read."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return beginnings(spark, path, 4 * chars, **options).withColumn("text", F.substring(text, 1, chars)).drop("content")
