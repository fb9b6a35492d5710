"""Files on any store that pyarrow reaches, for sources and sinks whose formats Spark lacks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    return fs.FileSystem.from_uri(uri) if re.match(r"[a-z][a-z0-9+.-]*:", uri, re.I) else (fs.LocalFileSystem(), uri)


def natural_key(name: str) -> list:
    """Names sort by it with their digit runs as numbers."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.findall(r"\d+|\D+", name)]


def listing(uri: str, suffixes: tuple[str, ...], prefix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files of a folder, or of one file, with one of the suffixes and the prefix, in natural order of their names.

    Names with a leading ``_`` or ``.`` are left out, as in Spark's own sources.
    """
    store, path = filesystem(uri)
    info = store.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path)) if info.type == fs.FileType.Directory else []
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    kept = [f for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffixes) and f.base_name.startswith(prefix) and f.base_name[0] not in "_."]
    return [(f.path, f.size) for f in sorted(kept, key=lambda f: natural_key(f.base_name))]


@dataclass
class Moved(WriterCommitMessage):
    """Files of one task: where they are, and where they belong."""

    files: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Writes rows of ``(name, content)`` as files.

    A task writes under names of its own; the driver moves the files of
    finished tasks to their places at commit and removes all at abort.
    """

    def __init__(self, uri: str):
        self.uri, self.run = uri, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Moved:
        store, path = filesystem(self.uri)
        store.create_dir(f"{path}/_temporary", recursive=True)
        mark, files = f"{path}/_temporary/{self.run}-{TaskContext.get().taskAttemptId()}", []
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content")):
                files.append((f"{mark}-{len(files)}", f"{path}/{name}"))
                with store.open_output_stream(files[-1][0], compression=None) as out:
                    out.write(content.as_buffer())
        return Moved(files)

    def commit(self, messages: list) -> None:
        store, path = filesystem(self.uri)
        for own, final in (f for m in messages if m is not None for f in m.files):
            store.create_dir(final.rsplit("/", 1)[0], recursive=True)
            store.move(own, final)
        self._clean(store, path)

    def abort(self, messages: list) -> None:
        self._clean(*filesystem(self.uri))

    def _clean(self, store, path: str) -> None:
        for info in store.get_file_info(fs.FileSelector(f"{path}/_temporary", allow_not_found=True)):
            if info.base_name.startswith(self.run):
                store.delete_file(info.path)


class FileSource(DataSource):
    """The sink ``files``: one file for each row of ``(name string, content binary)``."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        return FileWriter(self.options["path"])


def save_files(files: DataFrame, path: str) -> None:
    """Write each row of ``(name, content)`` as a file under ``path``; a file of that name is replaced."""
    files.sparkSession.dataSource.register(FileSource)
    files.select("name", F.col("content").cast("binary").alias("content")).write.format("files").mode("append").save(path)


def subfiles(spark: SparkSession, path: str, prefix: str = "", suffix: str = "") -> DataFrame:
    """``(name, path, length)``: the files of a folder with a prefix and suffix, in the order of their names.

    Listed by Spark's own reader, which does not open them.
    """
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "length")
    return found.where(F.col("name").startswith(prefix) & F.col("name").endswith(suffix)).orderBy("name")
