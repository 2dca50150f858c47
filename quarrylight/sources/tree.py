"""A directory of source files as a table: a Python data source that lists with pruning and reads
on the executors.

``spark.read.format("binaryFile")`` will not do: it skips names that begin with an underscore
(``__init__.py``) and lists ignored directories before a filter can reject them.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..parse.languages import detect, extension_of
from ..session import ship_package

IGNORED_DIRS = frozenset("__pycache__ build coverage dist env node_modules out target vendor venv".split())
IGNORED_EXTENSIONS = frozenset(
    ".bundle.js .eot .gif .gz .ico .jpeg .jpg .lock .map .min.js .mp3 .mp4 .pdf .png .svg .tar .ttf .wav .woff .woff2 .zip".split()
)
MAX_BYTES = 2 << 20
MAX_FILES = 10_000
#: Bytes of text that one task reads, about.
PART_BYTES = 16 << 20
SCHEMA = "file_path string, relative_path string, content string, size_bytes long"


def _filesystem(root: str):
    from pyarrow import fs

    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), posixpath.abspath(root)


def wanted(path: str) -> bool:
    return extension_of(path) not in IGNORED_EXTENSIONS and detect(path) != "unknown"


def listing(root: str, max_bytes: int = MAX_BYTES) -> list[tuple[str, int]]:
    """(path, bytes) of the files that count, by path. Ignored directories and those whose names
    begin with a dot are never entered; what cannot be listed is left out."""
    from pyarrow import fs

    system, top = _filesystem(root)
    found, todo = [], [top]
    while todo:
        at = todo.pop()
        try:
            entries = system.get_file_info(fs.FileSelector(at))
        except OSError:
            continue
        for e in entries:
            if e.type == fs.FileType.Directory:
                if e.base_name not in IGNORED_DIRS and not e.base_name.startswith("."):
                    todo.append(e.path)
            elif e.type == fs.FileType.File and wanted(e.path) and e.size <= max_bytes:
                found.append((e.path, e.size))
    return sorted(found)


@dataclass
class _Part(InputPartition):
    files: list[tuple[str, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.max_bytes = int(options.get("maxbytes", MAX_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts: list[_Part] = []
        size = PART_BYTES
        for path, n in listing(self.root, self.max_bytes):
            if size + n > PART_BYTES or len(parts[-1].files) >= 4096:
                parts.append(_Part([]))
                size = 0
            parts[-1].files.append((path, n))
            size += n
        return parts or [_Part([])]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        system, top = _filesystem(self.root)
        rows: list[tuple[str, str, str, int]] = []
        for path, size in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError:
                continue  # gone or unreadable since it was listed
            if "\0" not in text:
                rows.append((path, posixpath.relpath(path, top), text.removeprefix("\ufeff"), size))
            if sum(r[3] for r in rows) > 4 << 20:
                yield self._batch(rows)
                rows = []
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
        kinds = [("file_path", pa.string()), ("relative_path", pa.string()), ("content", pa.string()), ("size_bytes", pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("path", root)``; option ``maxBytes``."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def walk(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_files: int = MAX_FILES) -> tuple[DataFrame, bool]:
    """(files, truncated): readable text files in languages that are known, the first ``max_files``
    by path. Files with a NUL are not text. Only where more files than that are listed, paths are
    read a first time to find the limit; contents are never sorted."""
    ship_package(spark)
    spark.dataSource.register(SourceTree)
    files = spark.read.format("source_tree").option("path", root).option("maxBytes", str(max_bytes)).load()
    if len(listing(root, max_bytes)) <= max_files:
        return files, False
    paths = [r["file_path"] for r in files.select("file_path").orderBy("file_path").limit(max_files + 1).collect()]
    if len(paths) <= max_files:
        return files, False
    return files.filter(F.col("file_path") < paths[max_files]), True
