"""A file tree as a Spark data source: `spark.read.format("corpus_tree").load(root)`.

Any file system that Arrow opens will do: a path, or a URI such as `s3://`, `hdfs://`, `gs://`. The walk is divided without listing anything on the driver: every
task lists the folders above `split_depth`, and what they hold (files, and the subtrees that begin there) belongs to the task that its path hashes to. So
a root with very many files is several tasks' work. Comparisons of depth, size, names and paths are pushed into the walk: a subtree that no path of
the filter can lie in is not entered, and contents are read of what is left.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
)

COLUMNS = "absolute_path string, relative_path string, name string, depth int, size bigint, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
_BATCH_ROWS, _BATCH_BYTES = 10_000, 16 << 20
#: A value of a row holds no more.
VALUE_LIMIT = (1 << 31) - 64

_TESTS = {
    EqualTo: lambda value, given: value == given,
    In: lambda value, given: value in given,
    LessThan: lambda value, given: value < given,
    LessThanOrEqual: lambda value, given: value <= given,
    GreaterThan: lambda value, given: value > given,
    GreaterThanOrEqual: lambda value, given: value >= given,
    StringStartsWith: lambda value, given: value.startswith(given),
    StringEndsWith: lambda value, given: value.endswith(given),
    StringContains: lambda value, given: given in value,
}
_NUMBERS, _TEXTS = ("depth", "size"), ("name", "relative_path")


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file given as path or URI."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", root):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", root))
    return fs.LocalFileSystem(), os.path.abspath(root)


class Share(InputPartition):
    """The part `number` of `parts` of the walk."""

    def __init__(self, number: int, parts: int):
        super().__init__((number, parts))
        self.number, self.parts = number, parts

    def owns(self, relative_path: str) -> bool:
        return zlib.crc32(relative_path.encode("utf-8", "surrogateescape")) % self.parts == self.number


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"
        self.split_depth, self.parts = int(options.get("splitdepth", "2")), int(options.get("partitions", "64"))
        if self.split_depth < 1 or self.parts < 1:
            raise ValueError("splitDepth and partitions are at least 1")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in _TESTS and (column in _NUMBERS and not isinstance(f, (StringStartsWith, StringEndsWith, StringContains)) or column in _TEXTS):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return [Share(k, self.parts) for k in range(self.parts)]

    def _passes(self, **values) -> bool:
        return all(_TESTS[kind](values[column], given) for column, kind, given in self.tests if column in values)

    def _may_hold(self, folder: str, depth: int) -> bool:
        """Whether a file below the folder, whose files have this depth, can pass what is asked of paths and depths."""
        for column, kind, given in self.tests:
            if column == "depth" and (kind is LessThan and depth >= given or kind in (LessThanOrEqual, EqualTo) and depth > given or kind is In and depth > max(given)):
                return False
            if column == "relative_path" and kind in (EqualTo, StringStartsWith, In):
                inside = folder + "/"
                wanted = given if kind is In else [given]
                if not any(w.startswith(inside) or kind is StringStartsWith and inside.startswith(w) for w in wanted):
                    return False
        return True

    def _files(self, store: fs.FileSystem, root: str, share: Share) -> Iterator[tuple]:
        """(absolute path, relative path, size, error) of the share's regular files; links are skipped, hidden files are not."""
        top = store.get_file_info(root)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        if top.type == fs.FileType.File:
            if share.number == 0:
                yield root, top.base_name, top.size, None
            return
        local, todo = isinstance(store, fs.LocalFileSystem), [("", 1)]
        while todo:
            folder, depth = todo.pop()
            try:
                entries = store.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root))
            except OSError as e:
                if depth > self.split_depth or share.owns(folder):
                    yield f"{root}/{folder}", folder, None, str(e)
                continue
            for entry in entries:
                relative = f"{folder}/{entry.base_name}" if folder else entry.base_name
                if local and os.path.islink(entry.path) or depth == self.split_depth and not share.owns(relative):
                    continue
                if entry.type == fs.FileType.Directory:
                    if self.recursive and self._may_hold(relative, depth + 1):
                        todo.append((relative, depth + 1))
                elif entry.type == fs.FileType.File and (depth >= self.split_depth or share.owns(relative)):
                    yield entry.path, relative, entry.size, None

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.root)
        schema = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in schema_of(self.content).split(", ")])
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path, relative, length, error in self._files(store, root.rstrip("/") or "/", partition):
            name, depth = relative.rpartition("/")[2], relative.count("/") + 1
            if error is None and not self._passes(relative_path=relative, name=name, depth=depth, size=length) or error is not None and self.tests:
                continue
            row = (path, relative, name, depth, length, error)
            if self.content:
                row, size = self._with_content(store, row), size + (length or 0)
            rows.append(row)
            if len(rows) == _BATCH_ROWS or size >= _BATCH_BYTES:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    def _with_content(self, store: fs.FileSystem, row: tuple) -> tuple:
        path, *_, length, error = row
        if error is None and length > VALUE_LIMIT:
            error = f"{path}: larger than one value can be, read it in chunks"
        content = None
        if error is None:
            try:
                with store.open_input_stream(path, compression=None) as source:  # the bytes as they are, whatever the name says
                    content = source.read()
            except OSError as e:
                error = str(e)
        return (*row[:5], error, content)


def schema_of(content: bool) -> str:
    return COLUMNS + (", content binary" if content else "")


class TreeSource(DataSource):
    """Options: `recursive` (true), `content` (false: paths and sizes only), `splitDepth` (2), `partitions` (64).

    Rows have `depth` 1 for files of the root. Folders that cannot be listed and files that cannot be read have `error` set; a filter that is pushed
    leaves the former out, since they have no size and no file's name.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return schema_of(self.options.get("content", "false").lower() == "true")

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register_tree_source(spark: SparkSession) -> None:
    """Make `corpus_tree` known to the session, and let the session push filters into Python sources."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
