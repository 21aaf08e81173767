"""File trees on a file system that all executors mount.

Spark's file sources drop names that start with `.` or `_` and follow symbolic links; a corpus keeps hidden files and
skips links. So folders are listed by tasks, one level of the tree per job: every folder is its own unit of work,
however lopsided the tree is, and the driver only learns whether another level exists.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.session import mounted_path, new_table_path

_ENTRY = "absolute_path string, relative_path string, size bigint, is_dir boolean, error string"
_ENTRY_ARROW = pa.schema([("absolute_path", pa.string()), ("relative_path", pa.string()), ("size", pa.int64()),
                          ("is_dir", pa.bool_()), ("error", pa.string())])
_LISTING_BATCH = 20_000
READ_BATCH_BYTES = 4 << 20
_PARTITION_BYTES = 128 << 20
_VALUE_LIMIT = (1 << 31) - 64


def _entries(folder: str, relative: str) -> Iterator[tuple]:
    try:
        scan = os.scandir(folder)
    except OSError as e:
        yield folder, relative, None, False, str(e)
        return
    with scan:
        for entry in scan:
            name = f"{relative}/{entry.name}" if relative else entry.name
            try:
                info = entry.stat(follow_symlinks=False)
            except OSError as e:
                yield entry.path, name, None, False, str(e)
                continue
            if stat.S_ISDIR(info.st_mode):
                yield entry.path, name, None, True, None
            elif stat.S_ISREG(info.st_mode):
                yield entry.path, name, info.st_size, False, None


def entry_batches(folder: str, relative: str) -> Iterator[pa.RecordBatch]:
    """The entries of one folder, a bounded number at a time."""
    rows = []
    for row in _entries(folder, relative):
        rows.append(row)
        if len(rows) == _LISTING_BATCH:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, relative in zip(batch["absolute_path"].to_pylist(), batch["relative_path"].to_pylist()):
            yield from entry_batches(folder, relative)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _ENTRY_ARROW)], schema=_ENTRY_ARROW)


def list_files(spark: SparkSession, root: str, recursive: bool = True,
               prune: Callable[[Column], Column] | None = None) -> DataFrame:
    """`(absolute_path, relative_path, size, error)` of the regular files below `root`, or of `root` itself.

    `prune(relative_path)` marks folders that are not entered. Entries that cannot be read keep their row, with
    `error` set and no size.
    """
    root = os.path.abspath(mounted_path(root))
    if os.path.isfile(root):
        single = [(root, os.path.basename(root), os.stat(root).st_size, False, None)]
        return spark.createDataFrame(single, _ENTRY).drop("is_dir")
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    table = new_table_path(spark, "listing")
    width = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root, "")], "absolute_path string, relative_path string")
    level = 0
    while True:
        listed = frontier.repartition(width, "relative_path").mapInArrow(_list_folders, _ENTRY)
        if prune is not None:
            listed = listed.where(~(F.col("is_dir") & prune(F.col("relative_path"))))
        # A written level is the cut in the lineage: losing an executor repeats one level at most.
        listed.write.parquet(f"{table}/level={level}")
        frontier = (spark.read.schema(_ENTRY).parquet(f"{table}/level={level}").where("is_dir")
                    .select("absolute_path", "relative_path"))
        if not recursive or frontier.isEmpty():
            break
        level += 1
    return spark.read.schema(_ENTRY).parquet(*[f"{table}/level={n}" for n in range(level + 1)]).where("not is_dir").drop("is_dir")


def _reader(head_bytes: int | None, fail: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, contents, errors = 0, 0, [], []
            for at, (path, known) in enumerate(zip(batch["absolute_path"].to_pylist(), batch["error"].to_pylist())):
                content, error = None, known
                if error is None:
                    try:
                        with open(path, "rb") as f:
                            content = f.read(head_bytes if head_bytes is not None else _VALUE_LIMIT + 1)
                        if len(content) > _VALUE_LIMIT:
                            content, error = None, f"{path}: larger than one value can be, read it in chunks"
                    except OSError as e:
                        error = str(e)
                if error is not None and fail:
                    raise OSError(error)
                contents.append(content)
                errors.append(error)
                size += len(content or b"")
                if size >= READ_BATCH_BYTES:
                    ready, start, size, contents, errors = _with_content(batch, start, contents, errors), at + 1, 0, [], []
                    content = None  # held once, in the batch
                    yield ready
                    del ready
            if contents:
                yield _with_content(batch, start, contents, errors)
        pa.default_memory_pool().release_unused()  # workers live on, idle ones too

    return read


def _with_content(batch: pa.RecordBatch, start: int, contents: list, errors: list) -> pa.RecordBatch:
    part = batch.slice(start, len(contents))
    columns = [c for name, c in zip(part.schema.names, part.columns) if name != "error"]
    names = [name for name in part.schema.names if name != "error"]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())], names=[*names, "content", "error"])


def read_contents(listing: DataFrame, head_bytes: int | None = None, on_error: str = "fail") -> DataFrame:
    """Adds `content` (whole, or the first `head_bytes`) to the files that selection has left.

    `on_error="fail"` fails the job at the first unreadable file; `"keep"` keeps such rows with `error` set.
    """
    if on_error not in ("fail", "keep"):
        raise ValueError("on_error is 'fail' or 'keep'")
    weight = F.least(F.col("size"), F.lit(head_bytes)) if head_bytes else F.col("size")
    if "error" not in listing.columns:
        listing = listing.withColumn("error", F.lit(None).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema if f.name != "error")
    return (_dealt_out(listing, weight)
            .mapInArrow(_reader(head_bytes, on_error == "fail"), schema + ", content binary, error string"))


def _dealt_out(listing: DataFrame, weight: Column) -> DataFrame:
    """The files over the cores, or over more tasks of about 128 MB."""
    total = listing.agg(F.sum(weight + 512)).first()[0] or 0
    width = max(listing.sparkSession.sparkContext.defaultParallelism, -(-total // _PARTITION_BYTES))
    return listing.repartition(width, "absolute_path")


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files, ats, lines, size = [], [], [], 0
        for path, file, error in zip(*(batch[c].to_pylist() for c in ("absolute_path", "relative_path", "error"))):
            if error is not None:
                raise OSError(error)
            with open(path, "rb") as f:
                for at, line in enumerate(f):
                    files.append(file)
                    ats.append(at)
                    lines.append(line.removesuffix(b"\n"))
                    size += len(line) + len(file)
                    if size >= READ_BATCH_BYTES:
                        yield _lines(files, ats, lines)
                        files, ats, lines, size = [], [], [], 0
        yield _lines(files, ats, lines)
    pa.default_memory_pool().release_unused()


def _lines(files: list, ats: list, lines: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ats, pa.int64()), pa.array(lines, pa.binary())], names=["relative_path", "at", "line"])


def read_lines(listing: DataFrame) -> DataFrame:
    """`(relative_path, at, line)`: the lines of the files, counted from 0 in each, without the newlines that end them.

    A task holds a batch of 4 MB, or one line. An unreadable file fails the job.
    """
    read = _dealt_out(listing, F.col("size")).select("absolute_path", "relative_path", "error")
    return read.mapInArrow(_read_lines, "relative_path string, at bigint, line binary").withColumn("line", F.col("line").cast("string"))


def read_tree(spark: SparkSession, root: str, recursive: bool = True, on_error: str = "fail") -> DataFrame:
    """Listing and content of a whole tree in one step."""
    return read_contents(list_files(spark, root, recursive), on_error=on_error)
