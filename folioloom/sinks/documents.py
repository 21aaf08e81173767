"""Ordered text sinks.

A document is a folder of part files; read in name order they are its bytes. Parts are written in parallel, each from one
slice of the document order.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager, suppress
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioloom.config import Rendering
from folioloom.operators.documents import BLOCKS, FETCH_BYTES, HEAD, ITEMS, chunked_pieces, fetches, keys_of
from folioloom.operators.order import (SLICE_BYTES, Slices, by_slice, in_document_order, plan_slices, sort_files,
                                       with_order_key)
from folioloom.operators.render import SUMMARY_SEPARATOR, SUMMARY_TITLE, summary_head, with_blocks
from folioloom.session import local_folder

Formatter = Callable[[DataFrame], DataFrame]
# Writes a `_SUCCESS` file. Off for the first of two writes, so that a document without its head or end never looks finished.
_MARK = "mapreduce.fileoutputcommitter.marksuccessfuljobs"
# What Spark writes as %XX in the folder names of `partitionBy`.
_ESCAPED = re.compile(rb"""[\x00-\x1f"#%'*/:=?\\\x7f{\[\]^]""")


class NoFilesError(ValueError):
    """Nothing was selected."""


def _unended(text: Column) -> Column:
    """Text without its final newline, which the writer adds."""
    return F.substr(text, F.lit(1), F.length(text) - 1)


@contextmanager
def _published(spark: SparkSession, folder: str) -> Iterator[str]:
    """A folder beside `folder` to write into, which takes its place when all has been written. A run that fails leaves the old document as it was."""
    folder = folder.rstrip("/")
    store, path = _store(spark, folder)
    beside, old = (f"{folder}.{mark}-{uuid.uuid4().hex}" for mark in ("new", "old"))
    try:
        yield beside
    except BaseException:
        store.delete(path(beside), True)
        raise
    if store.exists(path(folder)):
        _moved(store, path(folder), path(old))
    _moved(store, path(beside), path(folder))
    store.delete(path(old), True)


def _store(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _moved(store, source, target) -> None:
    if not store.rename(source, target):
        raise OSError(f"{source} could not be renamed to {target}")


def write_document(processed: DataFrame, folder: str, style: Rendering, keys: DataFrame | None = None,
                   slice_bytes: int = SLICE_BYTES, ties: Sequence[str] = ()) -> int:
    """Write the Markdown document and return the number of files in it, replacing `folder` when it is complete.

    `keys` is a metadata view of the same rows (paths, sizes, last tags; a superset does), used to place the cuts without
    reading content. The content itself is evaluated once, shuffled once and never collected. With a summary the layout is
    `section=0` blocks, `section=1` head, `section=2` items.
    """
    sized = processed if keys is None else keys
    slices = plan_slices(keys_of(sized, ties=ties), slice_bytes=slice_bytes)
    rows = with_order_key(with_blocks(processed, style), ties=ties)
    with _published(rows.sparkSession, folder) as beside:
        if style.summary:
            return _write_with_summary(rows, beside, slices)
        seen = Observation()
        ordered = in_document_order(rows.select("_key", "block"), slices)
        # Which row is the last one shows when all is written; until then every block is followed by a blank line.
        ordered.select("block").observe(seen, F.count("*").alias("files")).write.option(_MARK, "false").text(beside)
        files = _some(seen.get["files"])
        _end(rows.sparkSession, beside)
    return files


def _end(spark: SparkSession, folder: str) -> None:
    """Take the blank line after the last block away: the last part that holds anything, at most a slice, is written anew by one task."""
    store, path = _store(spark, folder)
    parts = sorted(f.getPath().toString() for f in store.listStatus(path(folder)) if f.getLen() and f.getPath().getName().startswith("part-"))
    ended = f"{folder}/_end"
    last = spark.read.text(parts[-1], wholetext=True)
    last.select(F.substr("value", F.lit(1), F.length("value") - 2).alias("value")).coalesce(1).write.option(_MARK, "false").text(ended)
    (new,) = (f.getPath() for f in store.listStatus(path(ended)) if f.getPath().getName().startswith("part-"))
    store.delete(path(parts[-1]), False)
    _moved(store, new, path(parts[-1]))
    store.delete(path(ended), True)
    store.create(path(f"{folder}/_SUCCESS"), True).close()


def _write_with_summary(rows: DataFrame, folder: str, slices: Slices) -> int:
    both = F.array(
        F.struct(F.lit(BLOCKS).alias("section"), F.col("block").alias("value")),
        F.struct(F.lit(ITEMS).alias("section"), F.col("summary_line").alias("value")))
    seen = Observation()
    ordered = by_slice(rows.select("_key", "block", "summary_line"), slices)
    # A summary follows, so every block is followed by a blank line: the block's own newline plus the writer's.
    (ordered.observe(seen, F.count("*").alias("files")).select("_key", F.inline(both))
     .sortWithinPartitions("section", "_key").select("section", "value")
     .write.option(_MARK, "false").partitionBy("section").text(folder))
    files = _some(seen.get["files"])
    head = rows.sparkSession.range(1).select(F.lit(HEAD).alias("section"), summary_head(F.lit(files)).alias("value"))
    head.coalesce(1).write.mode("append").partitionBy("section").text(folder)
    return files


def _some(files: int) -> int:
    if not files:
        raise NoFilesError("No files matched the selection")
    return files


def write_group_documents(processed: DataFrame, folder: str, group: str, style: Rendering, chunk_bytes: int = SLICE_BYTES,
                          slice_bytes: int = SLICE_BYTES, ties: Sequence[str] = ()) -> None:
    """One document per group: the parts below `folder/<group>=<value>/` in name order.

    A group up to `chunk_bytes` is one file; a larger one is written by several tasks, a `chunk=` folder for each part. A folder pair per group
    suits up to some hundred thousand groups; for more, write `group_documents(...)` as a table. Folder names cannot tell NULL from an empty
    text, so both are marked (`null:` and `text:`) where the column has such values.

    On a mounted file system the tasks make the files themselves, in a folder that takes the place of `folder` when all is written: Hadoop's local
    file system forks processes for each file. Other stores are written by Spark.
    """
    rows = chunked_pieces(processed, [group], style, chunk_bytes, slice_bytes, ties)
    shown = F.col(group).cast("string")
    if processed.schema[group].nullable and not processed.where(F.col(group).isNull() | (shown == "")).isEmpty():
        rows = rows.withColumn(group, F.when(F.col(group).isNull(), "null:").otherwise(F.concat(F.lit("text:"), shown)))
    rows = rows.withColumn("chunk", F.format_string("%019d", "chunk")).sortWithinPartitions(group, "chunk", "_key")
    spark = rows.sparkSession
    if local_folder(spark, folder) is None:
        rows.select(group, "chunk", _unended(F.col("text")).alias("value")).write.mode("overwrite").partitionBy(group, "chunk").text(folder)
        return
    named = rows.select(*[F.col(c).cast("string").cast("binary").alias(a) for c, a in ((group, "name"), ("chunk", "chunk"), ("text", "text"))])
    with _published(spark, folder) as beside:
        store, path = _store(spark, beside)
        store.mkdirs(path(beside))
        named.mapInArrow(_store_parts(local_folder(spark, beside), group), "files bigint").agg(F.sum("files")).collect()
        store.create(path(f"{beside}/_SUCCESS"), True).close()


def _store_parts(root: str, group: str):
    """Writes rows of `name`, `chunk` and `text`, sorted by the first two, as the part files of `partitionBy(group, "chunk")`."""
    column = _escaped(group.encode())

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, files = TaskContext.get(), 0
        rows = (row for batch in batches for row in zip(batch["name"].to_pylist(), batch["chunk"].to_pylist(), batch["text"]))
        for (name, chunk), parts in groupby(rows, key=lambda row: row[:2]):
            place = root.encode()
            for below in (column + b"=" + (_escaped(name) if name else b"__HIVE_DEFAULT_PARTITION__"), b"chunk=" + chunk):
                place = os.path.join(place, below)
                with suppress(FileExistsError):
                    os.mkdir(place)
            # A file is hidden until it is whole; an attempt that is repeated replaces it by the same one.
            unfinished = os.path.join(place, b".part-%d" % task.taskAttemptId())
            try:
                with open(unfinished, "wb") as f:
                    f.writelines(text.as_buffer() or b"\n" for *_, text in parts)
                os.replace(unfinished, os.path.join(place, b"part-%05d.txt" % task.partitionId()))
            except BaseException:
                with suppress(FileNotFoundError):
                    os.remove(unfinished)
                raise
            files += 1
        yield pa.RecordBatch.from_pydict({"files": [files]})

    return store


def _escaped(name: bytes) -> bytes:
    return _ESCAPED.sub(lambda found: b"%%%02X" % found[0][0], name)


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """Part files of a written document in document order, with their sizes."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt")
            .load(folder).select("path", "length").orderBy("path"))


def iterate_document(processed: DataFrame, style: Rendering, keys: DataFrame | None = None, ties: Sequence[str] = (),
                     fetch_bytes: int = FETCH_BYTES) -> Iterator[str]:
    """Pieces of the document in order, for printing. A job for each `fetch_bytes` or so, and no more than that on the driver; of a document of
    over `FETCHES` such fetches, larger ones up to `FETCH_BYTES`.

    `keys` is as in `write_document`. The content is evaluated and shuffled once. The summary's head counts the blocks that have gone by.
    """
    files, listed = 0, False
    for row in fetches(processed, style, keys, ties, fetch_bytes).toLocalIterator():
        if row.section == ITEMS:
            if not listed:
                yield f"\n{SUMMARY_SEPARATOR}\n{SUMMARY_TITLE}: ({files})\n"
                listed = True
            yield row.text
        else:
            yield f"\n{row.text}" if files else row.text
            files += 1


def write_formatted(processed: DataFrame, formatter: Formatter, folder: str, ties: Sequence[str] = ()) -> None:
    """Own format: `formatter` maps ordered rows to one string column, written as text in document order."""
    formatter(sort_files(processed, ties)).write.mode("overwrite").text(folder)
