"""Files of any size as ordered chunks.

A chunk begins where decoding may begin anew: not before a byte that continues a UTF-8 character, and not between the two bytes of a Windows line end.
Decoded chunks, one after the other, are therefore the decoded file, whatever its bytes are. Each chunk is read by itself, so one huge file is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.sources.files import READ_BATCH_BYTES

CHUNK_BYTES = 32 << 20
LEAST_CHUNK = 16
_PARTITION_BYTES = 128 << 20


def _cut(source: BinaryIO, place: int, size: int) -> int:
    """The first place from `place` on where a chunk may begin. A character has three more bytes at most, so a fourth belongs to none before it."""
    if place <= 0 or place >= size:
        return max(0, min(place, size))
    source.seek(place - 1)
    near = source.read(6)
    k = 1
    while k < 4 and k < len(near) and near[k] & 0xC0 == 0x80:
        k += 1
    if near[k - 1:k + 1] == b"\r\n":
        k += 1
    return min(place - 1 + k, size)


def _read(path: str, number: int, count: int, size: int, chunk_bytes: int) -> tuple[int, bytes, bytes]:
    """Where the chunk begins, up to four bytes before it, and its bytes."""
    with open(path, "rb") as source:
        start = _cut(source, number * chunk_bytes, size)
        stop = size if number + 1 == count else _cut(source, (number + 1) * chunk_bytes, size)
        source.seek(max(0, start - 4))
        before = source.read(start - max(0, start - 4))
        content = source.read(stop - start)
    if len(content) != stop - start:
        raise OSError(f"{path}: shorter than it was listed")
    return start, before, content


_ADDED = (("start", pa.int64()), ("before", pa.binary()), ("content", pa.binary()), ("error", pa.string()))


def _with_chunks(part: pa.RecordBatch, read: list[tuple]) -> pa.RecordBatch:
    for (name, kind), values in zip(_ADDED, zip(*read, strict=True), strict=True):
        part = part.append_column(name, pa.array(values, kind))
    return part


def _reader(chunk_bytes: int, fail: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, read = 0, 0, []
            for at, (path, number, chunks, size) in enumerate(zip(*(batch[c].to_pylist() for c in ("absolute_path", "chunk", "chunks", "size")), strict=True)):
                start, before, content, error = None, None, None, None
                try:
                    start, before, content = _read(path, number, chunks, size, chunk_bytes)
                except OSError as e:
                    if fail:
                        raise
                    error = str(e)
                read.append((start, before, content, error))
                held += len(content or b"")
                if held >= READ_BATCH_BYTES:
                    ready, first, held, read = _with_chunks(batch.slice(first, len(read)), read), at + 1, 0, []
                    before = content = None  # held once, in the batch
                    yield ready
                    del ready
            if read:
                yield _with_chunks(batch.slice(first, len(read)), read)
        pa.default_memory_pool().release_unused()  # workers live on, idle ones too

    return run


def read_chunks(listing: DataFrame, chunk_bytes: int = CHUNK_BYTES, on_error: str = "fail") -> DataFrame:
    """The files of a listing (`absolute_path`, `size`, others) with `chunk` (from 0), `chunks`, `start`, `before` and `content` of each.

    An empty file is one empty chunk. `before` are up to four bytes before the chunk. `on_error="fail"` fails the job at the first
    chunk that cannot be read; `"keep"` keeps such rows with `error` set.
    """
    if chunk_bytes < LEAST_CHUNK:
        raise ValueError(f"chunks are {LEAST_CHUNK} bytes or more")
    if on_error not in ("fail", "keep"):
        raise ValueError("on_error is 'fail' or 'keep'")
    spark = listing.sparkSession
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / chunk_bytes)).cast("long")
    rows = listing.drop("error").withColumn("chunks", count).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    total = listing.agg(F.sum(F.col("size") + 512)).first()[0] or 0
    width = max(spark.sparkContext.defaultParallelism, -(-total // _PARTITION_BYTES))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    return rows.repartition(width, "absolute_path", "chunk").mapInArrow(_reader(chunk_bytes, on_error == "fail"), schema + ", start bigint, before binary, content binary, error string")
