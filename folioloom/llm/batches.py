"""Helpers of tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 8 << 20


def in_small_batches(table: DataFrame) -> DataFrame:
    """The table as it is, after the session's Arrow batches are bounded by bytes: a batch of 10,000 long texts would take too much memory.

    The setting stays, since it is read when the plan runs; it changes no result.
    """
    table.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES // 2))
    return table


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in pieces of about `limit` bytes of `column`; a longer text is a piece of its own. NULL weighs nothing."""
    for batch in batches:
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < len(lengths):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # workers live on, and the next task may need other sizes


def runs(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of `counts`, in one array."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments of `values`, whose lengths are `counts`; empty ones are zero."""
    out = np.zeros((len(counts), *values.shape[1:]), dtype=np.result_type(values.dtype, np.int64))
    filled = np.flatnonzero(counts)
    if len(filled):
        starts = (np.cumsum(counts) - counts)[filled]
        out[filled] = np.add.reduceat(values, starts, axis=0, dtype=out.dtype)
    return out
