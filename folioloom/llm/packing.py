"""Packing of documents into training sequences with balanced attention cost."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from folioloom.llm.batches import in_small_batches, text_slices
from folioloom.llm.tokens import crc32_of, with_end_id, word_bpe_path, worker_encoder

#: Tokens that are packed together. A window bounds the memory of a task and wastes less than one sequence.
WINDOW_TOKENS = 4 << 20
#: Cost of n tokens: LINEAR n + QUADRATIC n^2, so that at 2,048 tokens attention costs as much as the rest.
LINEAR, QUADRATIC = 1.0, 1 / 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """Pieces of the documents: document, start, length, sequence, offset.

    Whole sequences are cut from long documents first. The rests go, in descending order, each to the sequence of lowest cost
    that has room. A rest that fits nowhere is cut: the lowest-cost sequence with any room takes what it can, and what
    remains queues again by its length. There are as many sequences as the tokens need, so fewer than `capacity` places stay empty.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    full = lengths // capacity
    n_full = int(full.sum())
    document = np.repeat(np.arange(len(lengths)), full)
    start = (np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)) * capacity
    rest = lengths - full * capacity
    open_count = -(-int(rest.sum()) // capacity)
    room, cost = np.full(open_count, capacity, dtype=np.int64), np.zeros(open_count)
    queue = [(-int(rest[d]), int(d), int(full[d] * capacity)) for d in np.flatnonzero(rest)]
    heapq.heapify(queue)
    pieces = []
    while queue:
        size, d, begin = heapq.heappop(queue)
        size = -size
        fits = np.where(room >= size, cost, np.inf)
        s = int(np.argmin(fits))
        if fits[s] == np.inf:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
        taken = min(size, int(room[s]))
        pieces.append((d, begin, taken, s, capacity - int(room[s])))
        room[s] -= taken
        cost[s] += LINEAR * taken + QUADRATIC * taken * taken
        if taken < size:
            heapq.heappush(queue, (taken - size, d, begin + taken))
    tail = np.array(pieces, dtype=np.int64).reshape(-1, 5)
    return (np.concatenate([document, tail[:, 0]]), np.concatenate([start, tail[:, 1]]), np.concatenate([np.full(n_full, capacity), tail[:, 2]]),
            np.concatenate([np.arange(n_full), tail[:, 3] + n_full]), np.concatenate([np.zeros(n_full, dtype=np.int64), tail[:, 4]]))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, window_tokens: int = WINDOW_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all `doc_id`, `text` rows; with `ids`, the real token ids, if `with_ids`.

    NULL and empty texts are documents of `end_id` alone; repeated rows are documents of their own; other columns are ignored and
    an empty table gives no piece. Each task packs its rows window by window as they come, so nothing is shuffled, and a task
    that is repeated gives the same sequences. Sequence numbers are unique, not dense: the task's number stands above 2^33.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = worker_encoder(tokenizer_path), TaskContext.get().partitionId() << 33
        ids, lengths, doc_ids, n = [], [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            all_ids, sizes = np.concatenate(ids), np.concatenate(lengths)
            document, start, length, sequence, offset = assign(sizes, capacity)
            begin = (np.cumsum(sizes) - sizes)[document] + start
            parts = [all_ids[b:b + n] for b, n in zip(begin, length, strict=True)]
            columns = [pa.array(doc_ids, pa.int64()).take(pa.array(document)), pa.array(start), pa.array(length), pa.array([crc32_of(p) for p in parts], pa.int64()),
                       pa.array(sizes[document]), pa.array(sequence + first), pa.array(offset)]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            first += int(sequence.max()) + 1
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        for batch in text_slices(batches, limit=1 << 20):
            more, counts = with_end_id(*encoder.encode(batch.column("text")), end_id)
            ids.append(more)
            lengths.append(counts)
            doc_ids += batch.column("doc_id").to_pylist()
            n += len(more)
            if n >= window_tokens:
                yield packed()
                ids, lengths, doc_ids, n = [], [], [], 0
        if doc_ids:
            yield packed()

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 2,048 tokens, each document followed by id 1."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_bpe_path(), 1)
