"""Token ids as directly addressable codes: any id of a file is read without decoding its neighbours.

An id is cut into chunks of 8 bits, lowest first. Level k holds the k-th chunk of every id that has one, and a bitmap with
one bit per entry: whether the id goes on in the next level. A rank directory gives the number of set bits before every 512
bits; the place of an id in the next level is that count plus the set bits within its block.

File, little-endian: magic `DAC1`, u32 levels, u64 ids, u64 documents; per level u64 entries, the chunks, the bitmap padded to
whole blocks, the u64 directory; at the end the documents' first ids (u64, one more than documents), NULL marks (u8) and ids (i64).
"""

from __future__ import annotations

import os
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.batches import in_small_batches, text_slices
from folioloom.llm.tokens import with_end_id, word_bpe_path, worker_encoder
from folioloom.operators.skew import stored
from folioloom.session import new_table_path

MAGIC = b"DAC1"
BLOCK = 512
#: A file is closed at the first document end beyond so many ids. A document is never cut.
FILE_IDS = 4 << 20
#: Text bytes per range of documents, the unit of writing.
RANGE_BYTES = 24 << 20
MANIFEST = "file_name string, range int, part int, n_documents long, n_tokens long"


def packed(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, bitmap and directory of every level."""
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        goes_on = rest > 0xFF
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
        ones = np.bitwise_count(bits).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        levels.append(((rest & 0xFF).astype(np.uint8), bits, np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])))
        rest = rest[goes_on] >> 8
        if not len(rest):
            return levels


class TokenFile:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        levels, self.n_ids, self.n_documents = struct.unpack_from("<IQQ", data, 4)
        at, self.levels = 24, []

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        for _ in range(levels):
            n = int(take("<u8", 1)[0])
            blocks = -(-n // BLOCK)
            self.levels.append((take("u1", n), take("u1", blocks * (BLOCK // 8)), take("<u8", blocks + 1)))
        self.starts = take("<u8", self.n_documents + 1).astype(np.int64)
        self.missing = take("u1", self.n_documents).astype(bool)
        self.doc_ids = take("<i8", self.n_documents)

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids at `places`, in any order."""
        places = np.asarray(places, dtype=np.int64)
        out, where = np.zeros(len(places), dtype=np.uint32), np.arange(len(places))
        for k, (chunks, bits, directory) in enumerate(self.levels):
            out[where] |= chunks[places].astype(np.uint32) << np.uint32(8 * k)
            on = (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            where, places = where[on], places[on]
            if not len(places):
                break
            places = self._rank(bits, directory, places)
        return out

    def all_ids(self) -> np.ndarray:
        """The ids of the whole file in order; the entries that go on take those of the next level one after the other."""
        found = np.zeros(0, dtype=np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            ids = chunks.astype(np.uint32)
            ids[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))] |= found << np.uint32(8)
            found = ids
        return found

    @staticmethod
    def _rank(bits: np.ndarray, directory: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's count and the words of the place's own block."""
        words = bits.view("<u8")
        word, block = places >> 6, places // BLOCK
        ones = directory[block].astype(np.int64)
        for k in range(BLOCK // 64 - 1):
            other = block * (BLOCK // 64) + k
            ones += np.where(other < word, np.bitwise_count(words[other]), 0)
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return ones + np.bitwise_count(words[word] & below)

    def document(self, number: int) -> np.ndarray:
        return self.ids(np.arange(self.starts[number], self.starts[number + 1]))


def file_bytes(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    levels = packed(ids)
    parts = [MAGIC, struct.pack("<IQQ", len(levels), len(ids), len(lengths))]
    for chunks, bits, directory in levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), directory.astype("<u8").tobytes()]
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    missing = np.array([d is None for d in doc_ids], dtype=np.uint8)
    return b"".join([*parts, starts.tobytes(), missing.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes()])


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    if re.match(r"\w+:", folder):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return fs.LocalFileSystem(), os.path.abspath(folder)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the ids of all `doc_id`, `text` rows below `folder` and return the stored manifest, one row per file.

    Files follow ascending doc_id (NULL first; equal ones by text); NULL texts are empty and hold only `end_id`. Only files
    named in the manifest count: an attempt that was lost may leave another beside them. Other columns are ignored, and an
    empty table gives an empty manifest.
    """
    docs = in_small_batches(docs).select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = (docs.repartitionByRange(int(size // RANGE_BYTES) + 1, F.col("doc_id").asc_nulls_first())
               .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        files.create_dir(root, recursive=True)
        encoder, number, part = worker_encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        ids, lengths, doc_ids, n = [], [], [], 0

        def close() -> pa.RecordBatch:
            data, name = file_bytes(np.concatenate(ids), np.concatenate(lengths), doc_ids), f"{number:08d}-{part:06d}-{uuid.uuid4().hex}.dac"
            with files.open_output_stream(posixpath.join(root, name)) as out:
                out.write(data)
            return pa.RecordBatch.from_pydict({"file_name": [name], "range": pa.array([number], pa.int32()), "part": pa.array([part], pa.int32()),
                                               "n_documents": [len(doc_ids)], "n_tokens": [n]})

        for batch in text_slices(batches):
            more, counts = with_end_id(*encoder.encode(batch.column("text")), end_id)
            ids.append(more)
            lengths.append(counts)
            doc_ids += batch.column("doc_id").to_pylist()
            n += len(more)
            if n >= FILE_IDS:
                yield close()
                ids, lengths, doc_ids, n, part = [], [], [], 0, part + 1
        if doc_ids:
            yield close()

    return stored(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """`first_token`: the ids of all files before. Rows are files, so that each range's total is what is added up in one place."""
    within = Window.partitionBy("range").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = manifest.groupBy("range").agg(F.sum("n_tokens").alias("_all")).select("range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_base"))
    return manifest.join(ranges, "range").withColumn("first_token", F.col("_base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("_base")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. One file is open at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with files.open_input_stream(posixpath.join(root, row["file_name"])) as source:
                    found = TokenFile(source.read())
                data = memoryview(found.all_ids().astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a:4 * b]) for a, b in pairwise(found.starts.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.doc_ids, pa.int64(), mask=found.missing), pa.array(found.starts[:-1] + row["first_token"]), pa.array(np.diff(found.starts)),
                     pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = with_starts(manifest).select("file_name", "first_token")
    # A task per file: a few bytes per row would otherwise all end up in one.
    return placed.repartition(max(1, manifest.count())).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str, places: DataFrame) -> DataFrame:
    """Random access: `token` for each `place` (ids before it over all files) of `places`; places outside give no row."""
    spans = with_starts(manifest).select("file_name", "first_token", (F.col("first_token") + F.col("n_tokens")).alias("_stop"))
    step = FILE_IDS
    asked = places.select("place", F.floor(F.col("place") / step).alias("_step"))
    covered = spans.withColumn("_step", F.explode(F.sequence(F.floor(F.col("first_token") / step), F.floor((F.col("_stop") - 1) / step))))
    found = asked.join(covered, "_step").where("place >= first_token and place < _stop").select("place", "file_name", "first_token")

    def look(key, rows):
        import pandas as pd

        files, root = _opened(folder)
        with files.open_input_stream(posixpath.join(root, key[0])) as source:
            ids = TokenFile(source.read()).ids((rows["place"] - rows["first_token"]).to_numpy())
        return pd.DataFrame({"place": rows["place"], "token": ids.astype("int64")})

    return found.groupBy("file_name").applyInPandas(look, "place long, token long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded, written as directly addressable codes and read back."""
    folder = new_table_path(spark, "token-files")
    manifest = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, word_bpe_path(), 2)
    return read_token_files(manifest, folder)
