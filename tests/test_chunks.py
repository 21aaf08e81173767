import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioloom import Processing, Rendering
from folioloom.operators.chunked import chunked_blocks, process_chunks
from folioloom.operators.content import process_content
from folioloom.operators.render import with_blocks
from folioloom.sources import chunks as chunk_source
from folioloom.sources.chunks import read_chunks
from folioloom.sources.files import list_files, read_contents

PIECES = [b"a", b"word ", b"\n", b"\r\n", b"\r", b" ", "é".encode(), " ".encode(), "　".encode(), "日本".encode(), "😀".encode(), b"\x80", b"\xe2\x80", b"\xf0\x9f\x98", b"\xc3", b"\x80\x80\x80\x80",
          b"\xed\xa0\x80", b"\xff", "\x85".encode()]
CLEAN = [p for p in PIECES if p.decode(errors="replace").encode() == p]


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """Random bytes, random text, and every reason for the text test, from nothing to some thousand bytes."""
    rng, root = random.Random(6), tmp_path_factory.mktemp("files")
    contents = [b"", b"\n", b"\r\n", b"x", b"a\n" * 40, b"word" * 30, "😀".encode() * 60, b"\x80" * 70, b"\r" * 50 + b"\n" * 20, b"%PDF-" + b"a" * 40, b"\xef\xbb\xbf" + b"\xff a\n" * 30,
                b"x" * 1000 + b"\x00" + b"y" * 50, b"x" * 1030 + b"\x00" + b"y\n" * 50, b"a" * 15 + b"%PDF", b"b" * 16 + b"\xef\xbb\xbf" + b"\xff", b"line\n" * 30_000]
    for pieces in (PIECES, CLEAN):
        contents += [b"".join(rng.choices(pieces, k=rng.randrange(1, 120))) for _ in range(60)]
    for k, content in enumerate(contents):
        (root / f"f{k:03d}.x").write_bytes(content)
    return list_files(spark, str(root)).cache()


@pytest.mark.parametrize("binaries, chunk_bytes", [(True, 16), (False, 16), (True, 37), (True, 1 << 20)])
def test_chunks_are_the_whole(spark, files, binaries, chunk_bytes):
    options = Processing(counts=True, include_binary=binaries)
    whole = process_content(read_contents(files).drop("error"), options)
    want = {r.relative_path: (r.is_binary, tuple(r.counts)) for r in whole.collect()}
    chunks = read_chunks(files, chunk_bytes).drop("error")
    found, texts = process_chunks(chunks, options)
    assert {r.relative_path: (r.is_binary, tuple(r.counts)) for r in found.collect()} == want
    for style in (Rendering(), Rendering(line_numbers=True, backticks=True, filename_only=True)):
        blocks = {}
        for r in chunked_blocks(texts, style).orderBy("relative_path", "chunk").collect():
            blocks[r.relative_path] = blocks.get(r.relative_path, "") + r.piece
        assert blocks == {r.relative_path: r.block for r in with_blocks(whole, style).collect()}


def test_chunks_cover_the_bytes(files):
    chunks = read_chunks(files, 16).orderBy("relative_path", "chunk").collect()
    parts = {}
    for r in chunks:
        assert r.start == len(parts.get(r.relative_path, b"")) and r.before == parts.get(r.relative_path, b"")[-4:]
        parts[r.relative_path] = parts.get(r.relative_path, b"") + r.content
    for r in files.collect():
        with open(r.absolute_path, "rb") as f:
            assert parts[r.relative_path] == f.read()
    assert max(len(r.content) for r in chunks) <= 16 + 4


def test_options_and_errors(spark, files):
    with pytest.raises(ValueError):
        read_chunks(files, 15)
    with pytest.raises(ValueError):
        process_chunks(read_chunks(files), Processing(remove_comments=True))
    gone = files.where("relative_path in ('f003.x', 'f004.x')").withColumn("size", F.when(F.col("relative_path") == "f004.x", 500).otherwise(F.col("size")))
    rows = read_chunks(gone, 100, on_error="keep").collect()
    assert sum(r.error is not None for r in rows) >= 4 and sum(r.error is None for r in rows) >= 1
    with pytest.raises(Exception, match="shorter"):
        read_chunks(gone, 100).collect()
    assert read_chunks(files.limit(0)).count() == 0


def test_small_chunks_travel_together(tmp_path):
    """Thousands of chunks of few bytes are a few batches, and a batch holds some megabytes."""
    (tmp_path / "small").write_bytes(b"some words\n" * 5_000)
    (tmp_path / "large").write_bytes(b"some words\n" * 2_000_000)
    for name, chunk_bytes in (("small", 20), ("large", 1 << 20)):
        whole = (tmp_path / name).read_bytes()
        count = -(-len(whole) // chunk_bytes)
        rows = pa.RecordBatch.from_pydict({"absolute_path": [str(tmp_path / name)] * count, "chunk": list(range(count)), "chunks": [count] * count, "size": [len(whole)] * count})
        batches = list(chunk_source._reader(chunk_bytes, True)(iter([rows])))
        assert b"".join(c for batch in batches for c in batch["content"].to_pylist()) == whole and [k for batch in batches for k in batch["chunk"].to_pylist()] == list(range(count))
        assert len(batches) < 10 and max(batch["content"].nbytes for batch in batches) < 8 << 20
