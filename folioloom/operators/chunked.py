"""Classification, counts and blocks of files that come in chunks (`sources.chunks`), equal to those of whole values.

Every chunk yields a small state of its own; states of a file merge by sums and ors, so partial aggregation does most of it. A word belongs to the chunk it begins
in, which the bytes before the chunk tell. Content filters need whole values and are not offered here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.config import Processing, Rendering
from folioloom.functions import paths
from folioloom.functions import text as T
from folioloom.operators.content import filter_chain
from folioloom.operators.render import header_path
from folioloom.operators.skew import fits_broadcast, stored

_KEY = "relative_path"


def chunk_states(chunks: DataFrame) -> DataFrame:
    """`relative_path`, `chunk`, `newlines` and what else the chunk adds to its file's text test and counts."""
    raw, text = F.col("content"), T.decode(F.col("content"))
    head = F.substring(raw, F.lit(1), F.greatest(F.lit(0), T.HEAD_BYTES - F.col("start")).cast("int"))
    goes_on = T.ends_in_word(T.decode(F.col("before"))) & T.begins_with_word(text)
    ends = F.col("start") + F.octet_length(raw) == F.col("size")  # the chunk after it may be empty
    return chunks.select(
        _KEY, "chunk", "size", ((F.col("start") == 0) & F.startswith(raw, F.lit(b"\xef\xbb\xbf"))).alias("bom"),
        (F.contains(head, F.lit(b"\x00")) | (F.col("start") == 0) & F.startswith(raw, F.lit(b"%PDF"))).alias("marked"), F.is_valid_utf8(raw.cast("string")).alias("valid"),
        T.newlines(text).alias("newlines"), (ends & (text != "") & ~F.endswith(text, F.lit("\n"))).alias("open"),
        F.octet_length(text).cast("bigint").alias("bytes"), (T.word_count(text) - goes_on.cast("int")).alias("words"))


def file_states(states: DataFrame) -> DataFrame:
    """`relative_path`, `is_binary`, `counts`, and `lines` of the decoded text, of every file."""
    merged = states.groupBy(_KEY).agg(
        F.max("size").alias("size"), (F.bool_or("bom") | ~F.bool_or("marked") & F.bool_and("valid")).alias("is_text"),
        (F.sum("newlines") + F.bool_or("open").cast("int")).alias("lines"), F.sum("bytes").alias("bytes"), F.sum("words").alias("words"))

    def number(name: str, binary: Column) -> Column:
        return F.when(F.col("is_text"), F.col(name)).otherwise(binary).cast("bigint")

    counts = F.struct(number("lines", F.lit(0)).alias("lines"), number("bytes", F.col("size")).alias("characters"), number("words", F.lit(0)).alias("words"))
    return merged.select(_KEY, (~F.col("is_text")).alias("is_binary"), counts.alias("counts"), "lines")


def process_chunks(chunks: DataFrame, processing: Processing) -> tuple[DataFrame, DataFrame]:
    """`(files, texts)`: state and counts of each file that is kept, and its decoded chunks.

    `chunks` is read twice: once for the states, which are stored, once for the texts. Options with content filters raise ValueError.
    """
    if filter_chain(processing):
        raise ValueError("content filters need whole values, not chunks")
    states = stored(chunk_states(chunks), "chunk-states")
    files = file_states(states)
    files = stored(files if processing.include_binary else files.where("not is_binary"), "chunked-files")
    before = F.sum("newlines").over(Window.partitionBy(_KEY).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    lines = stored(states.select(_KEY, "chunk", "open", (F.coalesce(before, F.lit(0)) + 1).alias("first_line")), "first-lines")
    texts = chunks.withColumn("text", T.decode(F.col("content"))).withColumn("line_open", F.length("before") > 0)
    texts = texts.withColumn("line_open", F.col("line_open") & ~F.endswith(F.col("before"), F.lit(b"\n"))).drop("content", "before")
    small = files.select(_KEY, "lines")
    return files, texts.join(F.broadcast(small) if fits_broadcast(small) else small, _KEY).join(F.broadcast(lines) if fits_broadcast(lines) else lines, [_KEY, "chunk"])


def _numbered(text: Column) -> Column:
    width = F.greatest(F.lit(T.MIN_NUMBER_WIDTH), F.length(F.col("lines").cast("string")))
    parts = F.split(text, "\n", -1)

    def line(part: Column, at: Column) -> Column:
        bare = ((at == 0) & F.col("line_open")) | ((at == F.size(parts) - 1) & (part == ""))
        return F.when(bare, part).otherwise(F.concat(F.lpad((F.col("first_line") + at).cast("string"), width, " "), F.lit(" | "), part))

    return F.array_join(F.transform(parts, line), "\n")


def chunked_blocks(texts: DataFrame, style: Rendering) -> DataFrame:
    """`relative_path`, `chunk` and `piece`: the pieces of a file, in order, are its block."""
    path, fence = F.col(_KEY), F.lit("`" * style.ticks)
    head = F.concat(F.lit("## File: "), header_path(path, style), F.lit("\n"), fence, F.coalesce(paths.extension(path), F.lit("")), F.lit("\n"))
    plain = F.replace(F.col("text"), F.lit("\r\n"), F.lit("\n"))
    return texts.select(_KEY, "chunk", F.concat(
        F.when(F.col("chunk") == 0, head).otherwise(""), _numbered(plain) if style.line_numbers else plain,
        F.when(F.col("open"), "\n").otherwise(""), F.when(F.col("chunk") == F.col("chunks") - 1, F.concat(fence, F.lit("\n"))).otherwise("")).alias("piece"))
