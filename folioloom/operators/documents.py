"""Documents as rows: pieces in order, and one document per group in bounded chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.config import Rendering
from folioloom.functions.paths import NUL, display
from folioloom.operators.order import (SLICE_BYTES, by_slice, in_document_order, number_rows, plan_slices, store_keys,
                                       with_carry, with_order_key)
from folioloom.operators.render import DRY_RUN_END, DRY_RUN_START, summary_head, with_blocks

CHUNK_BYTES = 64 << 20
FETCH_BYTES = 16 << 20
FETCHES = 1024  # no more partitions than that for smaller fetches than FETCH_BYTES
CHUNKS_PER_SLICE = 1 << 20  # distance of the chunk numbers of neighbouring slices

# Sections of a document in their order.
BLOCKS, HEAD, ITEMS = "0", "1", "2"


def _sectioned(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """Moves the section in front of the document order inside `_key`."""
    start = F.concat(F.col("_group"), F.lit(NUL)) if group else F.lit("")
    rest = F.substr(F.col("_key"), F.length(start) + 1)
    return rows.withColumn("_key", F.concat(start, F.col("section"), rest))


def keys_of(rows: DataFrame, group: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Stored keys and sizes of the rows, the only thing that is looked at twice."""
    return store_keys(with_order_key(rows, group, ties), *group)


def _heads(keys: DataFrame, group: Sequence[str]) -> DataFrame:
    """One summary head per group; the counts come from the stored keys, not from the content."""
    start = F.concat(F.col("_group"), F.lit(NUL)) if group else F.lit("")
    return (keys.groupBy(*group, "_group").agg(F.count("*").alias("n"))
            .select(*group, "_group", start.alias("_key"), F.lit(HEAD).alias("section"),
                    F.concat(summary_head(F.col("n")), F.lit("\n")).alias("text")))


def _body(processed: DataFrame, style: Rendering, group: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """`(group..., _group, _key, section, text)`: blocks, and with a summary its items, from one pass over the content."""
    rows = with_order_key(with_blocks(processed, style), group, ties)
    sections = [F.struct(F.lit(BLOCKS).alias("section"), F.col("block").alias("text"))]
    if style.summary:
        sections.append(F.struct(F.lit(ITEMS).alias("section"), F.concat("summary_line", F.lit("\n")).alias("text")))
    return rows.select(*group, "_group", "_key", F.inline(F.array(*sections)))


def pieces(processed: DataFrame, style: Rendering, keys: DataFrame, group: Sequence[str] = (),
           ties: Sequence[str] = ()) -> DataFrame:
    """`(group..., _group, _key, section, text)`: blocks, and with a summary its head and items. Every text ends with a newline."""
    body = _body(processed, style, group, ties)
    return _sectioned(body.unionByName(_heads(keys, group)) if style.summary else body, group)


def fetches(processed: DataFrame, style: Rendering, keys: DataFrame | None = None, ties: Sequence[str] = (),
            fetch_bytes: int = FETCH_BYTES) -> DataFrame:
    """`(section, text)` of a document without its summary head, a partition for each `fetch_bytes` about; the partitions in order hold the pieces in order.

    Every partition costs a task and a block of each task before the shuffle. So where small fetches would be more than `FETCHES`, they are larger, up to `FETCH_BYTES`.
    Nothing is numbered, and no pass over the content precedes the one that is fetched: `keys`, a metadata view of the rows or more, places the cuts.
    """
    weights = _piece_keys(keys_of(processed if keys is None else keys, ties=ties), style, ())
    total = weights.agg(F.sum("size")).first()[0] or 0
    slices = plan_slices(weights, slice_bytes=max(fetch_bytes, min(FETCH_BYTES, -(-total // FETCHES))))
    return in_document_order(_sectioned(_body(processed, style, (), ties), ()), slices).select("section", "text")


def _piece_keys(keys: DataFrame, style: Rendering, group: Sequence[str]) -> DataFrame:
    """`(_group, _key, size)` of the pieces; an item weighs little but there is one per file."""
    sections = [F.struct(F.lit(BLOCKS).alias("section"), F.col("size").alias("bytes"))]
    if style.summary:
        sections.append(F.struct(F.lit(ITEMS).alias("section"), F.lit(100).cast("bigint").alias("bytes")))
    rows = keys.select("_group", "_key", F.inline(F.array(*sections)))
    if style.summary:
        rows = rows.unionByName(_heads(keys, group).select("_group", "_key", "section", F.lit(0).cast("bigint").alias("bytes")))
    return _sectioned(rows, group).select("_group", "_key", F.col("bytes").alias("size"))


def document_rows(processed: DataFrame, style: Rendering, group: Sequence[str] = (), ties: Sequence[str] = (),
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """`(group..., position, text)`; the texts of a group in position order, concatenated, are its document."""
    keys = keys_of(processed, group, ties)
    piece_keys = _piece_keys(keys, style, group)
    slices = plan_slices(piece_keys, slice_bytes=slice_bytes)
    numbered = number_rows(pieces(processed, style, keys, group, ties), slices, piece_keys)
    return numbered.select(*group, "position",
                           set_off(F.col("text"), F.col("section"), F.col("position") > 1).alias("text"))


def set_off(text: Column, section: Column, preceded: Column) -> Column:
    """A blank line before a block or the summary head, when anything comes before it."""
    return F.when(preceded & (section != ITEMS), F.concat(F.lit("\n"), text)).otherwise(text)


def chunked_pieces(processed: DataFrame, group: Sequence[str], style: Rendering, chunk_bytes: int = CHUNK_BYTES,
                   slice_bytes: int = SLICE_BYTES, ties: Sequence[str] = ()) -> DataFrame:
    """`(group..., chunk, _slice, _group, _key, text)`: pieces set off by blank lines, with their group's chunk number.

    Groups below `chunk_bytes` are one chunk. Larger ones are cut into slices for the tasks to share and, inside a slice,
    into chunks of about `chunk_bytes`, so whatever collects or writes one chunk handles a bounded amount. The numbers
    ascend in document order and leave gaps where a slice begins.
    """
    keys = keys_of(processed, group, ties)
    piece_keys = _piece_keys(keys, style, group)
    slices = plan_slices(piece_keys, group_limit=chunk_bytes, slice_bytes=slice_bytes)
    rows = with_carry(by_slice(pieces(processed, style, keys, group, ties), slices), slices, piece_keys)
    later = (F.col("_slice") - F.col("_opened")).cast("bigint")
    within = Window.partitionBy("_slice", "_group").orderBy("_key")
    size = F.octet_length("text").cast("bigint")
    before = F.sum(size).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    preceded = (F.col("chunk") > 0) | (F.row_number().over(within) > 1)
    return (rows.withColumn("chunk", later * CHUNKS_PER_SLICE + F.floor(before / F.lit(chunk_bytes)))
            .withColumn("text", set_off(F.col("text"), F.col("section"), preceded)))


def group_documents(processed: DataFrame, group: Sequence[str], style: Rendering, chunk_bytes: int = CHUNK_BYTES,
                    slice_bytes: int = SLICE_BYTES, ties: Sequence[str] = ()) -> DataFrame:
    """`(group..., chunk, text)`: one document per group.

    A group below `chunk_bytes` is one row, chunk 0. A larger one comes as several chunks; concatenated in chunk order
    they are the whole document. That is the contract: a value stays small enough for one task, however large its group is.
    NULLs in `group` are values like others.
    """
    # The window has already put a slice's share of a group together, so this grouping adds no shuffle.
    parts = (chunked_pieces(processed, group, style, chunk_bytes, slice_bytes, ties).groupBy("_slice", "_group", "chunk")
             .agg(*[F.first(c).alias(c) for c in group], F.array_sort(F.collect_list(F.struct("_key", "text"))).alias("parts")))
    return parts.select(*group, "chunk", F.array_join("parts.text", "").alias("text"))


def dry_run_rows(files: DataFrame, style: Rendering, ties: Sequence[str] = ()) -> DataFrame:
    """`(position, text)` of the dry-run listing: marker, files in document order, marker."""
    items = store_keys(with_order_key(files, ties=ties), "relative_path").select(
        "_group", "_key", "size", F.concat(F.lit("- "), display(F.col("relative_path"), style.backticks)).alias("text"))
    marks = files.sparkSession.createDataFrame(
        [("", "", 0, DRY_RUN_START), ("", "~", 0, DRY_RUN_END)], "_group string, _key string, size bigint, text string")
    rows = items.unionByName(marks)
    numbered = number_rows(rows.drop("size"), plan_slices(items), rows)
    return numbered.select("position", F.concat("text", F.lit("\n")).alias("text"))
