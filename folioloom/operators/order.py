"""Document order at scale.

A global `orderBy` samples its input, so an expensive plan runs twice, and `row_number()` over everything or over a hot
group is one task. Both are avoided by cutting the key space into slices of about equal bytes. The cuts come from a
narrow pass over keys and sizes; afterwards a row's slice is a pure function of its key, so one shuffle orders the rows,
retried tasks agree with first attempts, and per-slice totals (one row per slice) turn slice-local numbers into global
ones.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions.paths import NUL, order_key
from folioloom.operators.skew import BROADCAST_BYTES, stored, stored_for_join
from folioloom.session import new_table_path

SLICE_BYTES = 256 << 20
#: Bounds, or totals of slices, that one expression may hold. More stand in stored tables, so that a plan stays small however many slices there are.
INLINE = 1024
_FAN = 32


def injective(column: Column) -> Column:
    """Text of a value that holds no NUL, tells NULL, `''` and all texts apart, and sorts like them, NULL first."""
    text = F.replace(F.replace(column.cast("string"), F.lit("\x01"), F.lit("\x01\x02")), F.lit(NUL), F.lit("\x01\x01"))
    return F.coalesce(F.concat(F.lit("\x02"), text), F.lit(""))


def group_key(columns: Sequence[str]) -> Column:
    """One string per combination of values, NULLs included; the mark between two values occurs in none."""
    return F.concat_ws("\x01\x03", *[injective(F.col(c)) for c in columns]) if columns else F.lit("")


def with_order_key(rows: DataFrame, group: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Adds `_group` and `_key`; the byte order of `_key` is group, then document order, then `ties`.

    Where one path occurs many times, name columns in `ties` that tell the copies apart, so that they spread too. Two NULs set ties
    off, so they sort before everything below the path; NULL is a tie value like others.
    """
    last = F.col("is_process_last") if "is_process_last" in rows.columns else F.lit(False)
    order = F.col("process_last_order") if "process_last_order" in rows.columns else F.lit(None).cast("int")
    key = order_key(F.col("relative_path"), last, order)
    for column in ties:
        key = F.concat(key, F.lit(NUL + NUL), injective(F.col(column)))
    name = group_key(group)
    return rows.withColumn("_group", name).withColumn("_key", F.concat(name, F.lit(NUL), key) if group else key)


def store_keys(keyed: DataFrame, *columns: str) -> DataFrame:
    """Write `_group`, `_key`, `size` and the named columns once, and read that narrow table from then on.

    Placing cuts and counting slices take a few passes; this way none of them repeats the scan, tests and joins behind
    `keyed`, and all see the same rows even when an executor is lost in between.
    """
    path = new_table_path(keyed.sparkSession, "keys")
    narrow = keyed.select(*columns, "_group", "_key", F.col("size").cast("bigint").alias("size"))
    narrow.write.parquet(path)
    return keyed.sparkSession.read.schema(narrow.schema).parquet(path)


@dataclass(frozen=True)
class Slices:
    """Ascending lower bounds of every slice but the first, and the stored levels of them that plans look up."""

    bounds: tuple[str, ...] = ()
    levels: dict[int, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @property
    def count(self) -> int:
        return len(self.bounds) + 1


def plan_slices(keys: DataFrame, group_limit: int | None = None, slice_bytes: int = SLICE_BYTES,
                at_least: int | None = None) -> Slices:
    """Cut `(_key, size)` rows into slices of about `slice_bytes`, at least `at_least` when the data allow.

    With `group_limit`, a slice never cuts into a group (the key's text before the first NUL) until that group alone
    fills about `group_limit` bytes. The driver sees a few rows per slice, never a row per file.
    """
    at_least = at_least or keys.sparkSession.sparkContext.defaultParallelism
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    wanted = min(max(at_least, -(-(total or 0) // slice_bytes)), max(rows, 1))
    if wanted <= 1:
        return Slices()
    fine = 4 * wanted
    pieces = (keys.select("_key", "size").repartitionByRange(fine, "_key")
              .groupBy(F.spark_partition_id().alias("piece"))
              .agg(F.min("_key").alias("start"), F.sum("size").alias("size"))
              .orderBy("piece").toLocalIterator())
    step = max(1, (total or 0) / wanted)
    bounds, since, in_group, last_group = [], 0, 0, None
    for piece in pieces:
        group = piece.start.split(NUL, 1)[0] if group_limit is not None else None
        if since >= step:
            if group_limit is None:
                bound = piece.start
            elif group != last_group:
                bound, in_group = group + NUL, 0
            else:
                bound = piece.start if in_group >= group_limit else None
            if bound is not None and (not bounds or bound > bounds[-1]):
                bounds.append(bound)
                since, last_group = 0, group
                in_group = 0
        since += piece.size
        in_group += piece.size
    return Slices(tuple(bounds))


def _texts(values: Sequence[str]) -> Column:
    """Literal string array; one JSON literal that the optimizer folds, whatever its length."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def _level(rows: DataFrame, slices: Slices, step: int) -> DataFrame:
    """Every `step`-th bound as a stored table, `_FAN` of them a row: `_node`, `_marks`. Marked for broadcast if its size allows."""
    if step not in slices.levels:
        marks = slices.bounds[step - 1::step]
        nodes = [(at // _FAN, list(marks[at:at + _FAN])) for at in range(0, len(marks), _FAN)]
        table = stored(rows.sparkSession.createDataFrame(nodes, "_node int, _marks array<string>"), "bounds")
        small = sum(len(m.encode()) + 40 for m in marks) + 200 * len(nodes) <= BROADCAST_BYTES
        slices.levels[step] = F.broadcast(table) if small else table
    return slices.levels[step]


def with_slice(rows: DataFrame, slices: Slices) -> DataFrame:
    """Adds `_slice`, the number of bounds at or below `_key`, found level by level with a fan-out of 32.

    The upper levels are literals; a level of over `INLINE` bounds is a small table, joined by the node that the level above has led to.
    """
    rows = rows.withColumn("_slice", F.lit(0))
    step = 1
    while step * _FAN < len(slices.bounds):
        step *= _FAN
    while step and slices.bounds:
        marks = slices.bounds[step - 1::step]
        at = F.col("_slice")
        if len(marks) > INLINE:
            rows = rows.join(_level(rows, slices, step), (at / (step * _FAN)).cast("int") == F.col("_node"), "left")
            window = F.coalesce("_marks", F.array().cast("array<string>"))
        else:
            window = F.slice(_texts(marks), (at / step).cast("int") + 1, _FAN)
        below = F.size(F.filter(window, lambda b: b <= F.col("_key")))
        if marks:
            rows = rows.withColumn("_slice", at + below * step).drop("_node", "_marks")
        step //= _FAN
    return rows


def by_slice(rows: DataFrame, slices: Slices) -> DataFrame:
    """One partition per slice, in slice order; nothing is sampled from `rows`."""
    return with_slice(rows, slices).repartitionById(slices.count, F.col("_slice"))


def in_document_order(rows: DataFrame, slices: Slices) -> DataFrame:
    """`by_slice`, sorted inside: the partitions in order hold the rows in order."""
    return by_slice(rows, slices).sortWithinPartitions("_key")


def sort_files(rows: DataFrame, ties: Sequence[str] = (), keys: DataFrame | None = None) -> DataFrame:
    """The rows in document order. `keys` may be a metadata view of them, to place the cuts without reading content."""
    slices = plan_slices(store_keys(with_order_key(rows if keys is None else keys, ties=ties)))
    return in_document_order(with_order_key(rows, ties=ties), slices).drop("_group", "_key", "_slice")


def _carried(sliced: DataFrame) -> DataFrame:
    """For each slice that goes on with a group of earlier ones, one row: `_at`, `_of` (the group), `_rows` of it before, `_first` slice of it."""
    per_group = sliced.groupBy("_slice", "_group").agg(F.count("*").alias("n"))
    group = Window.partitionBy("_group")
    before = F.sum("n").over(group.orderBy("_slice")) - F.col("n")
    return (per_group.select(F.col("_slice").alias("_at"), F.col("_group").alias("_of"), before.alias("_rows"), F.min("_slice").over(group).alias("_first"))
            .where("_at > _first"))


def with_carry(rows: DataFrame, slices: Slices, keys: DataFrame) -> DataFrame:
    """Adds to rows that have a `_slice` what it must know of those before it: `_before`, rows of the group there, and `_opened`, the group's first slice.

    Few totals become literals. Many are a table, which the rows are joined with where they are as long as it fits a broadcast.
    """
    found = _carried(with_slice(keys, slices))
    if slices.count > INLINE:
        rows = rows.join(stored_for_join(found, "carry"), (F.col("_slice") == F.col("_at")) & (F.col("_group") == F.col("_of")), "left")
        before, opened = F.col("_rows"), F.col("_first")
    else:
        at = {row._at: row for row in found.collect()}
        of, totals, firsts = ([at[k][name] if k in at else none for k in range(slices.count)]
                              for name, none in (("_of", None), ("_rows", 0), ("_first", 0)))
        goes_on = F.col("_group") == F.get(_texts(of), F.col("_slice"))
        before, opened = (F.when(goes_on, F.get(F.from_json(F.lit(json.dumps(v)), "array<bigint>"), F.col("_slice"))) for v in (totals, firsts))
    return rows.withColumns({"_before": F.coalesce(before, F.lit(0)), "_opened": F.coalesce(opened, F.col("_slice"))}).drop("_at", "_of", "_rows", "_first")


def number_rows(rows: DataFrame, slices: Slices, keys: DataFrame) -> DataFrame:
    """Adds `position`, the 1-based place of every row in its group's document order.

    `keys` holds the `_group` and `_key` of the same rows, from `store_keys`. The rows are dealt out by the planned slices, so the window
    sorts a slice at a time whatever the session's number of shuffle partitions.
    """
    within = Window.partitionBy("_slice", "_group").orderBy("_key")
    place = F.row_number().over(within) + F.col("_before")
    placed = with_carry(by_slice(rows, slices), slices, keys)
    return placed.withColumn("position", place.cast("bigint")).drop("_slice", "_before", "_opened")
