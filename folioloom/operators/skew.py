"""Joins of large, possibly lopsided tables with smaller ones whose keys are unique."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from folioloom.session import new_table_path, remove_table

BROADCAST_BYTES = 64 << 20


def stored(table: DataFrame, name: str) -> DataFrame:
    """Write a narrow table once and read it from then on."""
    path = new_table_path(table.sparkSession, name)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete what `stored` wrote, after its last use. Only folders below the session's scratch space are touched."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            remove_table(table.sparkSession, folder)


def _width(table: DataFrame) -> Column:
    """Bytes of a row in a hash relation, about: its texts, and 16 for each column beside what any row takes."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if f.dataType in (StringType(), BinaryType())]
    return sum(texts, F.lit(100 + 16 * len(table.columns)))


def stored_for_join(table: DataFrame, name: str) -> DataFrame:
    """Like `stored`, and marked for broadcast if the size measured while writing allows."""
    path, seen = new_table_path(table.sparkSession, name), Observation()
    table.observe(seen, F.sum(_width(table)).alias("bytes")).write.parquet(path)
    found = table.sparkSession.read.schema(table.schema).parquet(path)
    return F.broadcast(found) if (seen.get["bytes"] or 0) <= BROADCAST_BYTES else found


def fits_broadcast(table: DataFrame) -> bool:
    """Whether a stored table is small enough for every executor, by its measured size."""
    size = table.agg(F.sum(_width(table))).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def filter_by(rows: DataFrame, unique: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi- or anti-join with a stored table. When that fits a broadcast, the content stays where it is.

    Otherwise both sides are shuffled by plain scans or rows, so adaptive execution can split a hot key by its map outputs.
    """
    return rows.join(F.broadcast(unique) if fits_broadcast(unique) else unique, [*keys], how)
