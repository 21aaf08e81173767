"""Tables of paths and content as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def corpus_from_table(table: DataFrame, path: str | Column = "relative_path", content: str | Column = "content",
                      keep: tuple[str, ...] = (), size: str | Column | None = None) -> DataFrame:
    """`(relative_path, absolute_path, content binary, size)` plus the kept columns.

    Rows never touched a file system, so both paths are the same. `size` names a column with the content's length in bytes: then passes over
    keys and sizes do not read the content. Without it the length is measured. Columns
    `is_process_last` and `process_last_order` are carried along when the table has them.
    """
    own = {"relative_path", "absolute_path", "content", "size"}
    carried = [c for c in ("is_process_last", "process_last_order", *keep) if c in table.columns and c not in own]
    raw = _column(content).cast("binary")
    return table.select(
        _column(path).alias("relative_path"),
        _column(path).alias("absolute_path"),
        raw.alias("content"),
        (F.octet_length(raw) if size is None else _column(size)).cast("bigint").alias("size"),
        *carried,
    )
