"""Classification, counts and cleaning of content rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioloom.config import Processing, TextFilter
from folioloom.functions import text as T


def python_filter(apply: Callable[[str], str], name: str | None = None) -> TextFilter:
    """Wrap a plain `str -> str` function; rows reach it in Arrow batches."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(apply, na_action="ignore")

    def column_filter(text: Column) -> Column:
        return run(text)

    column_filter.__name__ = name or getattr(apply, "__name__", "python_filter")
    return column_filter


def filter_chain(processing: Processing) -> list[TextFilter]:
    """Own filters in order, then comments, then empty lines."""
    chain = list(processing.filters)
    if processing.remove_comments:
        chain.append(T.remove_comments)
    if processing.remove_empty_lines:
        chain.append(T.remove_empty_lines)
    return chain


def process_content(corpus: DataFrame, processing: Processing) -> DataFrame:
    """Adds `is_binary`, `counts` (of the original content) and `processed_content`; drops `content`.

    Narrow and stateless, so batch and stream share it. Binary rows are dropped unless asked for; they skip the filters.
    """
    raw = F.col("content").cast("binary")
    if processing.include_binary:
        rows = corpus.withColumn("is_binary", ~T.is_text(raw))
    else:
        # The test runs once, in the filter; what is left is text.
        rows = corpus.where(T.is_text(raw)).withColumn("is_binary", F.lit(False))
    rows = rows.withColumn("_text", T.decode(raw))
    text = F.col("_text")
    cleaned = reduce(lambda column, step: step(column), filter_chain(processing), text)
    count_type = "struct<lines:bigint,characters:bigint,words:bigint>"
    if not processing.counts:
        counted = F.lit(None).cast(count_type)
    elif processing.include_binary:
        counted = F.when(F.col("is_binary"), T.binary_counts(raw)).otherwise(T.counts(text))
    else:
        counted = T.counts(text)
    if processing.include_binary:
        cleaned = F.when(F.col("is_binary"), text).otherwise(cleaned)
    return (rows.withColumn("counts", counted).withColumn("processed_content", cleaned).drop("content", "_text"))


def split_errors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(good, quarantined)` by the `error` column of the file reader."""
    return rows.where("error is null").drop("error"), rows.where("error is not null")
