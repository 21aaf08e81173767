"""Blocks and summary lines: one string column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.config import Rendering
from folioloom.functions import paths
from folioloom.functions import text as T

# The wording of documents, summaries and dry runs.
MISSING_CONTENT = "// Content not available\n"
SUMMARY_SEPARATOR = "---"
SUMMARY_TITLE = "Processed Files"
DRY_RUN_START = "\n--- Dry Run: Files that would be processed ---"
DRY_RUN_END = "--- End Dry Run ---"


def header_path(path: Column, style: Rendering) -> Column:
    return paths.display(paths.basename(path) if style.filename_only else path, style.backticks)


def block(path: Column, content: Column, style: Rendering) -> Column:
    """Header, fence with the extension as language hint, lines, fence; ends with a newline."""
    fence = F.lit("`" * style.ticks)
    body = T.numbered(content) if style.line_numbers else T.terminated(content)
    return F.concat(
        F.lit("## File: "), header_path(path, style), F.lit("\n"),
        fence, F.coalesce(paths.extension(path), F.lit("")), F.lit("\n"),
        F.when(content.isNull(), F.lit(MISSING_CONTENT)).otherwise(body),
        fence, F.lit("\n"),
    )


def summary_line(path: Column, counts: Column, is_binary: Column, style: Rendering) -> Column:
    item = F.concat(F.lit("- "), paths.display(path, style.backticks))
    if not style.counts:
        return item
    number = lambda name: counts[name].cast("string")
    tail = (F.when(counts.isNull(), F.lit(" (Counts not available)"))
            .when(is_binary, F.concat(F.lit(" (Binary C:"), number("characters"), F.lit(")")))
            .otherwise(F.concat(F.lit(" (L:"), number("lines"), F.lit(" C:"), number("characters"),
                                F.lit(" W:"), number("words"), F.lit(")"))))
    return F.concat(item, tail)


def with_blocks(processed: DataFrame, style: Rendering) -> DataFrame:
    """Adds `block`, and `summary_line` when the summary is on."""
    rows = processed.withColumn("block", block(F.col("relative_path"), F.col("processed_content"), style))
    if style.summary:
        rows = rows.withColumn("summary_line", summary_line(
            F.col("relative_path"), F.col("counts"), F.col("is_binary"), style))
    return rows


def summary_head(count: Column) -> Column:
    return F.concat(F.lit(f"{SUMMARY_SEPARATOR}\n{SUMMARY_TITLE}: ("), count.cast("string"), F.lit(")"))
