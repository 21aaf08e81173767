"""Listing a file tree under its own ignore rules, without entering what they ignore.

The tree is walked a level at a time. Folders of a level are listed by tasks; the ignore files among the entries are read and join the rules found so far;
an entry is then judged by the rules of the folders at or above it, which each folder carries along. Ignored folders drop out before the next
level is listed, so `node_modules` costs one entry, whatever lies in it. Everything stays in tables: the driver learns whether another level, and
whether any rule, exists.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import paths
from folioloom.operators.ignore import RULE_FILES, Rule, override_rules, prepared_rules, rules_from_corpus, verdicts
from folioloom.operators.skew import fits_broadcast, stored
from folioloom.session import mounted_path, new_table_path
from folioloom.sources.files import entry_batches, list_files, read_contents

_ENTRY = "absolute_path string, relative_path string, size bigint, is_dir boolean, error string, bases array<string>"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, relative, bases in zip(*(batch[c].to_pylist() for c in ("absolute_path", "relative_path", "bases")), strict=True):
            for entries in entry_batches(folder, relative):
                yield entries.append_column("bases", pa.array([bases] * entries.num_rows, pa.list_(pa.string())))


def _judged(entries: DataFrame, rules: DataFrame) -> DataFrame:
    """The entries that no rule ignores; those that cannot be read stay."""
    below = entries.where("error is null and size(bases) > 0").select(F.col("relative_path").alias("node"), "is_dir", "bases")
    gone = stored(verdicts(below, F.broadcast(rules) if fits_broadcast(rules) else rules).select(F.col("node").alias("relative_path")), "ignored-entries")
    return entries.join(F.broadcast(gone) if fits_broadcast(gone) else gone, "relative_path", "left_anti")


def list_unignored(spark: SparkSession, root: str, recursive: bool = True, prune: Callable[[Column], Column] | None = None,
                   outer: Sequence[Rule] = (), last: Sequence[str] | None = None) -> DataFrame:
    """`(absolute_path, relative_path, size, error)` of the files below `root` that neither the ignore files of the tree nor `outer` rules ignore.

    `prune(relative_path)` marks more folders that are not entered, `last` patterns bring files back. Entries that cannot be read keep their
    row, with `error` set and no size. An ignore file that cannot be read has no rules.
    """
    root = os.path.abspath(mounted_path(root))
    if not os.path.isdir(root):
        return list_files(spark, root)
    given = [*map(tuple, outer), *override_rules(last)]
    rules = prepared_rules(spark.createDataFrame(given, "kind string, base string, seq int, pattern string")) if given else None
    table, width, level = new_table_path(spark, "listing"), spark.sparkContext.defaultParallelism, 0
    frontier = spark.createDataFrame([(root, "", [""] if given else [])], "absolute_path string, relative_path string, bases array<string>")
    while True:
        entries = stored(frontier.repartition(width, "relative_path").mapInArrow(_list_folders, _ENTRY), "entries")
        files = entries.where(paths.basename(F.col("relative_path")).isin(*RULE_FILES) & ~F.col("is_dir") & F.col("error").isNull()).drop("bases", "is_dir")
        if not files.isEmpty():
            found = prepared_rules(rules_from_corpus(read_contents(files, on_error="keep").where("error is null")))
            rules = found if rules is None else rules.unionByName(found)
            bases = stored(found.select(F.col("base").alias("_base")).distinct(), "rule-folders")
            parent = paths.dirname(F.col("relative_path"))
            entries = entries.join(F.broadcast(bases) if fits_broadcast(bases) else bases, parent == F.col("_base"), "left")
            entries = entries.withColumn("bases", F.when(F.col("_base").isNull(), F.col("bases")).otherwise(F.array_union("bases", F.array("_base")))).drop("_base")
        kept = entries if rules is None else _judged(entries, rules)
        if prune is not None:
            kept = kept.where(~(F.col("is_dir") & prune(F.col("relative_path"))))
        # A written level is the cut in the lineage: losing an executor repeats one level at most.
        kept.select("absolute_path", "relative_path", "size", "is_dir", "error", "bases").write.parquet(f"{table}/level={level}")
        frontier = spark.read.schema(_ENTRY).parquet(f"{table}/level={level}").where("is_dir").select("absolute_path", "relative_path", "bases")
        if not recursive or frontier.isEmpty():
            break
        level += 1
    listed = spark.read.schema(_ENTRY).parquet(*[f"{table}/level={n}" for n in range(level + 1)])
    return listed.where("not is_dir").drop("is_dir", "bases")
