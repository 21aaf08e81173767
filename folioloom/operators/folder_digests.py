"""Snapshots as digests of folders, compared from the root down.

Every file and folder of a corpus is a row with the digest of all that lies below it. Two snapshots are compared level by level, and only
children of folders whose digests differ are read, so an unchanged subtree costs nothing and content is never read again.

A digest is the number of files and the sums of six parts of their hashes (path and content). Sums are combined before the shuffle and a
folder's are those of its children, so no folder, however large, is ever collected. They detect changes; they are no defence
against someone who constructs texts of equal sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import paths
from folioloom.operators.skew import drop_stored, filter_by, stored

#: Parts of a hash and hexadecimal digits of each: sums of 28 bits stay below 2^63 for 3 * 10^10 files.
_LANES, _DIGITS = 6, 7
_SUMS = ("files", *(f"lane_{k}" for k in range(_LANES)))
_ENTRY = "parent string, path string, is_folder boolean, digest string, parts int, part int"
#: Number of the folder that the root's own row is stored in.
_ROOT_PART = -1


def _part(parent: Column, parts: int) -> Column:
    """Children of a folder lie in one part."""
    return F.pmod(F.xxhash64(parent), F.lit(parts)).cast("int")


def _hashed(corpus: DataFrame, content: str) -> DataFrame:
    """`path` and sums of each file. A path that repeats stands for the set of its contents; NULL paths are no files."""
    known = corpus.where("relative_path is not null").select(
        F.col("relative_path").alias("path"), F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("_content")).distinct()
    digest = F.sha2(F.concat("path", F.lit(paths.NUL), "_content"), 256)
    lanes = [F.conv(F.substr("_digest", F.lit(1 + k * _DIGITS), F.lit(_DIGITS)), 16, 10).cast("long").alias(f"lane_{k}") for k in range(_LANES)]
    return _summed(known.withColumn("_digest", digest).select("path", F.lit(1).cast("long").alias("files"), *lanes), "path")


def _summed(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(*[F.sum(name).alias(name) for name in _SUMS])


def write_snapshot(corpus: DataFrame, path: str, content: str = "content", parts: int = 64) -> None:
    """Write the digests of `corpus` (relative_path, content) to the new folder `path`; other columns are ignored.

    One pass reads the content. `parts` is the number of pieces that a comparison can leave unread; snapshots to be compared must
    agree in it. An empty corpus has a root without files.
    """
    files = stored(_hashed(corpus, content), "file-sums")
    own = _summed(files.withColumn("path", paths.dirname(F.col("path"))), "path")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.when(F.col("path") != "", paths.prefixes(F.col("path"))).otherwise(F.array().cast("array<string>"))))
    folders = _summed(own.select(F.explode(above).alias("path"), *_SUMS), "path")

    def entries(rows: DataFrame, is_folder: bool) -> DataFrame:
        parent = paths.dirname(F.col("path"))
        part = F.when(F.lit(is_folder) & (F.col("path") == ""), _ROOT_PART).otherwise(_part(parent, parts))
        return rows.select(parent.alias("parent"), "path", F.lit(is_folder).alias("is_folder"), F.concat_ws("-", *_SUMS).alias("digest"), F.lit(parts).alias("parts"), part.alias("part"))

    # Rebalancing lets adaptive execution split the part of a folder that holds most files.
    entries(files, False).unionByName(entries(folders, True)).hint("rebalance", "part").write.partitionBy("part").parquet(path)
    drop_stored(files)


def _children(spark: SparkSession, path: str, frontier: DataFrame, parts: list[int], name: str) -> DataFrame:
    rows = spark.read.schema(_ENTRY).parquet(path).where(F.col("part").isin(*parts) & ~((F.col("path") == "") & F.col("is_folder")))
    return filter_by(rows, frontier, ["parent"], "left_semi").select("path", "is_folder", F.col("digest").alias(name))


def _root(spark: SparkSession, path: str) -> tuple[str | None, int | None]:
    row = spark.read.schema(_ENTRY).parquet(path).where(F.col("part") == _ROOT_PART).first()
    return (row.digest, row.parts) if row else (None, None)


def compare_snapshots(spark: SparkSession, old: str, new: str) -> DataFrame:
    """`(relative_path, change)` of the files that are not the same: `added`, `changed` or `deleted`.

    One step for each level that holds a difference. The driver learns numbers of parts, never paths.
    """
    (before, old_parts), (after, new_parts) = _root(spark, old), _root(spark, new)
    if None not in (old_parts, new_parts) and old_parts != new_parts:
        raise ValueError("the snapshots were written with different numbers of parts")
    schema = "relative_path string, change string"
    if before == after:
        return spark.createDataFrame([], schema)
    parts = old_parts or new_parts
    frontier, found = stored(spark.createDataFrame([("",)], "parent string"), "frontier"), []
    while True:
        wanted = [r[0] for r in frontier.select(_part(F.col("parent"), parts)).distinct().collect()]
        if not wanted:
            break
        joined = _children(spark, old, frontier, wanted, "_old").join(_children(spark, new, frontier, wanted, "_new"), ["path", "is_folder"], "full_outer")
        differing = stored(joined.where(~F.col("_old").eqNullSafe(F.col("_new"))), "differing")
        change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("changed")
        found.append(differing.where("not is_folder").select(F.col("path").alias("relative_path"), change.alias("change")))
        drop_stored(frontier)
        frontier = stored(differing.where("is_folder").select(F.col("path").alias("parent")), "frontier")
    return reduce(DataFrame.unionByName, found)


def refresh_changed(held: DataFrame, source: DataFrame, changes: DataFrame) -> DataFrame:
    """`held` brought to the state of `source`, given the changes between them: only changed and added rows are taken from the source.

    The result has the held columns and `origin`, `kept` or `taken`, as that of `refresh`.
    """
    changes = stored(changes, "changes")
    kept = filter_by(held, changes.select("relative_path"), ["relative_path"], "left_anti").withColumn("origin", F.lit("kept"))
    news = changes.where("change <> 'deleted'").select("relative_path")
    return kept.unionByName(filter_by(source.select(*held.columns), news, ["relative_path"], "left_semi").withColumn("origin", F.lit("taken")))
