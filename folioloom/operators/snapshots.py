"""Corpus snapshots: resolving refs and comparing two versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.operators.skew import filter_by, stored, stored_for_join


def resolve_refs(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds `commit` and `resolved_as` to `(repo, name)` requests.

    A name means the branch, else the tag of that name; no name means the repository's default branch, whose name is in
    the `head` row of `refs(repo, kind, name, commit)`. `resolved_as` is `branch`, `tag`, `default`, `ref_not_found` or
    `no_default`. Refs are reduced to one row per name before
    the join, so a popular repository multiplies nothing. They are stored, and broadcast if they are small by their measured size; else adaptive
    execution can split a popular repository's requests.
    """
    heads = (refs.where("kind = 'head'").groupBy("repo")
             .agg(F.max("name").alias("_default"), F.max("commit").alias("_head")))
    named = (refs.where("kind in ('branch', 'tag')").groupBy("repo", F.col("name").alias("_name"))
             .agg(F.max(F.when(F.col("kind") == "branch", F.col("commit"))).alias("_branch"),
                  F.max(F.when(F.col("kind") == "tag", F.col("commit"))).alias("_tag")))

    def joined(rows: DataFrame, unique: DataFrame, keys: list[str]) -> DataFrame:
        return rows.join(stored_for_join(unique, "refs"), keys, "left")

    asked = joined(requests, heads, ["repo"]).withColumn("_name", F.coalesce("name", "_default"))
    found = joined(asked, named, ["repo", "_name"])
    explicit = F.col("name").isNotNull()
    commit = F.when(explicit, F.coalesce("_branch", "_tag")).otherwise(F.coalesce("_branch", "_head"))
    how = (F.when(explicit & F.col("_branch").isNotNull(), "branch").when(explicit & F.col("_tag").isNotNull(), "tag")
           .when(explicit, "ref_not_found").when(commit.isNotNull(), "default").otherwise("no_default"))
    return found.select(*requests.columns, commit.alias("commit"), how.alias("resolved_as"))


def check_out(resolved: DataFrame, versions: DataFrame) -> DataFrame:
    """Files of the resolved commits from `versions(repo, commit, relative_path, content)`."""
    wanted = stored(resolved.where("commit is not null").select("repo", "commit").distinct(), "commits")
    return filter_by(versions, wanted, ["repo", "commit"], "left_semi")


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("relative_path",),
                  content: str = "content") -> DataFrame:
    """`(keys..., change)` with change `added`, `changed`, `deleted` or `same`, one row per key.

    Contents are hashed before the join, so only keys and digests are shuffled. A key that repeats stands for the set of its contents, whose
    digests are put together first, so copies never multiply.
    """
    def side(table: DataFrame, name: str) -> DataFrame:
        digests = table.select(*keys, F.sha2(F.coalesce(F.col(content).cast("binary"), F.lit(b"")), 256).alias("_digest"))
        return digests.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set("_digest")), " "), 256).alias(name))

    change = (F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted")
              .when(F.col("_old") == F.col("_new"), "same").otherwise("changed"))
    return side(old, "_old").join(side(new, "_new"), list(keys), "full_outer").select(*keys, change.alias("change"))


def refresh(held: DataFrame, source: DataFrame, keys: Sequence[str] = ("relative_path",), content: str = "content") -> tuple[DataFrame, DataFrame]:
    """`(new corpus, its changes)`. Unchanged rows are the held ones, changed and added rows come from the source, deleted ones go.

    The new corpus has the held columns and `origin`, `kept` or `taken`; so a held row keeps what the source does not know, and
    only changed rows have to be written again. The comparison shuffles digests; its result is stored and meets both sides in semi-joins.
    """
    changes = stored(snapshot_diff(held, source, keys, content), "changes")
    same = changes.where("change = 'same'").select(*keys)
    news = changes.where("change in ('added', 'changed')").select(*keys)
    kept = filter_by(held, same, keys, "left_semi").withColumn("origin", F.lit("kept"))
    taken = filter_by(source.select(*held.columns), news, keys, "left_semi").withColumn("origin", F.lit("taken"))
    return kept.unionByName(taken), changes.where("change <> 'same'")
