"""Tables of repository URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioloom.functions import urls


def parse_urls(table: DataFrame, url: str = "url", hint: str | None = None, prefer_download: bool = False) -> DataFrame:
    """Adds `kind`, `owner`, `repo`, `clone_url`, `branch`, `subdirectory` and `cache_key`; no shuffle."""
    u = F.col(url)
    h = F.col(hint) if hint else None
    target = F.coalesce(urls.folder_url(u, h), urls.repo_url(u))
    return (table.withColumn("_target", target)
            .withColumn("kind", urls.input_kind(u, h, prefer_download))
            .withColumn("owner", urls.repo_owner(F.col("_target.clone_url")))
            .withColumn("repo", urls.repo_name(F.col("_target.clone_url")))
            .withColumn("clone_url", F.col("_target.clone_url"))
            .withColumn("branch", F.col("_target.branch"))
            .withColumn("subdirectory", F.col("_target.subdirectory"))
            .withColumn("cache_key", urls.url_key(F.coalesce(F.col("_target.clone_url"), u)))
            .drop("_target"))


def distinct_repositories(table: DataFrame, url: str = "url") -> DataFrame:
    """`(url, cache_key, mentions)`: one row per distinct URL, counted before the shuffle."""
    return (table.groupBy(url).agg(F.count("*").alias("mentions"))
            .withColumn("cache_key", urls.url_key(F.col(url))))
