"""Snapshots, URL tables and streams."""

import shutil

import pytest
from pyspark.sql import functions as F

from folioloom import Digest, Processing, Rendering, Selection
from folioloom.functions import urls
from folioloom.operators import repos, skew, snapshots
from folioloom.plans.catalog import QUERIES
from folioloom.streaming import clean_stream, start_batch_documents, start_clean_table


def test_refs(spark):
    refs = spark.createDataFrame([
        ("r", "head", "main", None), ("r", "branch", "main", "c1"), ("r", "branch", "both", "c2"), ("r", "tag", "both", "c3"),
        ("r", "tag", "v1", "c4"), ("s", "branch", "x", "c5"), ("t", "head", None, "c6")], "repo string, kind string, name string, commit string")
    asked = spark.createDataFrame([("r", n) for n in ("main", "both", "v1", "no", None)] + [("s", None), ("s", "x"), ("t", None)], "repo string, name string")
    got = {(r.repo, r.name): (r.commit, r.resolved_as) for r in snapshots.resolve_refs(asked, refs).collect()}
    assert got == {("r", "main"): ("c1", "branch"), ("r", "both"): ("c2", "branch"), ("r", "v1"): ("c4", "tag"),
                   ("r", "no"): (None, "ref_not_found"), ("r", None): ("c1", "default"), ("s", None): (None, "no_default"),
                   ("s", "x"): ("c5", "branch"), ("t", None): ("c6", "default")}


def test_snapshots(spark):
    kind = "relative_path string, content string"
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], kind)
    new = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "4")], kind)
    assert {tuple(r) for r in snapshots.snapshot_diff(old, new).collect()} == {("a", "deleted"), ("b", "same"), ("c", "changed"), ("d", "added")}
    refreshed, changes = snapshots.refresh(old, new)
    assert {tuple(r) for r in refreshed.collect()} == {("b", "2", "kept"), ("c", "x", "taken"), ("d", "4", "taken")} and changes.count() == 3


def test_refresh_keeps_held_rows_and_copies_do_not_multiply(spark):
    kind = "relative_path string, content string, note string"
    held = spark.createDataFrame([("a", "1", "held"), ("a", "1", "held"), ("b", "2", "held"), ("n", None, "held"), ("z", "9", "held")], kind)
    source = spark.createDataFrame([("a", "1", "new")] * 3 + [("b", "3", "new"), ("b", "4", "new"), ("n", None, "new")], kind)
    refreshed, changes = snapshots.refresh(held, source)
    assert sorted(tuple(r)[:4] for r in refreshed.fillna("").collect()) == [
        ("a", "1", "held", "kept"), ("a", "1", "held", "kept"), ("b", "3", "new", "taken"), ("b", "4", "new", "taken"), ("n", "", "held", "kept")]
    assert {tuple(r) for r in changes.collect()} == {("b", "changed"), ("z", "deleted")}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_check_out_of_a_popular_commit(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", limit)
    versions = spark.range(900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("repo"),
                                       F.lit("c").alias("commit"), F.col("id").cast("string").alias("relative_path"))
    resolved = spark.createDataFrame([("hot", "c"), ("hot", "c"), ("r1", "c"), ("r2", None)], "repo string, commit string")
    got = snapshots.check_out(resolved, versions).groupBy("repo").count().collect()
    assert {r.repo: r["count"] for r in got} == {"hot": 300, "r1": versions.where("repo = 'r1'").count()}


@pytest.mark.parametrize("url, hint, expected", [
    ("https://github.com/o/r/tree/main/src/app", None, ("https://github.com/o/r.git", "main", "src/app")),
    ("https://github.com/o/r/blob/dev/f.rs", None, ("https://github.com/o/r.git", "dev", "f.rs")),
    ("https://github.com/o/r/tree/main/", None, ("https://github.com/o/r.git", "main", "")),
    ("https://github.com/o/r/tree/feat/ui/src", None, ("https://github.com/o/r.git", "feat", "ui/src")),
    ("https://github.com/o/r/tree/feat/ui/src", "feat/ui", ("https://github.com/o/r.git", "feat/ui", "src")),
    ("https://github.com/o/r/tree/feat/ui", "feat/ui", ("https://github.com/o/r.git", "feat/ui", "")),
    ("https://github.com/o/r/tree/feature-x/src", "feature", ("https://github.com/o/r.git", "feature-x", "src")),
    ("https://github.com/o/r.git/dir/sub", None, ("https://github.com/o/r.git", "HEAD", "dir/sub")),
    ("https://github.com/o/r/issues/1", None, None), ("https://github.com/o/r", None, None),
    ("https://gitlab.com/o/r/tree/main", None, None), ("/local/path", None, None),
])
def test_folder_urls(spark, url, hint, expected):
    row = spark.createDataFrame([(url, hint)], "u string, h string").select(urls.folder_url(F.col("u"), F.col("h")).alias("x")).first().x
    assert (tuple(row) if row else None) == expected


def test_url_tables(spark):
    table = spark.createDataFrame([("git@github.com:o/r.git",), ("https://github.com/o/r",), ("https://x.org/o/r.git",), ("/srv/x",)], "url string")
    got = {r.url: (r.kind, r.owner, r.repo) for r in repos.parse_urls(table, prefer_download=True).collect()}
    assert got == {"git@github.com:o/r.git": ("download", "o", "r"), "https://github.com/o/r": ("download", "o", "r"),
                   "https://x.org/o/r.git": ("clone", None, None), "/srv/x": ("local", None, None)}
    assert {r.kind for r in repos.parse_urls(table).collect()} == {"clone", "local"}
    assert repos.distinct_repositories(table.union(table)).where("mentions = 2").count() == 4


DIGEST = Digest(Selection(extensions=["rs"], last=["z*"]), Processing(counts=True, remove_comments=True), Rendering(counts=True))
RULES = [("gitignore", "", 0, "gen/")]


@pytest.fixture
def stream(spark, tmp_path):
    kind = "relative_path string, content string"
    rows = [("a.rs", "x // c"), ("gen/b.rs", "y"), ("z.rs", "z"), ("n.txt", "n"), ("bin.rs", "\0")]
    for at, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.mark.parametrize("as_table", [False, True])
def test_clean_stream(spark, stream, tmp_path, as_table):
    rules = spark.createDataFrame(RULES, "kind string, base string, seq int, pattern string") if as_table else RULES
    query = start_clean_table(stream, DIGEST, str(tmp_path / "out"), str(tmp_path / "state"), rules, available_now=True)
    query.awaitTermination()
    got = {(r.relative_path, r.processed_content, r.is_process_last) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a.rs", "x", False), ("z.rs", "z", True)}


def test_rules_of_a_stream_by_type(spark, stream, tmp_path):
    with pytest.raises(TypeError):
        clean_stream(stream, DIGEST, spark.createDataFrame(RULES, "kind string, base string, seq int, pattern string"))
    many = [("gitignore", "", k, f"no{k}*.zzz") for k in range(3000)] + RULES
    query = (clean_stream(stream, DIGEST, many).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert {r.relative_path for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a.rs", "z.rs"}


def test_batch_documents(spark, stream, tmp_path):
    query = start_batch_documents(stream, DIGEST, str(tmp_path / "docs"), str(tmp_path / "state"), RULES, available_now=True)
    query.awaitTermination()
    lines = [r.value for r in spark.read.text(str(tmp_path / "docs")).collect()]
    assert lines.count("Processed Files: (2)") == 1 and lines.count("## File: a.rs") == 1 and "## File: gen/b.rs" not in lines


@pytest.mark.parametrize("documents", [False, True])
def test_batches_leave_no_tables(spark, tmp_path, documents, monkeypatch):
    """Rules are compiled when their content changes, and what a batch stores goes with it."""
    import os
    from urllib.parse import urlparse

    from folioloom.operators import ignore
    from folioloom.session import shared_folder

    prepared, real = [], ignore.prepared_rules
    monkeypatch.setattr(ignore, "prepared_rules", lambda *a: prepared.append(1) or real(*a))
    for k in range(5):
        spark.createDataFrame([(f"d{k}/f{j}.{e}", bytearray(b"x\n")) for j in range(3) for e in ("log", "txt")], "relative_path string, content binary").write.parquet(f"{tmp_path}/in/{k}")
    rules = spark.createDataFrame([("gitignore", "", 0, "*.log"), ("gitignore", "d1", 0, "f1*")], "kind string, base string, seq int, pattern string")
    batches = spark.readStream.schema("relative_path string, content binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    start = start_batch_documents if documents else start_clean_table
    query = start(batches, Digest(), str(tmp_path / "out"), str(tmp_path / "state"), rules, available_now=True)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4 and len(prepared) == 1
    assert {name.split("-")[0] for name in set(os.listdir(folder)) - before} == {"rules"}
    if not documents:
        got = {r.relative_path for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        assert got == {f"d{k}/f{j}.txt" for k in range(5) for j in range(3)} - {"d1/f1.txt"}


@pytest.mark.parametrize("name", ["stream_clean", "stream_clean_rule_table", "stream_clean_long_rules", "stream_documents"])
def test_streamed_tables_are_files_or_folders(spark, tmp_path, name):
    """A table of several part files streams like the same rows in one file."""
    rows = spark.createDataFrame([(k, f"src{k % 3}", "en", f"line {k}, x. y", 12) for k in range(40)], "doc_id bigint, source string, lang string, text string, n_chars bigint")
    rows.repartition(3).write.parquet(str(tmp_path / "parts/documents.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    (tmp_path / "single").mkdir()
    shutil.copy(next((tmp_path / "written").glob("part-*.parquet")), tmp_path / "single/documents.parquet")
    parts, single = (sorted(map(tuple, QUERIES[name](spark, str(tmp_path / folder)).collect())) for folder in ("parts", "single"))
    assert parts == single and len(parts) > 20
