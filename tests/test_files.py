import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioloom import Digest, Processing, Rendering, Selection
from folioloom.sources import files, list_files, read_contents, read_lines, read_tree

TREE = {
    "main.rs": b"// m\nfn main() {}", ".env": b"K=1", ".github/ci.yml": b"on: push", ".git/config": b"[core]", "_x/_y.txt": b"y",
    "src/lib.rs": b"lib", "src/deep/er/mod.rs": b"mod", "logs/app.log": b"log", "target/out.bin": b"\x00\x01", "notes.txt": b"n",
    ".gitignore": b"*.log\n/target/\n", "src/.ignore": b"deep\n", "vendor/package-lock.json": b"{}",
}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    os.symlink(root / "main.rs", root / "link.rs")
    os.symlink(root / "src", root / "linked")
    return str(root)


def paths(frame):
    return {r.relative_path for r in frame.select("relative_path").collect()}


def test_listing_keeps_hidden_files_and_skips_links(spark, tree):
    listing = list_files(spark, tree)
    assert {(r.relative_path, r.size) for r in listing.collect()} == {(p, len(c)) for p, c in TREE.items()}
    assert paths(list_files(spark, tree, recursive=False)) == {p for p in TREE if "/" not in p}
    single = list_files(spark, os.path.join(tree, "src/lib.rs")).first()
    assert (single.relative_path, single.size) == ("lib.rs", 3)
    assert list_files(spark, "file:" + tree).count() == len(TREE)
    with pytest.raises(FileNotFoundError):
        list_files(spark, tree + "/nowhere")
    with pytest.raises(ValueError, match="mount"):
        list_files(spark, "hdfs://host/tree")


def test_pruned_folders_are_not_entered(spark, tree):
    listing = list_files(spark, tree, prune=lambda p: p.isin("src", ".git"))
    assert paths(listing) == {p for p in TREE if not p.startswith(("src/", ".git/"))}


def test_contents(spark, tree):
    assert {r.relative_path: bytes(r.content) for r in read_tree(spark, tree).collect()} == TREE
    heads = read_contents(list_files(spark, tree), head_bytes=2)
    assert {r.relative_path: bytes(r.content) for r in heads.collect()} == {p: c[:2] for p, c in TREE.items()}


def test_unreadable_files(spark, tree):
    listing = list_files(spark, tree).withColumn(
        "absolute_path", F.when(F.col("relative_path") == "main.rs", "/nowhere/main.rs").otherwise(F.col("absolute_path")))
    rows = {r.relative_path: r for r in read_contents(listing, on_error="keep").collect()}
    assert rows["main.rs"].content is None and "main.rs" in rows["main.rs"].error
    assert sum(r.error is None for r in rows.values()) == len(TREE) - 1
    with pytest.raises(Exception, match="main.rs"):
        read_contents(listing).collect()
    with pytest.raises(ValueError):
        read_contents(listing, on_error="skip")


def test_tree_run(spark, tree, tmp_path):
    digest = Digest(Selection(skip_lockfiles=True), Processing(remove_comments=True), Rendering())
    got = {r.relative_path: r.processed_content for r in digest.execute_tree(spark, tree).collect()}
    assert set(got) == {"main.rs", ".env", ".github/ci.yml", "_x/_y.txt", "src/lib.rs", "notes.txt", ".gitignore", "src/.ignore"}
    assert got["main.rs"] == "fn main() {}"
    everything = Digest(Selection(use_ignore_rules=False), Processing(include_binary=True))
    assert paths(everything.execute_tree(spark, tree)) == set(TREE) - {".git/config"}
    vcs = Digest(Selection(path_regex=[r"^\.git/"]))
    assert paths(vcs.execute_tree(spark, tree)) == {".git/config"}
    only = Digest(Selection(only=["*.log"]))
    assert paths(only.execute_tree(spark, tree)) == {"logs/app.log"}
    assert digest.write_tree(spark, tree, str(tmp_path / "out")) == 8


def test_single_file_run(spark, tree):
    root = tree + "/src/lib.rs"
    assert paths(Digest(Selection(extensions=["rs"], ignore_globs=["*.rs"], last=["lib.rs"])).execute_tree(spark, root)) == {"lib.rs"}
    assert paths(Digest(Selection(extensions=["txt"])).execute_tree(spark, root)) == set()


def test_tree_dry_run(spark, tree):
    digest = Digest(Selection(ignore_globs=["src", "vendor"], last=["main.rs"]))
    text = "".join(r.text for r in digest.dry_run_tree(spark, tree).orderBy("position").collect())
    names = [".env", ".github/ci.yml", ".gitignore", "_x/_y.txt", "notes.txt", "main.rs"]
    assert text == "\n--- Dry Run: Files that would be processed ---\n" + "".join(f"- {n}\n" for n in names) + "--- End Dry Run ---\n"


def test_rules_from_outside_the_tree(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    files = {"config/git/ignore": "*.bak\n", "repo/.git/info/exclude": "secret.txt\n/sub/only.txt\n", "repo/.git/config": "", "repo/.gitignore": "*.log\n/sub/deep/\n*/x.md\nother/*.rs\n",
             "repo/sub/.gitignore": "!keep.log\n", "repo/sub/a.log": "", "repo/sub/keep.log": "", "repo/sub/b.bak": "", "repo/sub/secret.txt": "", "repo/sub/only.txt": "",
             "repo/sub/deep/d.txt": "", "repo/sub/x.md": "", "repo/sub/e.rs": "", "repo/sub/f/x.md": ""}
    for path, text in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert paths(Digest().discover_tree(spark, str(tmp_path / "repo/sub"))) == {".gitignore", "keep.log", "e.rs", "f/x.md"}
    assert paths(Digest().discover_tree(spark, str(tmp_path / "repo"))) == {".gitignore", "sub/.gitignore", "sub/keep.log", "sub/e.rs", "sub/f/x.md"}
    assert len(paths(Digest(Selection(use_ignore_rules=False)).discover_tree(spark, str(tmp_path / "repo/sub")))) == 10


@pytest.mark.parametrize("max_size", [None, "1M"])
def test_listing_errors_are_skipped_and_counted(spark, tree, monkeypatch, max_size):
    from folioloom.plans import digest

    whole = digest.list_unignored

    def with_error(spark, root, *more):
        listing = whole(spark, root, *more)
        return listing.unionByName(spark.createDataFrame([(root + "/shut", "shut", None, "Permission denied")], listing.schema))

    monkeypatch.setattr(digest, "list_unignored", with_error)
    with pytest.warns(UserWarning, match="1 entries"):
        got = Digest(Selection(max_size=max_size)).execute_tree(spark, tree)
    assert "main.rs" in paths(got) and "shut" not in paths(got)


def test_ignored_folders_are_not_entered(spark, tmp_path):
    """The descent lists the files that the table plan keeps, and never asks for an entry below an ignored folder."""
    from folioloom.operators.ignore import drop_ignored, rules_from_corpus
    from folioloom.session import shared_folder
    from folioloom.sources.descent import list_unignored

    names = {".gitignore": "node_modules/\n*.log\n!keep.log\n/top\n**/gen/*.c\n.ignore\n", "a/.gitignore": "!node_modules\nb/\n", "a/.ignore": "keep.log\n!b\n", "a/c/.gitignore": "*\n!d.txt\n",
             "x/.gitignore/odd": "", "node_modules/.gitignore": "!*.log"}
    paths_ = ["node_modules/m1/index.js", "node_modules/x.log", "a/node_modules/n.js", "a/b/b.txt", "a/keep.log", "keep.log", "z.log", "top", "q/top", "a/c/d.txt", "a/c/e.txt", "a/c/f/d.txt",
              "gen/x.c", "p/gen/x.c", "p/gen/x.h", "p/q/gen/deep/x.c"]
    root = tmp_path / "tree"
    for path, text in [*names.items(), *((p, "t") for p in paths_)]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    plain = list_files(spark, str(root))
    rule_files = plain.where(r"relative_path rlike '(^|/)[.](git)?ignore$'")
    rules = rules_from_corpus(read_contents(rule_files, on_error="keep").where("error is null"))
    for last in (["*.log", "index.js"], None):
        want = paths(drop_ignored(plain.where("error is null"), rules, last=last))
        found = list_unignored(spark, str(root), last=last)
        assert paths(found) == want and found.where("error is not null").count() == 0
    entries = spark.read.parquet(f"{shared_folder(spark)}/entries-*").where(F.col("absolute_path").startswith(str(root)))
    assert {r.relative_path for r in entries.collect() if r.relative_path.startswith(("node_modules/", "a/c/f/"))} == set() and entries.count() > 20
    assert paths(list_unignored(spark, str(root), prune=lambda p: p == "a")) == {p for p in want if not p.startswith("a/")}
    assert paths(list_unignored(spark, str(root), recursive=False)) == {".gitignore", "keep.log"}
    assert paths(list_unignored(spark, str(root), outer=[("global", "", 0, "q/"), ("above-ignore", "", 0, "!z.log")])) == (want | {"z.log"}) - {"q/top", "p/q/gen/deep/x.c"}


def test_contents_come_in_batches_of_some_megabytes(tmp_path):
    """Whatever a task reads, its Python holds some megabytes of it."""
    for k in range(12):
        (tmp_path / f"f{k}").write_bytes(bytes([k]) * (3 << 20))
    listing = pa.RecordBatch.from_pydict({"absolute_path": [str(tmp_path / f"f{k}") for k in range(12)], "error": pa.array([None] * 12, pa.string())})
    read = list(files._reader(None, True)(iter([listing])))
    assert b"".join(c for batch in read for c in batch["content"].to_pylist()) == b"".join(bytes([k]) * (3 << 20) for k in range(12))
    assert max(batch["content"].nbytes for batch in read) < 8 << 20


def test_lines(spark, tmp_path, monkeypatch):
    """A newline ends a line, and nothing else does; batches may end within a file."""
    contents = {"a": b"", "b": b"\n", "c": b"x", "d": b"x\n\ny\r\nz", "e/f": b"\xff\n" + b"long line\n" * 50}
    for name, content in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    lines = lambda content: content.removesuffix(b"\n").split(b"\n") if content else []
    got = {(r.relative_path, r.at): bytes(r.line) for r in read_lines(list_files(spark, str(tmp_path))).withColumn("line", F.col("line").cast("binary")).collect()}
    assert got == {(name, at): line for name, content in contents.items() for at, line in enumerate(lines(content))}
    monkeypatch.setattr(files, "READ_BATCH_BYTES", 40)
    batch = pa.RecordBatch.from_pylist([{"absolute_path": str(tmp_path / name), "relative_path": name, "error": None} for name in contents])
    read = [row for part in files._read_lines(iter([batch])) for row in part.to_pylist()]
    assert {(r["relative_path"], r["at"]): r["line"] for r in read} == got and len(read) == len(got)
    os.remove(tmp_path / "c")
    with pytest.raises(Exception, match="No such file"):
        read_lines(spark.createDataFrame([(str(tmp_path / "c"), "c", 1, None)], "absolute_path string, relative_path string, size bigint, error string")).collect()
