"""Snapshots compared from the root down, against the comparison of all contents."""

import glob
import random

import pytest

from folioloom.operators import snapshots
from folioloom.operators.folder_digests import compare_snapshots, refresh_changed, write_snapshot

SCHEMA = "relative_path string, content string, n int"


def tree(rng, n):
    return [("/".join(rng.choices("abcd", k=rng.randrange(1, 5))) + rng.choice([".x", ""]), rng.choice("123"), 1) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equal_to_comparing_all(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = tree(rng, 120)
    edited = [r for r in rows if rng.random() > 0.1] + tree(rng, 10) + [("/x", None, 1), ("", "e", 1)]
    old, new = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(edited, SCHEMA)
    write_snapshot(old, f"{tmp_path}/old", parts=5)
    write_snapshot(new, f"{tmp_path}/new", parts=5)
    want = {tuple(r) for r in snapshots.snapshot_diff(old, new).where("change <> 'same'").collect()}
    changes = compare_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new")
    got = [tuple(r) for r in changes.collect()]
    assert set(got) == want and len(got) == len(want) > 5
    fresh = refresh_changed(old, new, changes)
    assert {(r.relative_path, r.content) for r in fresh.collect()} == {(r.relative_path, r.content) for r in new.collect()}


def test_unchanged_subtrees_are_not_read(spark, tmp_path):
    rows = [(f"top{k % 30}/in{k % 7}/f{k}", str(k), 1) for k in range(600)]
    write_snapshot(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/old", parts=50)
    write_snapshot(spark.createDataFrame([*rows[:5], ("top5/in5/f5", "new", 1), *rows[6:]], SCHEMA), f"{tmp_path}/new", parts=50)
    asked = spark.createDataFrame([("",), ("top5",), ("top5/in5",)], "p string").selectExpr("pmod(xxhash64(p), 50) p")
    visited = {f"part={v}" for v in (-1, *(r.p for r in asked.collect()))}
    spoiled = [f for f in glob.glob(f"{tmp_path}/*/part=*/*.parquet") if f.split("/")[-2] not in visited]
    for file in spoiled:
        with open(file, "wb") as f:
            f.write(b"not to be read")
    assert len(spoiled) > 60
    assert [tuple(r) for r in compare_snapshots(spark, f"{tmp_path}/old", f"{tmp_path}/new").collect()] == [("top5/in5/f5", "changed")]


def test_empty_and_copies(spark, tmp_path):
    rows = [("a", "1", 1), ("a", "1", 2), ("a", "2", 1), ("b/c", None, 1), (None, "n", 1)]
    for name, part in (("none", []), ("all", rows), ("once", rows[1:4]), ("folder", [("a/x", "1", 1), ("b/c", "", 1)])):
        write_snapshot(spark.createDataFrame(part, SCHEMA), f"{tmp_path}/{name}", parts=3)

    def changes(old, new):
        return sorted(tuple(r) for r in compare_snapshots(spark, f"{tmp_path}/{old}", f"{tmp_path}/{new}").collect())

    assert changes("none", "none") == changes("all", "once") == []
    assert changes("none", "all") == [("a", "added"), ("b/c", "added")] and changes("all", "none") == [("a", "deleted"), ("b/c", "deleted")]
    assert changes("all", "folder") == [("a", "deleted"), ("a/x", "added")]
    write_snapshot(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/other", parts=4)
    with pytest.raises(ValueError):
        changes("all", "other")
