import os

import pytest
from pyspark.sql import functions as F

from folioloom.sources.files import list_files
from folioloom.sources.tree_source import Share, TreeReader, register_tree_source
from test_files import TREE, tree  # noqa: F401


def load(spark, root, **options):
    register_tree_source(spark)
    return spark.read.format("corpus_tree").options(partitions=5, **options).load(root)


def test_same_files_as_the_listing(spark, tree):  # noqa: F811
    want = {(r.relative_path, r.size) for r in list_files(spark, tree).collect()}
    for depth in (1, 2, 9):
        rows = load(spark, tree, splitDepth=depth).collect()
        assert {(r.relative_path, r.size) for r in rows} == want and len(rows) == len(want) == len(TREE)
        assert all(r.depth == r.relative_path.count("/") + 1 and r.absolute_path == f"{tree}/{r.relative_path}" and r.relative_path.endswith(r.name) for r in rows)
    assert {r.relative_path: bytes(r.content) for r in load(spark, "file://" + tree, content="true").collect()} == TREE
    assert {r.relative_path for r in load(spark, tree, recursive="false").collect()} == {p for p in TREE if "/" not in p}
    assert [tuple(r)[1:5] for r in load(spark, tree + "/src/lib.rs").collect()] == [("lib.rs", "lib.rs", 1, 3)]
    with pytest.raises(Exception, match="nowhere"):
        load(spark, tree + "/nowhere").collect()


@pytest.mark.parametrize("where", ["size <= 3 and depth <= 2", "name like '%.rs' and relative_path like 'src/%'", "relative_path = 'src/deep/er/mod.rs'", "depth in (1, 3)", "size > 5 and size < 12",
                                   "relative_path in ('src/lib.rs', '.env')", "name like '.%' or size = 1", "name like '%i%' and size >= 3 and depth = 2"])
def test_filters(spark, tree, where):  # noqa: F811
    rows = load(spark, tree)
    want = sorted(r.relative_path for r in spark.createDataFrame(rows.collect(), rows.schema).where(where).collect())
    assert sorted(r.relative_path for r in rows.where(where).collect()) == want and want


def test_filters_are_pushed(spark, tree, capsys):  # noqa: F811
    load(spark, tree).where("size <= 3 and depth <= 2 and name like '%.rs'").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [LessThanOrEqual(size,3), LessThanOrEqual(depth,2), StringEndsWith(name,.rs)]" in plan
    assert "<=" not in plan[plan.index("Condition"):].split("\n")[0]  # only tests for NULL are left


def test_folders_that_cannot_match_are_not_entered(tree, monkeypatch):  # noqa: F811
    from pyspark.sql.datasource import EqualTo, LessThanOrEqual, StringStartsWith

    def entered(*filters):
        reader = TreeReader({"path": tree, "partitions": "1"})
        assert list(reader.pushFilters(list(filters))) == []
        seen = []
        monkeypatch.setattr("folioloom.sources.tree_source.fs.FileSelector", lambda path: seen.append(os.path.relpath(path, tree)) or FileSelector(path))
        rows = [r for b in reader.read(Share(0, 1)) for r in b.column("relative_path").to_pylist()]
        monkeypatch.undo()
        return set(seen), set(rows)

    from pyarrow.fs import FileSelector

    assert entered(StringStartsWith(("relative_path",), "src/d")) == ({".", "src", "src/deep", "src/deep/er"}, {"src/deep/er/mod.rs"})
    assert entered(LessThanOrEqual(("depth",), 1))[0] == {"."}
    assert entered(EqualTo(("relative_path",), "logs/app.log")) == ({".", "logs"}, {"logs/app.log"})


def test_flat_folder_is_several_tasks(spark, tmp_path):
    for k in range(200):
        (tmp_path / f"f{k}").write_bytes(b"x" * k)
    rows = load(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.relative_path for r in rows}) == len(rows) == 200 and len({r.part for r in rows}) == 5
