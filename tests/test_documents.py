"""Order, numbering and documents against a sequential Python rendering, with slices small enough to matter."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from folioloom import Digest, Processing, Rendering, Selection
from folioloom.operators import order
from folioloom.operators.content import process_content, python_filter
from folioloom.operators.documents import document_rows, fetches, group_documents
from folioloom.sinks import (NoFilesError, iterate_document, write_document, write_formatted, write_group_documents)

SORT = lambda f: (f[1] is not None, -1 if f[1] is None else f[1], f[0].split("/"))


def made_files(count=400, seed=3):
    rng = random.Random(seed)
    names = ["a", "a-b", "a.c", "B", "z", "é", "a b"]
    paths = list({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) + f"/f{rng.randrange(10**6)}.txt" for _ in range(count)})
    return [(p, rng.choice([None, None, None, 0, 1, 2]), "word " * rng.randrange(0, 40) + rng.choice(["", "\n"])) for p in paths]


def frame(spark, files, **extra):
    rows = spark.createDataFrame(
        [(p, bytearray(t.encode()), len(t.encode()), o is not None, o) for p, o, t in files],
        "relative_path string, content binary, size bigint, is_process_last boolean, process_last_order int").repartition(5)
    for name, column in extra.items():
        rows = rows.withColumn(name, column)
    return rows.withColumn("absolute_path", F.col("relative_path"))


def render(files, summary=False):
    blocks = []
    for path, _, text in sorted(files, key=SORT):
        body = text if not text or text.endswith("\n") else text + "\n"
        blocks.append(f"## File: {path}\n```txt\n{body}```\n")
    if summary:
        blocks.append("---\nProcessed Files: (%d)\n" % len(files) + "".join(
            f"- {p} (L:{1 if t else 0} C:{len(t.encode())} W:{len(t.split())})\n" for p, _, t in sorted(files, key=SORT)))
    return "\n".join(blocks)


def read_parts(folder):
    return "".join(open(f, encoding="utf-8", newline="").read() for f in sorted(glob.glob(f"{folder}/**/*.txt", recursive=True)))


def test_component_order(spark):
    paths = ["a.txt", "a/b", "a-b/c", "a", "a/b/c", "A", "b"]
    rows = order.with_order_key(spark.createDataFrame([(p,) for p in paths], "relative_path string"))
    assert [r.relative_path for r in rows.orderBy("_key").collect()] == sorted(paths, key=lambda p: p.split("/"))


@pytest.mark.parametrize("slices", [1, 2, 40, 1500, 40_000])
def test_slices_are_the_number_of_bounds_below(spark, slices):
    rng = random.Random(slices)
    bounds = tuple(sorted({f"{rng.randrange(10**6):06d}" for _ in range(slices - 1)}))
    keys = [f"{rng.randrange(10**6):06d}" for _ in range(300)] + list(bounds[:50])
    got = order.with_slice(spark.createDataFrame([(k,) for k in keys], "_key string"), order.Slices(bounds)).collect()
    assert all(r._slice == sum(b <= r._key for b in bounds) for r in got)


@pytest.mark.parametrize("group_count", [1, 9])
def test_numbering_across_slices(spark, group_count):
    # One group holds half of all rows; slices cut right through it.
    rows = spark.range(2000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % group_count)).alias("g"),
        F.concat(F.lit("p"), F.col("id") * 7919 % 2003).alias("relative_path"), (F.col("id") % 50 + 1).alias("size"))
    keys = order.store_keys(order.with_order_key(rows, ["g"]), "g", "relative_path")
    slices = order.plan_slices(keys, slice_bytes=2_000)
    assert slices.count > 8
    got = order.number_rows(keys, slices, keys).select("g", "relative_path", "position").collect()
    want = {}
    for r in sorted(got, key=lambda r: (r.g, r.relative_path)):
        want[r.g] = want.get(r.g, 0) + 1
        assert r.position == want[r.g]
    assert len(got) == 2000


def test_slices_are_balanced_by_bytes(spark):
    rows = spark.range(4000).select(F.format_string("%05d", "id").alias("relative_path"), F.when(F.col("id") < 400, 900).otherwise(100).alias("size"))
    keys = order.with_order_key(rows).select("_group", "_key", "size")
    slices = order.plan_slices(keys, slice_bytes=20_000)
    sizes = [r[1] for r in order.with_slice(keys, slices).groupBy("_slice").agg(F.sum("size")).collect()]
    assert len(sizes) >= 20 and max(sizes) <= 3 * 20_000


def test_copies_spread_by_ties(spark):
    rows = spark.range(1000).select(F.lit("same/path").alias("relative_path"), F.lit(100).alias("size"), F.format_string("%04d", "id").alias("copy"))
    keys = order.store_keys(order.with_order_key(rows, ties=["copy"]), "copy")
    slices = order.plan_slices(keys, slice_bytes=5_000)
    assert order.with_slice(keys, slices).groupBy("_slice").count().agg(F.max("count")).first()[0] < 200
    got = order.number_rows(keys, slices, keys).collect()
    assert sorted((r.copy, r.position) for r in got) == [(f"{i:04d}", i + 1) for i in range(1000)]


@pytest.mark.parametrize("summary", [False, True])
def test_document_bytes(spark, tmp_path, summary):
    files = made_files()
    style = Rendering(counts=summary)
    processed = process_content(frame(spark, files), Processing(counts=True))
    want = render(files, summary)
    assert write_document(processed, str(tmp_path / "d"), style, slice_bytes=2_000) == len(files)
    assert len(glob.glob(f"{tmp_path}/d/**/*.txt", recursive=True)) > 4
    assert read_parts(tmp_path / "d") == want
    rows = document_rows(processed, style, slice_bytes=2_000).collect()
    assert "".join(r.text for r in sorted(rows, key=lambda r: r.position)) == want
    assert "".join(iterate_document(processed, style)) == want


def test_opening_slices_without_text(spark, tmp_path):
    """The first slices hold only binary files, which the cuts, made from metadata, cannot know."""
    files = made_files(200)
    binary = [(f"!{i:03d}/x.txt", None, "\0" + "b" * 200) for i in range(200)]
    found = frame(spark, files + binary)
    count = write_document(process_content(found, Processing()), str(tmp_path / "d"), Rendering(), keys=found, slice_bytes=2_000)
    assert count == len(files) and read_parts(tmp_path / "d") == render(files)


@pytest.mark.parametrize("summary", [False, True])
def test_content_is_evaluated_once(spark, tmp_path, summary):
    """Whatever leads the order: paths descend over many partitions, and the first slices hold binaries only."""
    files = made_files(150)
    binary = [(f"!{i:03d}/x.txt", None, "\0" + "b" * 200) for i in range(150)]
    found = frame(spark, sorted(files + binary, reverse=True)).repartition(20)
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    options = Processing(counts=summary, filters=[python_filter(count)])
    assert write_document(process_content(found, options), str(tmp_path / "d"), Rendering(summary=summary, counts=summary), keys=found, slice_bytes=2_000) == len(files)
    assert read_parts(tmp_path / "d") == render(files, summary) and seen.value == len(files)


@pytest.mark.parametrize("summary", [False, True])
def test_failed_write_leaves_the_old_document(spark, tmp_path, summary):
    files, style = made_files(60), Rendering(summary=summary, counts=summary)
    found = frame(spark, files)
    write_document(process_content(found, Processing(counts=summary)), str(tmp_path / "d"), style)

    def fail(text):
        raise RuntimeError("no more")

    for broken in (process_content(found, Processing(filters=[python_filter(fail)])), process_content(found.limit(0), Processing())):
        with pytest.raises(Exception, match="no more|No files"):
            write_document(broken, str(tmp_path / "d"), style)
        assert read_parts(tmp_path / "d") == render(files, summary) and [f.name for f in tmp_path.iterdir()] == ["d"]
    write_document(process_content(frame(spark, files[:3]), Processing(counts=summary)), str(tmp_path / "d"), style)
    assert read_parts(tmp_path / "d") == render(files[:3], summary) and [f.name for f in tmp_path.iterdir()] == ["d"]
    assert (tmp_path / "d" / "_SUCCESS").exists()


def test_no_files(spark, tmp_path):
    for style in (Rendering(), Rendering(summary=True)):
        with pytest.raises(NoFilesError):
            write_document(process_content(frame(spark, [("a", None, "\0")]), Processing()), str(tmp_path / "d"), style)


@pytest.mark.parametrize("summary, slice_bytes", [(False, 5_000), (True, 5_000), (True, 1 << 20)])
def test_group_documents(spark, tmp_path, summary, slice_bytes):
    files = made_files(600)
    group = {p: "hot" if i % 3 == 0 else f"g{i % 20}" for i, (p, _, _) in enumerate(files)}
    lookup = F.create_map(*[F.lit(x) for item in group.items() for x in item])
    processed = process_content(frame(spark, files, repo=lookup[F.col("relative_path")]), Processing(counts=True))
    style = Rendering(counts=summary)
    documents = group_documents(processed, ["repo"], style, chunk_bytes=3_000, slice_bytes=slice_bytes)
    chunks = {}
    for r in sorted(documents.collect(), key=lambda r: (r.repo, r.chunk)):
        assert chunks.setdefault(r.repo, []) or r.chunk == 0
        chunks[r.repo].append(r.text)
    assert len(chunks["hot"]) > 3
    assert all(len(c.encode()) < 4_000 for parts in chunks.values() for c in parts)
    write_group_documents(processed, str(tmp_path / "g"), "repo", style, chunk_bytes=3_000, slice_bytes=slice_bytes)
    for name in set(group.values()):
        want = render([f for f in files if group[f[0]] == name], summary)
        assert "".join(chunks[name]) == want
        assert read_parts(tmp_path / "g" / f"repo={name}") == want


def test_small_groups_stay_whole(spark):
    files = made_files(300)
    processed = process_content(frame(spark, files, repo=F.concat(F.lit("g"), F.abs(F.hash("relative_path")) % 30)), Processing())
    documents = group_documents(processed, ["repo"], Rendering(), chunk_bytes=1 << 20)
    assert documents.agg(F.max("chunk")).first()[0] == 0 and documents.count() == 30


def test_own_format(spark, tmp_path):
    files = made_files(100)
    processed = process_content(frame(spark, files), Processing())
    write_formatted(processed, lambda rows: rows.select(F.col("relative_path").alias("value")), str(tmp_path / "f"))
    assert read_parts(tmp_path / "f").splitlines() == [p for p, _, _ in sorted(files, key=SORT)]


def test_content_is_shuffled_once_and_ordered_without_sampling(spark):
    files = made_files(100)
    slices = order.Slices(("0",))
    plan = order.in_document_order(order.with_order_key(frame(spark, files)), slices)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") - text.count("RoundRobin") == 1 and "rangepartitioning" not in text


def test_group_documents_shuffle_content_once(spark):
    processed = process_content(frame(spark, made_files(50), repo=F.lit("r")), Processing())
    text = group_documents(processed, ["repo"], Rendering())._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") - text.count("RoundRobin") == 1


def test_ordered_rows(spark):
    files = made_files(300)
    got = [r.relative_path for r in Digest().ordered(frame(spark, files)).select("relative_path").collect()]
    assert got == [p for p, _, _ in sorted(files, key=SORT)]


@pytest.mark.parametrize("option", ["path_regex", "exclude_path_regex", "filename_regex"])
def test_bad_regexes_fail_early(spark, option):
    with pytest.raises(ValueError, match=option):
        Digest(Selection(**{option: ["ok", "[bad"]})).discover(frame(spark, made_files(1)))


def test_pipeline(spark, tmp_path):
    files = [("b.txt", None, "Content B"), ("a.rs", None, "fn a() {} // x"), (".git/config", None, "c"), ("debug.log", None, "l"),
             ("Cargo.lock", None, "k"), ("last.md", None, "# t")]
    digest = Digest(Selection(skip_lockfiles=True, last=["*.md"]), Processing(counts=True, remove_comments=True), Rendering(counts=True))
    corpus = frame(spark, files).drop("is_process_last", "process_last_order")
    rules = [("gitignore", "", 0, "*.log")]
    want = ("## File: a.rs\n```rs\nfn a() {}\n```\n\n## File: b.txt\n```txt\nContent B\n```\n\n## File: last.md\n```md\n# t\n```\n\n"
            "---\nProcessed Files: (3)\n- a.rs (L:1 C:14 W:5)\n- b.txt (L:1 C:9 W:2)\n- last.md (L:1 C:3 W:2)\n")
    assert digest.write(corpus, str(tmp_path / "d"), rules) == 3
    assert read_parts(tmp_path / "d") == want
    assert "".join(r.text for r in digest.document(corpus, rules).orderBy("position").collect()) == want
    listing = "".join(r.text for r in digest.dry_run(corpus, rules).orderBy("position").collect())
    assert listing == "\n--- Dry Run: Files that would be processed ---\n- a.rs\n- b.txt\n- last.md\n--- End Dry Run ---\n"


def test_group_keys_are_injective_and_ordered(spark):
    values = [None, "", "\x01", "\x02", "\x03", "\x04", "\x01\x02", "a", "a\x00", "a\x00b", "a\x01\x03", "b"]
    pairs = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    assert pairs.select(order.group_key(["a", "b"]).alias("k")).distinct().count() == len(values) ** 2
    singles = spark.createDataFrame([(v,) for v in values], "a string").select("a", order.injective(F.col("a")).alias("k")).collect()
    assert [r.a for r in sorted(singles, key=lambda r: r.k.encode())] == sorted(values, key=lambda v: (v is not None, (v or "").encode()))


def test_windows_follow_the_planned_slices(spark):
    """The exchange has the planned number of partitions, not the session's, and there is only one."""
    rows = spark.range(3000).select(F.format_string("%05d", "id").alias("relative_path"), F.lit(100).alias("size"))
    keys = order.store_keys(order.with_order_key(rows), "relative_path")
    slices = order.plan_slices(keys, slice_bytes=10_000)
    plan = order.number_rows(keys, slices, keys)._jdf.queryExecution().executedPlan().toString()
    assert slices.count not in (1, 4) and plan.count("Exchange") == 1 and f", {slices.count})" in plan.replace("]", ")")


def test_null_and_empty_groups_have_folders_of_their_own(spark, tmp_path):
    files = made_files(30)
    repo = F.when(F.col("size") % 3 == 0, F.lit(None).cast("string")).when(F.col("size") % 3 == 1, "").otherwise("x")
    processed = process_content(frame(spark, files, repo=repo), Processing())
    write_group_documents(processed, str(tmp_path / "g"), "repo", Rendering())
    for rest, name in enumerate(["null%3A", "text%3A", "text%3Ax"]):
        assert read_parts(tmp_path / "g" / f"repo={name}") == render([f for f in files if len(f[2].encode()) % 3 == rest])
    null_and_empty = group_documents(processed, ["repo"], Rendering(summary=True)).collect()
    assert len(null_and_empty) == 3 and all(r.text.count("Processed Files:") == 1 for r in null_and_empty)


def test_stored_sizes_spare_the_content(spark, tmp_path):
    from folioloom.sources import corpus_from_table

    spark.createDataFrame([(f"p{k}", "text", 4) for k in range(20)], "path string, content string, size long").write.parquet(str(tmp_path / "t"))
    corpus = corpus_from_table(spark.read.parquet(str(tmp_path / "t")), "path", "content", keep=("size",), size="size")
    plan = order.with_order_key(Digest().discover(corpus)).select("_key", "size")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert Digest().write(corpus, str(tmp_path / "d")) == 20


def plan_length(frame):
    return len(frame._jdf.queryExecution().optimizedPlan().toString())


def test_plans_do_not_grow_with_the_number_of_slices(spark):
    """Bounds and totals beyond a fixed number are looked up in tables, so the longest plan is one of few slices."""
    rows = spark.createDataFrame([(f"{n:07d}", "") for n in range(0, 900_000, 4_999)], "_key string, _group string")
    inline, *stored = (plan_length(order.number_rows(rows, order.Slices(tuple(f"{n:07d}" for n in range(0, 25 * count, 25))), rows))
                       for count in (1_000, 9_000, 36_000))
    assert inline > 10_000 and max(stored) < inline


@pytest.mark.parametrize("group_count", [1, 5])
def test_numbering_across_stored_slices(spark, monkeypatch, group_count):
    monkeypatch.setattr(order, "INLINE", 4)
    test_numbering_across_slices(spark, group_count)


@pytest.mark.parametrize("summary", [False, True])
def test_documents_with_stored_slices(spark, tmp_path, monkeypatch, summary):
    monkeypatch.setattr(order, "INLINE", 3)
    test_document_bytes(spark, tmp_path, summary)
    test_group_documents(spark, tmp_path, summary, 5_000)


@pytest.mark.parametrize("summary", [False, True])
def test_printing_fetches_slice_by_slice(spark, summary):
    """Far more than one fetch; the first slices hold binaries only, and the content is evaluated once."""
    files = made_files(300)
    found = frame(spark, files + [(f"!{i:03d}/x.txt", None, "\0" + "b" * 200) for i in range(100)])
    seen = spark.sparkContext.accumulator(0)

    def count(text):
        seen.add(1)
        return text

    processed = process_content(found, Processing(counts=summary, filters=[python_filter(count)]))
    pieces = iterate_document(processed, Rendering(summary=summary, counts=summary), keys=found, fetch_bytes=1_000)
    first = next(pieces)
    assert first + "".join(pieces) == render(files, summary) and seen.value == len(files)
    partitions = fetches(process_content(found, Processing()), Rendering(), found, fetch_bytes=1_000)
    sizes = partitions.groupBy(F.spark_partition_id()).agg(F.sum(F.length("text"))).collect()
    assert len(sizes) > 10 and max(r[1] for r in sizes) < 6_000
    assert list(iterate_document(process_content(found.limit(0), Processing(counts=True)), Rendering(summary=True, counts=True))) == []
    assert "".join(Digest(processing=Processing(counts=summary), rendering=Rendering(summary=summary, counts=summary)).iterate(found)) == render(files, summary)


def test_tiny_fetches_do_not_multiply_tasks(spark, monkeypatch):
    """Fetches of a document are no more than a fixed number, unless each of that many would be large."""
    from folioloom.operators import documents

    monkeypatch.setattr(documents, "FETCHES", 8, raising=False)
    files = made_files(300)
    found = frame(spark, files)
    processed = process_content(found, Processing())
    assert fetches(processed, Rendering(), found, fetch_bytes=100).rdd.getNumPartitions() <= 8
    assert "".join(iterate_document(processed, Rendering(), keys=found, fetch_bytes=100)) == render(files, False)
    monkeypatch.setattr(documents, "FETCH_BYTES", 2_000)
    assert fetches(processed, Rendering(), found, fetch_bytes=100).rdd.getNumPartitions() > 8


def grouped(spark, values):
    names = [(f"f{k}.txt", bytearray(f"line {k}\n".encode()), 8, value) for k, value in enumerate(values)]
    rows = spark.createDataFrame(names, "relative_path string, content binary, size bigint, repo string")
    return process_content(rows.withColumn("absolute_path", F.col("relative_path")), Processing())


def test_groups_make_one_file_each_in_folders_named_as_by_spark(spark, tmp_path):
    """Hadoop's local writer made a second file, of checksums, for each, and forked processes for both."""
    values = ["a/b", "x=y", "50%", "a b", '"q"', "{z}", "[^]", "..", "t\ta", "\x01", "back\\slash", "it's", "#1?*:", "\x7f", "plain"]
    write_group_documents(grouped(spark, values + values), str(tmp_path / "g"), "repo", Rendering())
    made = [name for _, _, names in os.walk(tmp_path / "g") for name in names]
    assert sum("part-" in name for name in made) == len(values) and "_SUCCESS" in made
    spark.createDataFrame([(v, v) for v in values], "repo string, value string").write.partitionBy("repo").text(str(tmp_path / "by_spark"))
    folders = {name for name in os.listdir(tmp_path / "by_spark") if "=" in name}
    assert {name for name in os.listdir(tmp_path / "g") if "=" in name} == folders and len(folders) == len(values)
    read = spark.read.text(str(tmp_path / "g")).where("value like 'line%'")
    assert sorted((r.repo, r.value) for r in read.collect()) == sorted((v, f"line {k}") for k, v in enumerate(values + values))


def test_groups_named_beyond_ascii(spark, tmp_path):
    write_group_documents(grouped(spark, ["é", "漢字", "e"]), f"file:{tmp_path}/g", "repo", Rendering())
    for k, value in enumerate(["é", "漢字", "e"]):
        assert f"line {k}\n" in read_parts(tmp_path / "g" / f"repo={value}")


def test_failed_group_documents_leave_the_old_ones(spark, tmp_path):
    write_group_documents(grouped(spark, ["a", "b"]), str(tmp_path / "g"), "repo", Rendering())
    old = read_parts(tmp_path / "g")
    broken = grouped(spark, ["a", "c"]).withColumn("processed_content", F.when(F.col("repo") == "c", F.raise_error(F.lit("broken"))).otherwise(F.col("processed_content")))
    with pytest.raises(Exception, match="broken"):
        write_group_documents(broken, str(tmp_path / "g"), "repo", Rendering())
    assert read_parts(tmp_path / "g") == old and os.listdir(tmp_path) == ["g"]
    write_group_documents(grouped(spark, ["c"]), str(tmp_path / "g"), "repo", Rendering())
    assert {name for name in os.listdir(tmp_path / "g") if name[0] != "."} == {"_SUCCESS", "repo=c"} and os.listdir(tmp_path) == ["g"]


def test_no_groups(spark, tmp_path):
    write_group_documents(grouped(spark, ["a"]).where("repo = 'b'"), str(tmp_path / "g"), "repo", Rendering())
    assert [name for name in os.listdir(tmp_path / "g") if name[0] != "."] == ["_SUCCESS"]


def test_lines_of_group_documents_in_several_parts(spark, tmp_path):
    from folioloom.plans.catalog import _numbered_group_lines

    files = made_files(300)
    processed = process_content(frame(spark, files, repo=F.when(F.hash("relative_path") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.abs(F.hash("relative_path")) % 20))), Processing())
    write_group_documents(processed, str(tmp_path / "g"), "repo", Rendering(), chunk_bytes=2_000, slice_bytes=4_000)
    assert len(glob.glob(f"{tmp_path}/g/repo=hot/*/*.txt")) > 3
    got = {}
    for r in sorted(_numbered_group_lines(spark, str(tmp_path / "g"), "repo").collect(), key=lambda r: (r.repo, r.line)):
        got.setdefault(r.repo, []).append(r.value)
        assert len(got[r.repo]) == r.line
    assert got == {name[5:]: read_parts(tmp_path / "g" / name).split("\n")[:-1] for name in os.listdir(tmp_path / "g") if "=" in name}


def test_conversations_without_id_are_one_document(spark, tmp_path):
    from folioloom.plans.catalog import written_group_documents

    rows = [(None, 1, "user", "x"), (None, 2, "bot", "y"), (7, 1, "user", "z"), (-3, 1, "user", "w\nv")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {}
    for r in sorted(written_group_documents(spark, str(tmp_path)).collect(), key=lambda r: r.line):
        got.setdefault(r.conv_id, []).append(r.value)
    assert set(got) == {None, 7, -3}
    assert [v for v in got[None] if v in ("x", "y")] == ["x", "y"]
    assert [v for v in got[-3] if v in ("w", "v")] == ["w", "v"]
