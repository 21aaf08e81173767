"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.config import Processing, Rendering, Selection
from folioloom.functions import paths
from folioloom.functions import text as T
from folioloom.functions import urls
from folioloom.functions.lockfiles import is_lockfile
from folioloom.operators import ignore, order, render, repos, select, snapshots
from folioloom.operators.chunked import process_chunks
from folioloom.operators.content import process_content, python_filter, split_errors
from folioloom.operators.documents import document_rows, dry_run_rows, fetches, group_documents, set_off
from folioloom.operators.folder_digests import compare_snapshots, refresh_changed, write_snapshot
from folioloom.operators.skew import stored, stored_for_join
from folioloom.plans import corpora
from folioloom.plans.digest import Digest
from folioloom.session import local_folder, mounted_path, new_table_path
from folioloom.sinks.documents import NoFilesError, write_formatted, write_group_documents
from folioloom.sources.chunks import read_chunks
from folioloom.sources.descent import list_unignored
from folioloom.sources.files import list_files, read_contents, read_lines
from folioloom.sources.tree_source import register_tree_source
from folioloom.streaming.clean import start_batch_documents, start_clean_table

LAST = ("*.md", "en/src1/*", "[invalid", "*/pkg?7/.env", "**/build/**")
RULES = (
    ignore.rules_from_lines(["*.log", "!doc_1*.log", "target/", "/en/src1/doc_*.md", "**/build/out", "pkg*/Makefile",
                             "# a comment", "", "\\!odd"])
    + ignore.rules_from_lines(["*.txt", "!doc_2*.txt", "src2/**"], base="en")
    + ignore.rules_from_lines(["!*.log"], base="fr", kind="ignore")
)
OVERRIDES = ("doc_3*.log", "src5/pkg*", "target")
IGNORE_GLOBS = ("*.log", "*/target/*", "pkg1?", "[invalid", "**/src3/doc_[!1-5]*")


def _listed(rows: DataFrame) -> DataFrame:
    return rows.select("relative_path", "size")


def _select(spark: SparkSession, sf_dir: str, selection: Selection, path: str = corpora.PATH) -> DataFrame:
    return _listed(select.select_files(corpora.documents(spark, sf_dir, path), selection))


# ---------------------------------------------------------------- selection

def ext_filter(spark, sf_dir):
    return _select(spark, sf_dir, Selection(extensions=["RS", "txt", "gz", "lock"], exclude_extensions=["lock"],
                                            path_regex=[r"\.git|."]))


def size_filter(spark, sf_dir):
    return _select(spark, sf_dir, Selection(max_size="2k"))


def size_literal(spark, sf_dir):
    return _select(spark, sf_dir, Selection(max_size=" 1.5 KiB"))


def given_sizes(spark, sf_dir):
    """Sizes that the table brings, so that content is not read for them."""
    docs = corpora.table(spark, sf_dir, "documents").withColumn("size", F.col("doc_id") * 3)
    return _listed(select.select_files(corpora.corpus_from_table(docs, F.expr(corpora.PATH), "text", keep=("size",), size="size"), Selection(max_size=2000)))


def path_regex(spark, sf_dir):
    return _select(spark, sf_dir, Selection(path_regex=[r"^EN/src1\d?/", r"makefile$"]))


def path_exclude_regex(spark, sf_dir):
    return _select(spark, sf_dir, Selection(path_regex=["src"], exclude_path_regex=[r"^de/", r"/LOGS/", r"\.md$"]))


def filename_regex(spark, sf_dir):
    return _select(spark, sf_dir, Selection(filename_regex=[r"^doc_\d*7\.", r"^\.ENV"]))


def lockfile_skip(spark, sf_dir):
    return _select(spark, sf_dir, Selection(skip_lockfiles=True))


def lockfiles_any_case(spark, sf_dir):
    return _listed(corpora.documents(spark, sf_dir).where(is_lockfile(F.col("absolute_path"), any_case=True)))


def combined_filters(spark, sf_dir):
    return _select(spark, sf_dir, Selection(extensions=["rs", "md", "txt"], max_size="4KiB", path_regex=["src1"],
                                            exclude_path_regex=["^fr/"], ignore_globs=["*/logs/*"], skip_lockfiles=True))


def ignore_globs(spark, sf_dir):
    return _select(spark, sf_dir, Selection(ignore_globs=IGNORE_GLOBS))


def vcs_dir_skip(spark, sf_dir):
    return _select(spark, sf_dir, Selection())


def vcs_dir_wanted(spark, sf_dir):
    return _select(spark, sf_dir, Selection(path_regex=[r"(^|/)\.git/"]))


def non_recursive(spark, sf_dir):
    return _select(spark, sf_dir, Selection(recursive=False), corpora.FLAT_PATH)


def ignore_rules(spark, sf_dir):
    return _listed(ignore.drop_ignored(corpora.documents(spark, sf_dir), RULES))


def ignore_rules_off(spark, sf_dir):
    digest = Digest(Selection(use_ignore_rules=False, path_regex=[r"\.git/", "."]))
    return _listed(digest.discover(corpora.documents(spark, sf_dir), RULES))


def ignore_rules_override(spark, sf_dir):
    return _listed(ignore.drop_ignored(corpora.documents(spark, sf_dir), RULES, last=OVERRIDES))


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules in every source folder of every language, derived from the documents' own folders."""
    lines = F.posexplode(F.array(
        F.lit("*.log"), F.concat(F.lit("!doc_"), F.substring("source", 4, 1), F.lit("*.log")), F.lit("target/"),
        F.lit("/build"), F.lit("doc_*7.*"), F.lit(".env"), F.lit("!.env.local"), F.lit("*.rs"), F.lit("!doc_7*")))
    return (corpora.table(spark, sf_dir, "documents").select("lang", "source").distinct()
            .select("lang", F.lit("gitignore").alias("kind"), F.col("source").alias("base"), lines.alias("seq", "pattern")))


def ignore_rule_table(spark, sf_dir):
    """Rule table with one rule set per language, resolved by joins."""
    corpus = corpora.documents(spark, sf_dir, corpora.INNER_PATH, keep=("lang",))
    kept = ignore.drop_ignored(corpus, rule_table(spark, sf_dir), scope=["lang"])
    return kept.select("lang", "relative_path", "size")


def rules_in_corpus(spark, sf_dir):
    """Rule lines read from ignore files that lie in the corpus."""
    corpus = corpora.documents(spark, sf_dir, "concat_ws('/', lang, source, concat('p', doc_id), "
                               "case when doc_id % 2 = 0 then '.gitignore' else '.ignore' end)")
    return ignore.rules_from_corpus(corpus).select("kind", "base", F.col("seq").cast("bigint").alias("seq"), "pattern")


# ---------------------------------------------------------------- order

def process_last(spark, sf_dir):
    tagged = select.tag_last(corpora.documents(spark, sf_dir), LAST)
    return tagged.select("relative_path", "is_process_last", F.col("process_last_order").cast("bigint").alias("process_last_order"))


def only_last(spark, sf_dir):
    found = select.select_files(corpora.documents(spark, sf_dir), Selection(only=LAST, path_regex=[r"\.git/", "."]))
    return found.select("relative_path", F.col("process_last_order").cast("bigint").alias("process_last_order"))


#: Patterns of three shapes, numbered through.
MANY_LAST = tuple(glob for k in range(500) for glob in (f"**/pkg{k}/.env", f"doc_{k}.md", f"en/src{k}/*.rs"))


def process_last_many(spark, sf_dir):
    """1,500 last patterns, looked up by their literal parts."""
    tagged = select.tag_last(corpora.documents(spark, sf_dir), MANY_LAST)
    return tagged.select("relative_path", "is_process_last", F.col("process_last_order").cast("bigint").alias("process_last_order"))


def document_order(spark, sf_dir):
    tagged = select.tag_last(corpora.documents(spark, sf_dir), LAST)
    keys = order.store_keys(order.with_order_key(tagged), "relative_path")
    return order.number_rows(keys, order.plan_slices(keys), keys).select("relative_path", "position")


def order_per_language(spark, sf_dir):
    rows = order.with_order_key(corpora.documents(spark, sf_dir, keep=("lang",)), ["lang"])
    keys = order.store_keys(rows, "lang", "relative_path")
    return order.number_rows(keys, order.plan_slices(keys), keys).select("lang", "relative_path", "position")


# ---------------------------------------------------------------- content

def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.documents(spark, sf_dir, content=corpora.MIXED_BYTES, keep=("doc_id",))


def binary_filter(spark, sf_dir):
    return _mixed(spark, sf_dir).where(T.is_text(F.col("content"))).select("doc_id", "size")


def text_head(spark, sf_dir):
    return _mixed(spark, sf_dir).select("doc_id", T.is_text_head(F.col("content")).alias("listed"),
                                        T.is_text(F.col("content")).alias("processed"))


def binary_counts(spark, sf_dir):
    rows = process_content(_mixed(spark, sf_dir), Processing(include_binary=True, counts=True, remove_comments=True))
    return rows.select("doc_id", "is_binary", "counts.lines", "counts.characters", "counts.words")


def lossy_decode(spark, sf_dir):
    decoded = T.decode(F.col("content"))
    return _mixed(spark, sf_dir).select("doc_id", F.octet_length(decoded).cast("bigint").alias("bytes"), F.md5(decoded).alias("digest"))


def dry_run(spark, sf_dir):
    files = select.tag_last(_mixed(spark, sf_dir), LAST).where(T.is_text_head(F.col("content"))).drop("content")
    return dry_run_rows(files, Rendering(backticks=True))


def dry_run_exact(spark, sf_dir):
    selection = Selection(last=LAST, extensions=["md", "txt", "rs"], path_regex=["."])
    return Digest(selection).dry_run(_mixed(spark, sf_dir), exact=True)


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.documents(spark, sf_dir, content=corpora.CODE, keep=("doc_id",))


def file_counts(spark, sf_dir):
    return process_content(_code(spark, sf_dir), Processing(counts=True)).select(
        "doc_id", "counts.lines", "counts.characters", "counts.words")


def page_counts(spark, sf_dir):
    """Raw web pages as content."""
    pages = corpora.corpus_from_table(corpora.table(spark, sf_dir, "pages"), "url", "html", keep=("page_id",))
    return process_content(pages, Processing(counts=True)).select("page_id", "counts.lines", "counts.characters", "counts.words")


def remove_comments(spark, sf_dir):
    return process_content(_code(spark, sf_dir), Processing(remove_comments=True)).select("doc_id", "processed_content")


def remove_empty_lines(spark, sf_dir):
    return process_content(_code(spark, sf_dir), Processing(remove_empty_lines=True)).select("doc_id", "processed_content")


def filter_chain(spark, sf_dir):
    own = lambda text: F.replace(text, F.lit("note"), F.lit("// own"))
    processing = Processing(filters=[own], remove_comments=True, remove_empty_lines=True, counts=True)
    return process_content(_code(spark, sf_dir), processing).select("doc_id", "processed_content", "counts.words")


def python_content_filter(spark, sf_dir):
    shout = python_filter(lambda text: text.replace("note", "NOTE"), "shout")
    return process_content(_code(spark, sf_dir), Processing(filters=[shout], remove_comments=True)).select(
        "doc_id", "processed_content")


def processed_rows(spark, sf_dir):
    """Every stage on a content table, as data."""
    digest = Digest(Selection(last=LAST, skip_lockfiles=True), Processing(counts=True, remove_comments=True, remove_empty_lines=True))
    rows = digest.execute(_code(spark, sf_dir), RULES)
    return rows.select("relative_path", "absolute_path", "size", "processed_content", "counts.lines", "counts.characters",
                       "counts.words", "is_process_last", F.col("process_last_order").cast("bigint").alias("process_last_order"),
                       "is_binary")


# ---------------------------------------------------------------- rendering

def path_parts(spark, sf_dir):
    path = F.col("relative_path")
    return corpora.documents(spark, sf_dir).select(
        "relative_path", paths.basename(path).alias("name"), paths.extension(path).alias("extension"),
        paths.dirname(path).alias("folder"), paths.depth(path).cast("bigint").alias("depth"),
        paths.display(F.concat(path, F.lit("\\x")), backticks=True).alias("shown"))


def text_lines(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", F.posexplode(T.lines(T.decode(F.col("content")))).alias("at", "line")).select(
        "doc_id", F.col("at").cast("bigint").alias("at"), "line")


def line_numbers(spark, sf_dir):
    return _code(spark, sf_dir).select("doc_id", T.numbered(T.decode(F.col("content"))).alias("numbered"))


def _code_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed rows of which some lost their content and some their counts."""
    rows = process_content(_code(spark, sf_dir), Processing(counts=True))
    return (rows.withColumn("processed_content", F.when(F.col("doc_id") % 19 != 0, F.col("processed_content")))
            .withColumn("counts", F.when(F.col("doc_id") % 23 != 0, F.col("counts")))
            .withColumn("is_binary", F.col("doc_id") % 10 == 0))


def file_blocks(spark, sf_dir):
    return render.with_blocks(_code_processed(spark, sf_dir), Rendering()).select("doc_id", "block")


def blocks_filename_only(spark, sf_dir):
    style = Rendering(filename_only=True, line_numbers=True, backticks=True, ticks=5)
    return render.with_blocks(_code_processed(spark, sf_dir), style).select("doc_id", "block")


def summary_lines(spark, sf_dir):
    return render.with_blocks(_code_processed(spark, sf_dir), Rendering(counts=True)).select("doc_id", "summary_line")


# ---------------------------------------------------------------- documents

def ordered_document(spark, sf_dir):
    digest = Digest(Selection(last=LAST), Processing(counts=True), Rendering(counts=True))
    return digest.document(corpora.documents(spark, sf_dir))


def plain_document(spark, sf_dir):
    return Digest().document(corpora.documents(spark, sf_dir))


def repository_documents(spark, sf_dir):
    """A document per language, each under the rules of its own."""
    corpus = corpora.documents(spark, sf_dir, corpora.INNER_PATH, keep=("lang",))
    return Digest().document(corpus, rule_table(spark, sf_dir), scope=["lang"], group=["lang"])


def odd_groups(spark, sf_dir):
    """Groups of two columns that hold NULL, empty texts and the marks that keys are made of."""
    docs = corpora.table(spark, sf_dir, "documents").withColumns({"one": F.expr(corpora.ODD_ONE), "two": F.expr(corpora.ODD_TWO)})
    rows = process_content(corpora.corpus_from_table(docs, F.expr(corpora.PATH), "text", keep=("one", "two")), Processing(counts=True))
    return group_documents(rows, ["one", "two"], Rendering(counts=True))


def tied_copies(spark, sf_dir):
    """Copies of one path beside paths below it, told apart by a column that is sometimes NULL."""
    docs = corpora.table(spark, sf_dir, "documents").withColumns({"tie": F.expr(corpora.ODD_ONE), "id": F.format_string("%019d", "doc_id")})
    rows = corpora.corpus_from_table(docs, F.expr(corpora.COPIED_PATH), "text", keep=("doc_id", "tie", "id"))
    keys = order.store_keys(order.with_order_key(rows, ties=["tie", "id"]), "doc_id")
    return order.number_rows(keys, order.plan_slices(keys), keys).select("doc_id", "position")


def _conversation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return process_content(corpora.conversations(spark, sf_dir), Processing(counts=True))


def digest_per_group(spark, sf_dir):
    return group_documents(_conversation_rows(spark, sf_dir), ["conv_id"], Rendering())


def digest_per_group_summary(spark, sf_dir):
    return group_documents(_conversation_rows(spark, sf_dir), ["conv_id"], Rendering(counts=True))


def group_document_rows(spark, sf_dir):
    return document_rows(_conversation_rows(spark, sf_dir), Rendering(), ["conv_id"])


def _numbered_lines(spark: SparkSession, folder: str, *group: str) -> DataFrame:
    """`(group..., line, value)`: the lines of part files, counted from 1 in the order of names, per group."""
    lines = spark.read.option("lineSep", "\n").text(folder).select(
        *group, "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"))
    lines = stored(lines, "lines")  # the ids are those of one reading
    files = lines.groupBy(*group, "file").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.join(files.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), [*group, "file"])
    within = Window.partitionBy(*group, "file").orderBy("start", "id")
    return placed.select(*group, (F.col("base") + F.row_number().over(within)).alias("line"), "value")


def _numbered_group_lines(spark: SparkSession, folder: str, group: str) -> DataFrame:
    """`(group, line, value)` of group documents on a mounted file system, groups as in the folder names. Tasks list and read the files; lines stay where they are read."""
    files = list_files(spark, local_folder(spark, folder)).where("not relative_path rlike '(^|/)[._][^/]*$'")
    lines = stored(read_lines(files).select(
        F.regexp_extract("relative_path", f"^{group}=([^/]*)/", 1).alias(group), F.col("relative_path").alias("file"), "at", F.col("line").alias("value")), "lines")
    before = Window.partitionBy(group).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = lines.groupBy(group, "file").agg(F.count("*").alias("n")).select("file", F.sum("n").over(before).alias("base")).where("base > 0")
    placed = lines.join(stored_for_join(bases, "bases"), "file", "left")
    return placed.select(group, (F.coalesce("base", F.lit(0)) + F.col("at") + 1).alias("line"), "value")


def written_document(spark, sf_dir):
    """The document as written to text files, read back line by line."""
    folder = new_table_path(spark, "document")
    Digest(Selection(), Processing(counts=True), Rendering(counts=True)).write(corpora.documents(spark, sf_dir), folder)
    return _numbered_lines(spark, folder)


def kept_document(spark, sf_dir):
    """A run that selects nothing says so and leaves the document that an earlier one wrote."""
    folder, corpus = new_table_path(spark, "document"), corpora.documents(spark, sf_dir)
    style = {"processing": Processing(counts=True), "rendering": Rendering(counts=True)}
    Digest(**style).write(corpus, folder)
    try:
        Digest(Selection(extensions=["nowhere"]), **style).write(corpus, folder)
    except NoFilesError:
        return _numbered_lines(spark, folder)
    raise AssertionError("a selection of nothing was written")


def printed_document(spark, sf_dir):
    """What printing fetches, slice by slice: positions are those of the partitions and of the rows in them, not of any sort key."""
    rows = Digest().execute(corpora.documents(spark, sf_dir))
    fetched = fetches(rows, Rendering(), fetch_bytes=64 << 10).withColumn("id", F.monotonically_increasing_id())
    fetched = stored(fetched.withColumns({"at": F.shiftright("id", 33), "row": F.col("id").bitwiseAND((1 << 33) - 1)}), "fetched")
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = fetched.groupBy("at").agg(F.count("*").alias("n")).select("at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    position = F.col("start") + F.col("row") + 1
    return fetched.join(starts, "at").select(position.alias("position"), set_off(F.col("text"), F.col("section"), position > 1).alias("text"))


def written_group_documents(spark, sf_dir):
    folder = new_table_path(spark, "group-documents")
    write_group_documents(_conversation_rows(spark, sf_dir), folder, "conv_id", Rendering())
    lines = (_numbered_lines if local_folder(spark, folder) is None else _numbered_group_lines)(spark, folder, "conv_id")
    # Marked where some are NULL.
    return lines.withColumn("conv_id", F.nullif(F.regexp_extract(F.col("conv_id").cast("string"), "-?[0-9]+$", 0), F.lit("")).cast("bigint"))


def json_format(spark, sf_dir):
    """Own output format over ordered rows, written and read back."""
    def as_json(rows: DataFrame) -> DataFrame:
        return rows.select(F.to_json(F.struct(F.col("relative_path").alias("path"), "size")).alias("value"))

    folder = new_table_path(spark, "formatted")
    write_formatted(process_content(corpora.documents(spark, sf_dir), Processing()), as_json, folder)
    return _numbered_lines(spark, folder)


# ---------------------------------------------------------------- snapshots and repositories

REFS = """inline(array(
    named_struct('kind', 'head', 'name', case when source = 'src3' then null else 'main' end, 'commit', cast(null as string)),
    named_struct('kind', 'branch', 'name', case when source = 'src4' then 'trunk' else 'main' end, 'commit', concat('c', substr(source, 4), '_main')),
    named_struct('kind', 'branch', 'name', 'release', 'commit', concat('c', substr(source, 4), '_release')),
    named_struct('kind', 'tag', 'name', 'release', 'commit', concat('c', substr(source, 4), '_tagged')),
    named_struct('kind', 'tag', 'name', 'v1', 'commit', concat('c', substr(source, 4), '_v1'))))"""


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = corpora.table(spark, sf_dir, "documents").select("source").distinct()
    return sources.selectExpr("concat('repo_', source) repo", REFS)


def _ref_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpora.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "concat('repo_', source) repo",
        "case doc_id % 5 when 0 then 'release' when 1 then 'v1' when 2 then 'nope' when 3 then 'main' else null end name")


def ref_resolution(spark, sf_dir):
    return snapshots.resolve_refs(_ref_requests(spark, sf_dir), _refs(spark, sf_dir))


def checked_out(spark, sf_dir):
    """Files of the commits that were asked for."""
    versions = corpora.documents(spark, sf_dir, keep=("source", "doc_id")).selectExpr(
        "concat('repo_', source) repo",
        "concat('c', substr(source, 4), case doc_id % 4 when 0 then '_main' when 1 then '_release' when 2 then '_tagged' else '_v1' end) commit",
        "relative_path", "content")
    resolved = snapshots.resolve_refs(_ref_requests(spark, sf_dir), _refs(spark, sf_dir))
    return snapshots.check_out(resolved, versions).selectExpr("repo", "commit", "relative_path", "cast(content as string) content")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = corpora.documents(spark, sf_dir, keep=("doc_id",))
    old = docs.where("doc_id % 7 <> 0")
    new = docs.where("doc_id % 9 <> 0").withColumn(
        "content", F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit(b"edit"))).otherwise(F.col("content")))
    return old, new.withColumn("size", F.octet_length("content").cast("bigint"))


def snapshot_diff(spark, sf_dir):
    return snapshots.snapshot_diff(*_versions(spark, sf_dir))


def snapshot_refresh(spark, sf_dir):
    """A held corpus brought up to date; rows that did not change are the held ones, with what only they know."""
    held, source = _versions(spark, sf_dir)
    held = held.withColumn("size", -F.col("size"))
    refreshed, _ = snapshots.refresh(held, source)
    return refreshed.selectExpr("relative_path", "cast(content as string) content", "size", "origin")


def _compared(spark: SparkSession, held: DataFrame, source: DataFrame) -> DataFrame:
    places = new_table_path(spark, "held-digests"), new_table_path(spark, "source-digests")
    for version, place in zip((held, source), places):
        write_snapshot(version, place)
    return compare_snapshots(spark, *places)


def snapshot_descent(spark, sf_dir):
    """Changes between two versions, found from the digests of their folders."""
    return _compared(spark, *_versions(spark, sf_dir))


def snapshot_descent_refresh(spark, sf_dir):
    """A held corpus brought up to date with those changes."""
    held, source = _versions(spark, sf_dir)
    refreshed = refresh_changed(held.withColumn("size", -F.col("size")), source, _compared(spark, held, source))
    return refreshed.selectExpr("relative_path", "cast(content as string) content", "size", "origin")


def url_normalise(spark, sf_dir):
    parsed = repos.parse_urls(corpora.page_urls(spark, sf_dir), "url", "hint", prefer_download=True)
    return parsed.drop("hint")


def url_dedup(spark, sf_dir):
    return repos.distinct_repositories(repos.parse_urls(corpora.page_urls(spark, sf_dir)).where("clone_url is not null"), "clone_url")


def input_kinds(spark, sf_dir):
    pages = corpora.page_urls(spark, sf_dir)
    return pages.select("page_id", urls.is_git_url(F.col("url")).alias("is_git"), urls.input_kind(F.col("url")).alias("kind"))


# ---------------------------------------------------------------- file trees

def _store_files(root: str):
    def store(batches):
        for batch in batches:
            for path, content in zip(batch["relative_path"], batch["content"]):  # one at a time, so that no list holds them all once more
                target = os.path.join(root, path.as_py())
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"stored": [batch.num_rows]})

    return store


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """The documents as a file tree below the shared folder."""
    root = mounted_path(new_table_path(spark, "tree"))
    files = _mixed(spark, sf_dir).select("relative_path", "content")
    files.mapInArrow(_store_files(root), "stored bigint").agg(F.sum("stored")).collect()
    return root


def tree_listing(spark, sf_dir):
    return list_files(spark, _tree(spark, sf_dir)).select("relative_path", "size")


def tree_unignored(spark, sf_dir):
    """A tree with its ignore files, walked without entering what they ignore; the ignore files themselves are left out of the result."""
    root = _tree(spark, sf_dir)
    for kind, base in dict.fromkeys((rule[0], rule[1]) for rule in RULES):
        with open(os.path.join(root, base, f".{kind}"), "w", encoding="utf-8") as f:
            f.write("\n".join(rule[3] for rule in RULES if rule[:2] == (kind, base)))
    return list_unignored(spark, root).where("not relative_path rlike '(^|/)[.](git)?ignore$'").select("relative_path", "size")


def tree_source(spark, sf_dir):
    """The tree read as a data source, whose walk takes the filters."""
    register_tree_source(spark)
    rows = spark.read.format("corpus_tree").option("content", "true").load(_tree(spark, sf_dir))
    found = rows.where("depth <= 3 and size <= 2000 and relative_path like 'en/%' and not name like '%.log'")
    return found.select("relative_path", "depth", "size", F.md5("content").alias("digest"), "error")


def tree_chunks(spark, sf_dir):
    """Text test and counts of files that are read in chunks of a few hundred bytes, as files beyond any value are in larger ones."""
    chunks = read_chunks(list_files(spark, _tree(spark, sf_dir)), 700)
    files, _ = process_chunks(chunks, Processing(counts=True, include_binary=True))
    return files.select("relative_path", "is_binary", "counts.lines", "counts.characters", "counts.words")


def tree_contents(spark, sf_dir):
    contents = read_contents(list_files(spark, _tree(spark, sf_dir)), on_error="keep")
    return contents.select("relative_path", F.md5("content").alias("digest"), "error")


def tree_digest(spark, sf_dir):
    """Listing, pruning, late reading and processing of a file tree."""
    digest = Digest(Selection(ignore_globs=["*.log", "*/target"], skip_lockfiles=True), Processing(counts=True))
    rows = digest.execute_tree(spark, _tree(spark, sf_dir))
    return rows.select("relative_path", "size", "counts.lines", "counts.characters", "counts.words")


def single_file(spark, sf_dir):
    """The longest file of a tree, named outright: its path is its name, globs and ignore rules do not apply to it, other predicates do."""
    root = _tree(spark, sf_dir)
    longest = list_files(spark, root).orderBy(F.desc("size"), "relative_path").first().relative_path
    digest = Digest(Selection(ignore_globs=["*"], max_size="1GB", last=["*"]), Processing(counts=True, include_binary=True))
    rows = digest.execute_tree(spark, os.path.join(root, longest))
    return rows.select("relative_path", "size", "is_process_last", "is_binary", "counts.lines", "counts.characters", "counts.words")


def unreadable_files(spark, sf_dir):
    """Files that are gone when they are read stay apart from the others."""
    listing = list_files(spark, _tree(spark, sf_dir))
    gone = F.when(F.col("relative_path").rlike("[05]/"), F.concat("absolute_path", F.lit(".gone"))).otherwise(F.col("absolute_path"))
    good, bad = split_errors(read_contents(listing.withColumn("absolute_path", gone), on_error="keep"))
    return (good.select("relative_path", F.md5("content").alias("digest"), F.lit(False).alias("failed"))
            .unionByName(bad.select("relative_path", F.lit(None).cast("string").alias("digest"), F.lit(True).alias("failed"))))


# ---------------------------------------------------------------- streams

def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of them. A stream takes a path as a base folder, unless it is a pattern."""
    schema = corpora.table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    return stream.select(F.expr(corpora.PATH).alias("relative_path"), F.expr(corpora.CODE).cast("binary").alias("content"))


_STREAMED = Digest(Selection(last=LAST), Processing(counts=True, remove_comments=True, remove_empty_lines=True), Rendering(counts=True))
# A list far longer than a table: rules without effect, of both outcomes.
LONG_RULES = RULES + ignore.rules_from_lines([f"{'!' if k % 5 == 0 else ''}*.none{k}" for k in range(1200)])


def stream_clean(spark, sf_dir):
    folder = new_table_path(spark, "stream")
    query = start_clean_table(_document_stream(spark, sf_dir), _STREAMED, f"{folder}/rows", f"{folder}/state", RULES, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("relative_path", "processed_content", "counts.lines", "counts.words")


def stream_clean_rule_table(spark, sf_dir):
    """A rule table joined inside each micro-batch."""
    folder = new_table_path(spark, "stream")
    rules = spark.createDataFrame(list(RULES), "kind string, base string, seq int, pattern string")
    query = start_clean_table(_document_stream(spark, sf_dir), _STREAMED, f"{folder}/rows", f"{folder}/state", rules, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("relative_path", "processed_content", "counts.lines", "counts.words")


def stream_documents(spark, sf_dir):
    """The document of each micro-batch, read back line by line."""
    folder = new_table_path(spark, "stream")
    query = start_batch_documents(_document_stream(spark, sf_dir), _STREAMED, f"{folder}/documents", f"{folder}/state", available_now=True)
    query.awaitTermination()
    return _numbered_lines(spark, f"{folder}/documents")


def stream_clean_long_rules(spark, sf_dir):
    """Far more than a thousand rules as one column of a stream."""
    folder = new_table_path(spark, "stream")
    query = start_clean_table(_document_stream(spark, sf_dir), _STREAMED, f"{folder}/rows", f"{folder}/state", LONG_RULES, available_now=True)
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows").select("relative_path", "processed_content", "counts.lines", "counts.words")


QUERIES = {fn.__name__: fn for fn in (
    ext_filter, size_filter, size_literal, given_sizes, path_regex, path_exclude_regex, filename_regex, lockfile_skip, lockfiles_any_case,
    combined_filters, ignore_globs, vcs_dir_skip, vcs_dir_wanted, non_recursive, ignore_rules, ignore_rules_off,
    ignore_rules_override, ignore_rule_table, rules_in_corpus, process_last, process_last_many, only_last, document_order, order_per_language,
    binary_filter, text_head, binary_counts, lossy_decode, dry_run, dry_run_exact, file_counts, page_counts, remove_comments,
    remove_empty_lines, filter_chain, python_content_filter, processed_rows, path_parts, text_lines, line_numbers,
    file_blocks, blocks_filename_only, summary_lines, ordered_document, plain_document, repository_documents, odd_groups, tied_copies, digest_per_group,
    digest_per_group_summary, group_document_rows, written_document, kept_document, printed_document, written_group_documents, json_format,
    ref_resolution, checked_out, snapshot_diff, snapshot_refresh, snapshot_descent, snapshot_descent_refresh, url_normalise, url_dedup, input_kinds,
    tree_listing, tree_unignored, tree_source, tree_chunks, tree_contents, tree_digest, single_file, unreadable_files, stream_clean, stream_clean_rule_table,
    stream_clean_long_rules, stream_documents)}
