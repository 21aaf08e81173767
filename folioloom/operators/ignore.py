"""Ignore-rule files as data.

A rule is one line of an ignore file with the folder (`base`) it sits in. For every path and every folder above it the
rule of the highest source, then the deepest base, then the last line decides; a path is ignored when it or any folder
above it is, because ignored folders are never entered.

Two plans give the same verdict, and the type of the rules chooses. A list becomes a column (`ignored_by`): no shuffle, usable on streams. A
table (many repositories, each with its own files) becomes joins (`ignored_parts`).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from folioloom.functions import paths
from folioloom.functions.patterns import compile_ignore_line, quote
from folioloom.functions.text import decode
from folioloom.operators.skew import fits_broadcast, stored, stored_for_join

# Source kinds from weakest to strongest; the kind outranks the depth of the base. `above` are files in folders above the root.
KINDS = ("global", "exclude", "above", "gitignore", "above-ignore", "ignore", "override")
RULE_FILES = {".gitignore": "gitignore", ".ignore": "ignore"}

RULE_COLUMNS = ("kind", "base", "seq", "pattern")
Rule = tuple[str, str, int, str]


def rules_from_lines(lines: str | Iterable[str], base: str = "", kind: str = "gitignore") -> list[Rule]:
    lines = lines.split("\n") if isinstance(lines, str) else lines
    return [(kind, base, seq, line) for seq, line in enumerate(lines)]


def override_rules(last: Sequence[str] | None) -> list[Rule]:
    """Last/only patterns bring ignored files back, read relative to every folder."""
    return [("override", "", seq, "!" + pattern) for seq, pattern in enumerate(last or ())]


def rules_from_corpus(corpus: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rule table of the ignore files that lie in the corpus itself."""
    path = F.col("relative_path")
    kind = F.when(path == ".git/info/exclude", "exclude")
    for name, value in RULE_FILES.items():
        kind = kind.when(paths.basename(path) == name, value)
    base = F.when(kind == "exclude", "").otherwise(paths.dirname(path))
    return (corpus.where(kind.isNotNull())
            .select(*scope, kind.alias("kind"), base.alias("base"),
                    F.posexplode(F.split(decode(F.col("content")), "\n", -1)).alias("seq", "pattern"))
            .where(F.trim("pattern") != ""))


# ------------------------------------------------------------------ column plan

def ignored_by(path: Column, rules: Sequence[Rule]) -> Column:
    """Verdict column of a driver-held rule list."""
    ranked = sorted(rules, key=lambda r: (KINDS.index(r[0]), len(r[1]), r[2]), reverse=True)
    compiled = []
    for kind, base, _, pattern in ranked:
        line = compile_ignore_line(pattern, anywhere=kind == "override")
        if line:
            compiled.append((line.negated, line.dir_only, (quote(base) + "/" if base else "") + f"(?:{line.body})"))
    if not compiled:
        return F.lit(False)

    def verdict(p: Column) -> Column:
        is_dir = F.length(p) < F.length(path)
        decided = []
        # Neighbours with the same outcome share one regex; only changes of outcome need their order.
        for negated, run in groupby(compiled, key=lambda c: c[0]):
            run = list(run)
            hit = F.lit(False)
            always = [body for _, dir_only, body in run if not dir_only]
            folders = [body for _, dir_only, body in run if dir_only]
            if always:
                hit = hit | p.rlike(rf"(?s)\A(?:{'|'.join(always)})\z")
            if folders:
                hit = hit | (is_dir & p.rlike(rf"(?s)\A(?:{'|'.join(folders)})\z"))
            decided.append(F.when(hit, F.lit(not negated)))
        return F.coalesce(*decided, F.lit(False))

    return F.exists(paths.prefixes(path), verdict)


# ------------------------------------------------------------------ table plan

#: A rule file is worked on in blocks of 2 ^ _BLOCK_BITS lines.
_BLOCK_BITS = 10
_COMPILED = StructType([StructField("body", StringType()), StructField("negated", BooleanType()),
                        StructField("dir_only", BooleanType()), StructField("probe", StringType()),
                        StructField("probe_value", StringType())])


@F.pandas_udf(_COMPILED)
def _compile(patterns: pd.Series, anywhere: pd.Series) -> pd.DataFrame:
    lines = [compile_ignore_line(p, a) for p, a in zip(patterns, anywhere)]
    return pd.DataFrame({
        name: [getattr(line, name) if line else None for line in lines]
        for name in ("body", "negated", "dir_only", "probe", "probe_value")
    })


def compiled_rules(rules: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Rule table with regexes and with `rank`, whose maximum decides; its lowest bit is the verdict."""
    kind = F.array_position(F.lit(list(KINDS)), F.col("kind")) - 1
    rank = (F.shiftleft(kind.cast("bigint"), 58) + F.shiftleft(F.length("base").cast("bigint"), 40)
            + F.shiftleft(F.col("seq").cast("bigint"), 1) + (~F.col("c.negated")).cast("bigint"))
    return (rules.withColumn("c", _compile("pattern", F.col("kind") == "override"))
            .select(*scope, "base", "c.body", "c.dir_only", "c.probe", "c.probe_value", rank.alias("rank")))


def _combined(rules: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The rules with their regexes put together, where nothing of the other outcome lies between them.

    Within one kind and folder ranks are consecutive for every path, so a run of one outcome may share its highest rank, and so may any piece
    of a run. Runs end with the block of lines they are in: a rule file of any length spreads over tasks, and no regex is put together
    from more lines than a block has. What a path is tried against thus grows with the changes of outcome and the blocks, not with the rules.
    """
    block = F.shiftright("rank", 1 + _BLOCK_BITS).alias("_block")  # of one kind and length of `base`, by the bits above
    rules = rules.select("*", block)
    same_block = Window.partitionBy(*scope, "base", "_block").orderBy("rank")
    outcome = F.col("rank").bitwiseAND(F.lit(1))
    turn = (outcome != F.lag(outcome, 1, -1).over(same_block)).cast("int")
    runs = rules.withColumn("_turn", turn).withColumn("_run", F.sum("_turn").over(same_block.rowsBetween(Window.unboundedPreceding, 0)))
    scans = (runs.where("probe = 'scan'").groupBy(*scope, "base", "_block", "_run", "dir_only")
             .agg(F.concat(F.lit(r"(?s)\A(?:"), F.array_join(F.array_sort(F.collect_list("body")), "|"), F.lit(r")\z")).alias("body"), F.max("rank").alias("rank"))
             .select(*scope, "base", "body", "dir_only", F.lit("scan").alias("probe"), F.lit("").alias("probe_value"), "rank"))
    return runs.where("probe <> 'scan'").select(*scans.columns).unionByName(scans)


def _probes(nodes: DataFrame, scope: Sequence[str]) -> DataFrame:
    """For each node, ruled folder above it and way a rule can be found: the join key of that rule."""
    name = paths.basename(F.col("node"))

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("probe"), value.alias("probe_value"))

    rel = F.when(F.col("base") == "", F.col("node")).otherwise(F.substr("node", F.length("base") + 2))
    keys = F.array(entry("name", name), entry("path", F.col("rel")), entry("scan", F.lit("")),
                   entry("suffix", F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))))
    return (nodes.select(*scope, "node", "is_dir", F.explode("bases").alias("base")).withColumn("rel", rel)
            .select(*scope, "node", "is_dir", "base", "rel", F.inline(keys))
            .where("probe_value is not null"))


def prepared_rules(rules: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """A rule table as paths are tried against it: compiled, put together and stored."""
    return stored_for_join(_combined(compiled_rules(rules, scope).where("body is not null"), scope), "rules")


def verdicts(below: DataFrame, rules: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes whose own deciding rule ignores them, of `node`, `is_dir` and `bases`, the folders at or above it that have rules.

    Most rules are found by equality, the rest by regex.
    """
    hits = (_probes(below, scope).join(rules, [*scope, "base", "probe", "probe_value"])
            .where(F.col("is_dir") | ~F.col("dir_only")))
    # What equality has found needs no regex. A regex that is a column is compiled anew only where it differs from the row before.
    found = hits.where((F.col("probe") != "scan") | (F.regexp_instr("rel", "body") > 0))
    decided = found.groupBy(*scope, "node", "is_dir").agg(F.max("rank").alias("rank"))
    return decided.where("rank & 1 = 1").drop("rank")


@dataclass(frozen=True)
class PreparedRules:
    """A rule table that has been compiled and stored, for use with many corpora."""

    table: DataFrame

    @staticmethod
    def of(rules: DataFrame, scope: Sequence[str] = ()) -> PreparedRules:
        return PreparedRules(prepared_rules(rules, scope))


def ignored_parts(files: DataFrame, rules: DataFrame, scope: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What the prepared rules ignore: folders that are not entered, and single files outside of the folder question.

    `(scope, folder)` and `(scope, relative_path)`, both distinct, stored, and marked for broadcast if they are small. An ignored folder stands for all its files,
    so the results stay small where the rules cut most. Paths are read from the corpus once and stored; keys that are hot (the root folder's
    rules, a folder with very many files) are either broadcast by measured size or left to adaptive execution to split.
    """
    scope = list(scope)
    rules = F.broadcast(rules) if fits_broadcast(rules) else rules
    files = stored(files.select(*scope, "relative_path"), "paths")
    # Folders are far fewer than files, so everything about folders is settled on their distinct set.
    folders = (files.select(*scope, paths.dirname(F.col("relative_path")).alias("folder")).distinct()
               .where("folder <> ''"))
    above = stored(folders.select(*scope, "folder", F.explode(paths.prefixes(F.col("folder"))).alias("node")), "folders")
    dir_nodes = above.select(*scope, "node").distinct().withColumn("is_dir", F.lit(True))
    file_nodes = files.select(*scope, F.col("relative_path").alias("node"), F.lit(False).alias("is_dir"))
    # Which folders have rules at or above them: all that follows looks at nothing else.
    bases = rules.select(*scope, "base").distinct()
    parents = above.select(*scope, F.col("node").alias("_folder")).unionByName(files.select(*scope, F.lit("").alias("_folder"))).distinct()
    ruled = (parents.select(*scope, "_folder", F.explode(F.when(F.col("_folder") == "", F.array(F.lit(""))).otherwise(
        F.concat(F.array(F.lit("")), paths.prefixes(F.col("_folder"))))).alias("base")).join(bases, [*scope, "base"])
        .groupBy(*scope, "_folder").agg(F.collect_list("base").alias("bases")))
    ruled = stored_for_join(ruled, "ruled-folders")

    def decided(nodes: DataFrame) -> DataFrame:
        # Nodes below no ruled folder drop out here.
        return verdicts(nodes.withColumn("_folder", paths.dirname(F.col("node"))).join(ruled, [*scope, "_folder"]), rules, scope)

    ignored_dirs = stored_for_join(decided(dir_nodes).drop("is_dir"), "ignored-nodes")
    blocked = above.join(ignored_dirs, [*scope, "node"], "left_semi").select(*scope, "folder").distinct()
    own = decided(file_nodes).select(*scope, F.col("node").alias("relative_path"))
    return stored_for_join(blocked, "ignored-folders"), stored_for_join(own, "ignored-files")


def drop_ignored(corpus: DataFrame, rules: Sequence[Rule] | DataFrame | PreparedRules, scope: Sequence[str] = (),
                 last: Sequence[str] | None = None) -> DataFrame:
    """Corpus without ignored files; `last` patterns bring theirs back.

    A list is a narrow filter, however long it is, and holds in every scope. A table is resolved right away by joins that
    carry only paths; the corpus meets their stored results in anti-joins.
    """
    back = override_rules(last)
    if not isinstance(rules, (DataFrame, PreparedRules)):
        return corpus.where(~ignored_by(F.col("relative_path"), [*map(tuple, rules), *back]))
    table = (rules if isinstance(rules, PreparedRules) else PreparedRules.of(rules, scope)).table
    if back:  # the same patterns hold in every scope; no other rules are of their kind, so they may be prepared apart
        patterns = F.posexplode(F.lit([pattern for *_, pattern in back])).alias("seq", "pattern")
        scopes = corpus.select(*scope).distinct() if scope else corpus.sparkSession.range(1).select()
        table = table.unionByName(prepared_rules(scopes.select("*", patterns).withColumn("kind", F.lit("override")).withColumn("base", F.lit("")), scope))
    folders, single = ignored_parts(corpus, table, scope)
    inside = corpus.withColumn("_folder", paths.dirname(F.col("relative_path")))
    outside = inside.join(folders.withColumnRenamed("folder", "_folder"), [*scope, "_folder"], "left_anti").drop("_folder")
    return outside.join(single, [*scope, "relative_path"], "left_anti")
