"""Selection predicates as columns, and their conjunction.

The conjuncts are written from cheap to dear: fixed comparisons first, regexes last.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.config import Selection
from folioloom.functions import paths
from folioloom.functions.lockfiles import is_lockfile
from folioloom.functions.patterns import selection_globs, user_regex
from folioloom.operators.pattern_index import first_pattern

#: Last patterns up to this number are one expression; more are looked up by their literal parts, with the same result.
EXPRESSED_PATTERNS = 32

_compiled: set[str] = set()  # regexes that are known to compile


def check_regexes(spark: SparkSession, selection: Selection) -> None:
    """Raise ValueError for a regex that does not compile, before any data is read."""
    for option in ("path_regex", "exclude_path_regex", "filename_regex"):
        for pattern in getattr(selection, option) or ():
            if pattern in _compiled:
                continue
            try:
                spark.sql("select '' rlike :pattern", args={"pattern": user_regex(pattern)}).collect()
            except PySparkException as e:
                raise ValueError(f"Invalid {option}: {pattern!r}") from e
            _compiled.add(pattern)


def any_match(text: Column, regexes) -> Column:
    return reduce(or_, [text.rlike(r) for r in regexes], F.lit(False))


def passes_extensions(path: Column, include=None, exclude=None) -> Column:
    """An excluded extension always loses; without an extension only an include list rejects."""
    ext = F.lower(paths.extension(path))
    ok = F.lit(True)
    if exclude is not None:
        ok = ok & ~F.coalesce(ext.isin(*exclude), F.lit(False))
    if include is not None:
        ok = ok & F.coalesce(ext.isin(*include), F.lit(False))
    return ok


def passes_path_regexes(path: Column, include=None, exclude=None) -> Column:
    shown = paths.slashed(path)
    ok = F.lit(True)
    if exclude is not None:
        ok = ok & ~any_match(shown, map(user_regex, exclude))
    if include is not None:
        ok = ok & any_match(shown, map(user_regex, include))
    return ok


def passes_name_regexes(path: Column, include) -> Column:
    return any_match(paths.basename(path), map(user_regex, include))


def glob_ignored(path: Column, globs) -> Column:
    """True when the path or any folder above it matches one of the globs."""
    regexes = [regex for _, regex in selection_globs(globs)]
    if not regexes:
        return F.lit(False)
    return F.exists(paths.prefixes(path), lambda p: any_match(p, regexes))


def _names(option: str) -> list[str]:
    """Names in a path, glob or regex: runs of name characters, where an escaped dot is a dot."""
    return re.split(r"[^\w.-]+", option.replace("\\.", "."))


def wants_vcs_folder(root: str | None, last=None, path_regex=None) -> bool:
    """Whether the root, a last pattern or an include regex names `.git` as a token of its own."""
    if root and ".git" in root.split("/"):
        return True
    return any(name.lower() == ".git" for option in (*(last or ()), *(path_regex or ())) for name in _names(option))


def in_vcs_folder(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), ".git")


def last_order(path: Column, patterns) -> Column:
    """Index of the first pattern that matches the path, NULL when none does."""
    found = selection_globs(patterns)
    none = F.lit(None).cast("int")
    return F.coalesce(*[F.when(path.rlike(regex), F.lit(index)) for index, regex in found], none) if found else none


def tag_last(corpus: DataFrame, patterns) -> DataFrame:
    """Sets `is_process_last` and `process_last_order`; without patterns present values are kept."""
    if patterns is None and "is_process_last" in corpus.columns:
        if "process_last_order" in corpus.columns:
            return corpus
        return corpus.withColumn("process_last_order", F.lit(None).cast("int"))
    if patterns is not None and len(patterns) > EXPRESSED_PATTERNS:
        tagged = first_pattern(corpus, "relative_path", patterns, "process_last_order")
    else:
        tagged = corpus.withColumn("process_last_order", last_order(F.col("relative_path"), patterns))
    return tagged.withColumn("is_process_last", F.col("process_last_order").isNotNull())


def selected(selection: Selection, has_size: bool = True, root: str | None = None) -> Column:
    """Conjunction of every row-wise predicate (ignore rules are a separate operator)."""
    path, full = F.col("relative_path"), F.col("absolute_path")
    ok = F.lit(True)
    if not selection.recursive:
        ok = ok & ~F.contains(path, F.lit("/"))
    if not wants_vcs_folder(root, selection.last, selection.path_regex):
        ok = ok & ~in_vcs_folder(path)
    if selection.max_size is not None and has_size:
        ok = ok & (F.col("size") <= selection.max_size)
    if selection.extensions is not None or selection.exclude_extensions is not None:
        ok = ok & passes_extensions(full, selection.extensions, selection.exclude_extensions)
    if selection.skip_lockfiles:
        ok = ok & ~is_lockfile(full, selection.lockfiles_any_case)
    if selection.exclude_path_regex is not None or selection.path_regex is not None:
        ok = ok & passes_path_regexes(path, selection.path_regex, selection.exclude_path_regex)
    if selection.filename_regex is not None:
        ok = ok & passes_name_regexes(full, selection.filename_regex)
    if selection.ignore_globs:
        ok = ok & ~glob_ignored(path, selection.ignore_globs)
    return ok


def select_files(corpus: DataFrame, selection: Selection, root: str | None = None) -> DataFrame:
    """Filter and tag. Narrow: no shuffle, and on a stream the same plan."""
    check_regexes(corpus.sparkSession, selection)
    if "absolute_path" not in corpus.columns:
        corpus = corpus.withColumn("absolute_path", F.col("relative_path"))
    if "size" not in corpus.columns and "content" in corpus.columns:
        corpus = corpus.withColumn("size", F.octet_length("content").cast("bigint"))
    tagged = tag_last(corpus.where(selected(selection, "size" in corpus.columns, root)), selection.last)
    return tagged.where("is_process_last") if selection.only_last else tagged
