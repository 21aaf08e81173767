"""Long pattern lists: a path meets only the patterns whose literal part it has.

Most globs fix leading folders, trailing components or an extension. Such a pattern is filed under that text, and each kind of key is one
broadcast join on the same part of the path, so what a path is tried against does not grow with the list. Keys are unique, so the joins
are narrow, keep every row once, and work on streams.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioloom.functions.patterns import glob_literals, selection_globs
from folioloom.operators.skew import BROADCAST_BYTES

#: Kind of key and, for folders and endings, the number of components.
Probe = tuple[str, int]


def glob_key(pattern: str) -> tuple[Probe, str, bool] | None:
    """Where a glob is filed, under which text, and whether having that text decides; None when nothing in it is fixed.

    The longer of leading folders and trailing components is taken, then the extension.
    """
    head, tail, whole = glob_literals(pattern)
    if whole:
        deep = "/" not in pattern and "\\" not in pattern
        return ("end" if deep else "start", pattern.count("/") + 1), pattern, deep
    start, end = head.rpartition("/")[0], tail.partition("/")[2]
    if "/" not in head:
        start = ""
    if start or end:
        kind, key = ("start", start) if len(start) >= len(end) else ("end", end)
        return (kind, key.count("/") + 1), key, False
    dot, ext = tail.rpartition(".")[1:]
    if dot and "/" not in ext:
        return ("extension", 0), ext, pattern == "*." + ext
    return None


def _part(path: Column, probe: Probe) -> Column:
    kind, components = probe
    if kind == "extension":
        return F.when(F.contains(path, F.lit(".")), F.substring_index(path, ".", -1))
    return F.substring_index(path, "/", components if kind == "start" else -components)


def file_patterns(patterns: Sequence[str]) -> tuple[dict[Probe, dict[str, list[tuple[int, str | None]]]], list[tuple[int, str]]]:
    """Patterns by probe and key, each with its index and the regex that must hold too, and those that every path must try."""
    filed, scanned = defaultdict(lambda: defaultdict(list)), []
    for index, regex in dict(selection_globs(patterns)).items():
        key = glob_key(patterns[index])
        if key is None:
            scanned.append((index, regex))
        else:
            probe, text, decided = key
            filed[probe][text].append((index, None if decided else regex))
    return filed, scanned


def first_pattern(rows: DataFrame, path: str, patterns: Sequence[str], found: str) -> DataFrame:
    """`rows` with the int column `found`: index of the first glob that matches `path`, NULL when none does.

    A NULL path matches none. Equal to trying all globs in turn. Lists are options on the driver; the table of one probe is
    broadcast if its texts fit the bound of every broadcast.
    """
    filed, scanned = file_patterns(patterns)
    out, hits = rows, []
    for n, (probe, keys) in enumerate(sorted(filed.items())):
        key, candidates = f"_pattern_key_{n}", f"_patterns_{n}"
        table = rows.sparkSession.createDataFrame([(k, v) for k, v in keys.items()], f"{key} string, {candidates} array<struct<index:int,regex:string>>")
        size = sum(200 + 4 * len(k) + sum(40 + 4 * len(regex or "") for _, regex in v) for k, v in keys.items())
        table = F.broadcast(table) if size <= BROADCAST_BYTES else table
        out = out.join(table, _part(F.col(path), probe) == F.col(key), "left").drop(key)
        fits = F.filter(candidates, lambda c: c["regex"].isNull() | F.rlike(F.col(path), c["regex"]))
        hits.append((candidates, F.array_min(F.transform(fits, lambda c: c["index"]))))
    tried = [F.when(F.col(path).rlike(regex), F.lit(index)) for index, regex in scanned]
    none = F.lit(None).cast("int")
    first = F.least(none, F.coalesce(*tried, none), *[hit for _, hit in hits])
    return out.withColumn(found, first).drop(*[candidates for candidates, _ in hits])
