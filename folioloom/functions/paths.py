"""Path columns: pure Catalyst expressions, safe inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"  # never part of a file name, and sorts before every other byte


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Parent folder, `''` for an entry of the root."""
    name = basename(path)
    return F.substr(path, F.lit(1), F.greatest(F.length(path) - F.length(name) - 1, F.lit(0)))


def extension(path: Column) -> Column:
    """Text after the last dot of the name; NULL without one or when only the leading dot is there."""
    name = basename(path)
    return F.when(F.contains(F.substr(name, F.lit(2)), F.lit(".")), F.substring_index(name, ".", -1))


def display(path: Column, backticks: bool = False) -> Column:
    shown = F.translate(path, "\\", "/")
    return F.concat(F.lit("`"), shown, F.lit("`")) if backticks else shown


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def prefixes(path: Column) -> Column:
    """Every leading part of the path, the path itself last: `a`, `a/b`, `a/b/c`."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def component_key(path: Column) -> Column:
    """String whose byte order is the component-wise order of the path (`a/b` < `a-b/c` < `a.txt`)."""
    return F.replace(path, F.lit("/"), F.lit(NUL))


def order_key(path: Column, is_last: Column, last_order: Column) -> Column:
    """One string that sorts rows in document order: normal files first, then by pattern index, then by path."""
    return F.concat(
        F.when(is_last, "1").otherwise("0"),
        F.lpad(F.coalesce(last_order + 1, F.lit(0)).cast("string"), 10, "0"),
        component_key(path),
    )
