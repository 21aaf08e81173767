"""Column names beside those that a table brings."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(table: DataFrame, *names: str) -> list[str]:
    """`names`, each with as many underscores before it as it takes to clash with no column, whatever the case."""
    taken = {c.lower() for c in table.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
