"""Ignore rules of a tree that do not lie in its listing: the exclude file, folders above the root, the user's global file."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

Rule = tuple[str, str, int, str]
# Between the lines of two files, so that a file nearer to the root is stronger.
_FILE_STEP = 1_000_000


def _lines(path: str) -> list[str]:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().split("\n")
    except (FileNotFoundError, IsADirectoryError, NotADirectoryError, PermissionError):
        return []


def _below(line: str, folders: list[str]) -> str | None:
    """The line of a file that lies `folders` above the root, as if it stood in the root; None if it cannot apply there."""
    mark = "!" if line.startswith("!") else ""
    pattern = line[len(mark):].rstrip()
    parts = pattern.strip("/").split("/")
    if pattern.startswith("#") or "/" not in pattern.rstrip("/"):
        return line  # a comment, or a name that counts at any depth
    for folder in folders:
        if not parts or parts[0] == "**":
            break
        if not fnmatch.fnmatchcase(folder, parts[0].replace("\\", "")):
            return None
        parts = parts[1:]
    return f"{mark}/{'/'.join(parts)}{'/' if pattern.endswith('/') else ''}" if parts else None


def _folders_above(root: str) -> Iterator[tuple[str, list[str]]]:
    """Folders above `root` up to the one that holds `.git`, nearest first, with the names between; none outside a repository."""
    found, names, folder = [], [], root
    while not os.path.exists(os.path.join(folder, ".git")):
        above = os.path.dirname(folder)
        if above == folder:
            return
        names = [os.path.basename(folder), *names]
        folder = above
        found.append((folder, names))
    yield from found


def outer_rules(root: str) -> list[Rule]:
    """Rules for paths below `root`, weakest files first within a kind. Read on the driver: a few small files."""
    rules: list[Rule] = []
    config = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    rules += [("global", "", k, line) for k, line in enumerate(_lines(os.path.join(config, "git", "ignore")))]
    above = list(_folders_above(root))
    top, names = above[-1] if above else (root, [])
    rules += [("exclude", "", k, moved) for k, line in enumerate(_lines(os.path.join(top, ".git", "info", "exclude"))) if (moved := _below(line, names)) is not None]
    for level, (folder, between) in enumerate(reversed(above)):
        for name, kind in ((".gitignore", "above"), (".ignore", "above-ignore")):
            moved = [(k, _below(line, between)) for k, line in enumerate(_lines(os.path.join(folder, name)))]
            rules += [(kind, "", level * _FILE_STEP + k, line) for k, line in moved if line is not None]
    return [rule for rule in rules if re.search(r"\S", rule[3])]
