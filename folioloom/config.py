"""Options of a digest run, validated when they are made."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column

from folioloom.functions.patterns import parse_size

TextFilter = Callable[[Column], Column]
_NO_LIMIT = 2**63


@dataclass(frozen=True)
class Selection:
    """Which files are taken. All predicates must hold."""

    extensions: Sequence[str] | None = None
    exclude_extensions: Sequence[str] | None = None
    max_size: int | str | None = None
    recursive: bool = True
    path_regex: Sequence[str] | None = None
    exclude_path_regex: Sequence[str] | None = None
    filename_regex: Sequence[str] | None = None
    ignore_globs: Sequence[str] | None = None
    use_ignore_rules: bool = True
    skip_lockfiles: bool = False
    lockfiles_any_case: bool = False
    last: Sequence[str] | None = None
    only_last: bool = False
    only: Sequence[str] | None = None

    def __post_init__(self):
        if self.only is not None and (self.last is not None or self.only_last):
            raise ValueError("only excludes last and only_last")
        if self.only_last and self.last is None:
            raise ValueError("only_last needs last")
        limit = parse_size(self.max_size)
        object.__setattr__(self, "max_size", None if limit is None or limit >= _NO_LIMIT else limit)
        for name in ("extensions", "exclude_extensions"):
            values = getattr(self, name)
            if values is not None:
                object.__setattr__(self, name, tuple(v.lower() for v in values))
        if self.only is not None:
            object.__setattr__(self, "last", tuple(self.only))
            object.__setattr__(self, "only_last", True)
            object.__setattr__(self, "only", None)


@dataclass(frozen=True)
class Processing:
    """What happens to the content. Own filters run before the built-in ones, on text rows only."""

    include_binary: bool = False
    counts: bool = False
    filters: Sequence[TextFilter] = field(default_factory=tuple)
    remove_comments: bool = False
    remove_empty_lines: bool = False


@dataclass(frozen=True)
class Rendering:
    """How blocks and summary look."""

    filename_only: bool = False
    line_numbers: bool = False
    backticks: bool = False
    ticks: int = 3
    summary: bool = False
    counts: bool = False

    def __post_init__(self):
        if self.ticks < 3:
            raise ValueError("ticks must be 3 or greater")
        if self.counts:
            object.__setattr__(self, "summary", True)
