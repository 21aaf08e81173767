"""Pattern text to Java regex text.

Patterns are configuration: they are translated once, on the driver (or once per rule row), and the
resulting regex runs inside Catalyst (`rlike`), so no Python touches corpus rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import ROUND_CEILING, Decimal

# Characters with a meaning in a Java regex; a backslash before any of them is always allowed.
_SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}&~\-#]")


def quote(text: str) -> str:
    """Regex that matches `text` literally."""
    return _SPECIAL.sub(r"\\\g<0>", text)


# ---------------------------------------------------------------- byte sizes

_SIZE = re.compile(r"\s*(\d+(?:\.\d+)?)\s*([kmgtpezy]?)(i?)b?\s*", re.I)


def parse_size(size: int | str | None) -> int | None:
    """`10k` = 10 000, `2MiB` = 2 097 152, a plain number is bytes."""
    if size is None or isinstance(size, int):
        return size
    m = _SIZE.fullmatch(size)
    if not m or (m.group(3) and not m.group(2)):
        raise ValueError(f"Invalid size format: {size!r}")
    base = 1024 if m.group(3) else 1000
    power = " kmgtpezy".index(m.group(2).lower() or " ")
    return int((Decimal(m.group(1)) * base**power).to_integral_value(ROUND_CEILING))


# ---------------------------------------------------------------- user regexes

def user_regex(pattern: str) -> str:
    """Case-insensitive, Unicode-aware regex; `.` and `$` take only `\\n` as a line end."""
    return "(?iuUd)" + pattern


# ---------------------------------------------------------------- globs

_COMPONENTS = "\0"  # stands for a `**` component until the slash after it is folded in

def _char_class(body: str, negated: bool, barred: str = "") -> str:
    """Class from glob text: `a-z` spans are ranges, every other character is itself."""
    out, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            if body[i] <= body[i + 2]:
                out.append(f"{quote(body[i])}-{quote(body[i + 2])}")
            i += 3
        else:
            out.append(quote(body[i]))
            i += 1
    if negated:
        return f"[^{''.join(out)}{barred}]"
    chars = "".join(out)
    if not chars:
        return "(?!)"
    return f"(?![{barred}])[{chars}]" if barred else f"[{chars}]"


_GLOB_PART = re.compile(r"(?P<stars>\*+)|(?P<any>\?)|\[!(?P<not>.[^\]]*)\]|\[(?P<in>[^!][^\]]*)\]|(?P<char>.)", re.S)


def glob_regex(pattern: str) -> str | None:
    """Whole-path regex of a selection glob, or None when the pattern is invalid.

    `*` and `?` cross `/`; `**` is only valid as a whole path component; matching is case-sensitive.
    """
    out = []
    for m in _GLOB_PART.finditer(pattern):
        if m["stars"]:
            if len(m["stars"]) == 1:
                out.append(".*")
                continue
            before, after = pattern[:m.start()], pattern[m.end():]
            if len(m["stars"]) > 2 or before[-1:] not in ("", "/") or after[:1] not in ("", "/"):
                return None
            out.append(_COMPONENTS if after else ".*")
        elif m["any"]:
            out.append(".")
        elif m["not"]:
            out.append(_char_class(m["not"], True))
        elif m["in"]:
            out.append(_char_class(m["in"], False))
        elif m["char"] == "[":
            return None
        else:
            out.append(quote(m["char"]))
    body = "".join(out).replace(_COMPONENTS + "/", "(?:.*/)?")
    return rf"(?s)\A{body}\z"


def glob_literals(pattern: str) -> tuple[str, str, bool]:
    """Text before the first and after the last wildcard of a valid selection glob, and whether it has none."""
    wild = [m.span() for m in _GLOB_PART.finditer(pattern) if m["char"] is None]
    return (pattern[:wild[0][0]], pattern[wild[-1][1]:], False) if wild else (pattern, pattern, True)


def selection_globs(patterns) -> list[tuple[int, str]]:
    """`(index, regex)` of every valid glob; one without a slash matches at any depth as well."""
    found = []
    for index, pattern in enumerate(patterns or ()):
        regex = glob_regex(pattern)
        if regex is None:
            continue
        found.append((index, regex))
        if "/" not in pattern and "\\" not in pattern:
            deep = glob_regex("**/" + pattern)
            if deep:
                found.append((index, deep))
    return found


# ---------------------------------------------------------------- ignore-file lines

@dataclass(frozen=True)
class IgnoreLine:
    """One compiled line of an ignore file; `body` matches the path relative to the file's folder."""

    body: str
    negated: bool
    dir_only: bool
    probe: str  # how a path can find the rule: "name", "suffix", "path" or "scan"
    probe_value: str

    @property
    def regex(self) -> str:
        return rf"(?s)\A(?:{self.body})\z"


_IGNORE_PART = re.compile(
    r"\\(?P<escaped>.)|(?P<stars>\*+)|(?P<any>\?)|\[(?P<neg>[!^]?)(?P<set>\]?[^\]]*)\]|\{(?P<alt>[^{}]*)\}|(?P<char>.)", re.S)


def _ignore_glob(glob: str) -> str | None:
    out = []
    for m in _IGNORE_PART.finditer(glob):
        if m["escaped"]:
            out.append(quote(m["escaped"]))
        elif m["stars"]:
            before, after = glob[:m.start()], glob[m.end():]
            whole = len(m["stars"]) == 2 and before[-1:] in ("", "/") and after[:1] in ("", "/")
            out.append((_COMPONENTS if after else ".*") if whole else "[^/]*")
        elif m["any"]:
            out.append("[^/]")
        elif m["set"] is not None:
            out.append(_char_class(m["set"], bool(m["neg"]), "/"))
        elif m["alt"] is not None:
            options = [_ignore_glob(part) for part in m["alt"].split(",")]
            if None in options:
                return None
            out.append("(?:" + "|".join(options) + ")")
        elif m["char"] in "[{}\\":
            return None
        else:
            out.append(quote(m["char"]))
    return "".join(out).replace(_COMPONENTS + "/", "(?:.*/)?")


def compile_ignore_line(line: str, anywhere: bool = False) -> IgnoreLine | None:
    """Compile one ignore-file line; blank lines, comments and invalid globs give None.

    `anywhere` reads the line relative to every folder instead of one.
    """
    line = line.rstrip("\r\n")
    if line.startswith("#"):
        return None
    if not line.endswith("\\ "):
        line = line.rstrip()
    if not line:
        return None
    negated = line.startswith("!")
    if negated:
        line = line[1:]
    rooted = line.startswith("/")
    if rooted:
        line = line[1:]
    dir_only = line.endswith("/")
    if dir_only:
        line = line[:-1]
        line = line[:-1] if line.endswith("\\") else line
    if not line:
        return None
    nested = "/" in line
    floating = anywhere or not (rooted or nested)
    glob = line if not floating or line.startswith("**/") else "**/" + line
    if glob.endswith("/**"):
        glob += "/*"
    body = _ignore_glob(glob)
    if body is None:
        return None
    plain = not re.search(r"[*?\[\]{}\\]", line)
    suffix = re.fullmatch(r"\*(\.[^*?\[\]{}\\/.]+)", line)
    if plain and not nested and floating:
        probe, value = "name", line
    elif plain and not floating:
        probe, value = "path", line
    elif suffix and floating:
        probe, value = "suffix", suffix.group(1)[1:]
    else:
        probe, value = "scan", ""
    return IgnoreLine(body, negated, dir_only, probe, value)
