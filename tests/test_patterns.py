import re

import pytest

from folioloom.config import Rendering, Selection
from folioloom.functions.patterns import compile_ignore_line, glob_regex, parse_size, selection_globs
from folioloom.operators.select import wants_vcs_folder


def matches(regex, path):
    return re.search(regex.replace(r"\z", r"\Z"), path) is not None


@pytest.mark.parametrize("size, expected", [("10k", 10_000), ("2MiB", 2 << 20), ("1024", 1024), ("1.5 KB", 1500), ("3 b", 3), (7, 7), (None, None)])
def test_sizes(size, expected):
    assert parse_size(size) == expected


@pytest.mark.parametrize("bad", ["", "x", "-1", "5ib", "1qb"])
def test_bad_sizes(bad):
    with pytest.raises(ValueError):
        parse_size(bad)


@pytest.mark.parametrize("glob, yes, no", [
    ("*.rs", ["a.rs", "a/b.rs", ".rs"], ["a.RS", "a.rsx"]),
    ("src/*.rs", ["src/a.rs", "src/x/a.rs"], ["a/src/b.rs"]),
    ("**/t.txt", ["t.txt", "a/t.txt", "a/b/t.txt"], ["at.txt"]),
    ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["a/bz", "az"]),
    ("a/**", ["a/b", "a/b/c"], ["a", "b/a/c"]),
    ("pkg?", ["pkg1", "pkg/"], ["pkg", "pkg12"]),
    ("[a-c]x[!0-9]", ["bxy", "cx/"], ["dxy", "bx1"]),
    ("[]]", ["]"], ["[", "a"]),
    ("{a}.(b)", ["{a}.(b)"], ["a.b"]),
])
def test_globs(glob, yes, no):
    regex = glob_regex(glob)
    assert all(matches(regex, p) for p in yes) and not any(matches(regex, p) for p in no)


@pytest.mark.parametrize("glob", ["[x", "a**", "**a", "***", "[]", "[!]"])
def test_invalid_globs(glob):
    assert glob_regex(glob) is None


def test_plain_globs_match_at_any_depth():
    regexes = [r for _, r in selection_globs(["main.rs"])]
    assert any(matches(r, "src/main.rs") for r in regexes)
    assert not any(matches(r, "src/xmain.rs") for r in regexes)
    assert [i for i, _ in selection_globs(["[bad", "a/b"])] == [1]


@pytest.mark.parametrize("line, yes, no", [
    ("*.log", ["a.log", "x/y/a.log"], ["a.logs"]),
    ("/root.log", ["root.log"], ["sub/root.log"]),
    ("doc/*.txt", ["doc/a.txt"], ["doc/s/a.txt", "x/doc/a.txt"]),
    ("**/foo/bar", ["foo/bar", "a/foo/bar"], ["foo/x/bar"]),
    ("abc/**", ["abc/x", "abc/x/y"], ["abc"]),
    ("a/**/b", ["a/b", "a/x/b", "a/x/y/b"], ["a/xb"]),
    ("\\#x", ["#x"], ["x"]),
    ("\\!x", ["!x", "d/!x"], ["x"]),
    ("a?c", ["abc"], ["a/c", "ac"]),
    ("[!a]b", ["cb"], ["ab", "/b"]),
    ("*.{js,ts}", ["a.js", "x/b.ts"], ["a.css"]),
    ("name\\ ", ["name "], ["name"]),
    ("trail   ", ["trail"], ["trail   "]),
])
def test_ignore_lines(line, yes, no):
    regex = compile_ignore_line(line).regex
    assert all(matches(regex, p) for p in yes) and not any(matches(regex, p) for p in no)


def test_ignore_line_kinds():
    assert compile_ignore_line("# c") is None and compile_ignore_line("  ") is None and compile_ignore_line("/") is None
    assert compile_ignore_line("[bad") is None
    assert compile_ignore_line("!keep").negated and compile_ignore_line("build/").dir_only
    assert (compile_ignore_line("target/").probe, compile_ignore_line("*.rs").probe,
            compile_ignore_line("/a/b").probe, compile_ignore_line("a*").probe) == ("name", "suffix", "path", "scan")
    anywhere = compile_ignore_line("src/*.rs", anywhere=True)
    assert matches(anywhere.regex, "x/src/a.rs") and matches(anywhere.regex, "src/a.rs")


def test_vcs_folder_is_wanted_only_by_name():
    assert wants_vcs_folder(None, [".git/config"]) and wants_vcs_folder(None, None, [r"^\.git/"])
    assert wants_vcs_folder("/x/.git", None)
    assert not wants_vcs_folder("/x/.github", [".github/*", ".gitignore"], ["my.gitx"])


@pytest.mark.parametrize("options", [dict(only_last=True), dict(only=["a"], last=["b"]), dict(max_size="many")])
def test_bad_selections(options):
    with pytest.raises(ValueError):
        Selection(**options)


def test_option_rules():
    assert Selection(only=["a"]).last == ("a",) and Selection(only=["a"]).only_last
    assert Selection(max_size=2**70).max_size is None
    assert Rendering(counts=True).summary
    with pytest.raises(ValueError):
        Rendering(ticks=2)
