"""Ignore rules: stated cases, and both plans against a plain Python reading of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioloom.functions.patterns import compile_ignore_line
from folioloom.operators import ignore, skew

TYPES = "kind string, base string, seq int, pattern string"


def files(spark, paths):
    return spark.createDataFrame([(p,) for p in paths], "relative_path string")


def kept(spark, paths, rules, last=None):
    inline = {r[0] for r in ignore.drop_ignored(files(spark, paths), rules, last=last).collect()}
    table = spark.createDataFrame(rules, TYPES)
    joined = {r[0] for r in ignore.drop_ignored(files(spark, paths), table, last=last).collect()}
    assert inline == joined
    return inline


@pytest.mark.parametrize("paths, lines, expected", [
    (["a.log", "important.log", "c.txt"], "*.log\n!important.log", {"important.log", "c.txt"}),
    (["root.log", "sub/root.log"], "/root.log", {"sub/root.log"}),
    (["build", "x/build/o", "y/build.f"], "build/", {"build", "y/build.f"}),
    (["temp.txt", "a/temp.txt", "a/b/temp.txt", "k"], "**/temp.txt", {"k"}),
    (["#c.yaml", "c.yaml"], "\\#c.yaml", {"c.yaml"}),
    (["d/keep.txt", "e"], "d/\n!d/keep.txt", {"e"}),
])
def test_one_rule_file(spark, paths, lines, expected):
    assert kept(spark, paths, ignore.rules_from_lines(lines)) == expected


def test_nested_files_and_overrides(spark):
    rules = ignore.rules_from_lines("*.log\ntarget/") + ignore.rules_from_lines("!b.log\nkeep.txt", base="sub")
    paths = ["a.log", "sub/b.log", "sub/keep.txt", "root.txt", "target/debug.o", "target/x.log"]
    assert kept(spark, paths, rules) == {"sub/b.log", "root.txt"}
    # Overrides bring files back, but not out of a folder that is never entered.
    assert kept(spark, paths, rules, last=["*.log"]) == {"sub/b.log", "root.txt", "a.log"}
    assert kept(spark, paths, rules, last=["target", "*.log"]) == {"sub/b.log", "root.txt", "a.log", "target/debug.o", "target/x.log"}


def test_stronger_kind_beats_deeper_base(spark):
    rules = ignore.rules_from_lines("!x", kind="ignore") + ignore.rules_from_lines("x", base="d")
    assert kept(spark, ["d/x", "x"], rules) == {"d/x", "x"}


def brute_force(paths, rules):
    compiled = [(ignore.KINDS.index(k), base, seq, line) for k, base, seq, p in rules
                if (line := compile_ignore_line(p, k == "override"))]

    def verdict(path, is_dir):
        best = None
        for kind, base, seq, line in compiled:
            inside = path if not base else path[len(base) + 1:] if path.startswith(base + "/") else None
            if inside and (is_dir or not line.dir_only) and re.search(line.regex.replace(r"\z", r"\Z"), inside):
                rank = (kind, len(base), seq)
                if best is None or rank > best[0]:
                    best = (rank, not line.negated)
        return bool(best and best[1])

    def ignored(path):
        parts = path.split("/")
        return any(verdict("/".join(parts[:n]), n < len(parts)) for n in range(1, len(parts) + 1))

    return {p for p in paths if not ignored(p)}


@pytest.mark.parametrize("seed", range(4))
def test_random_rules(spark, seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", 0)  # shuffled joins instead of broadcasts
    rng = random.Random(seed)
    names, exts = ["a", "b", "src", "log"], ["", ".log", ".rs", ".tar.gz"]

    def path():
        folders = [rng.choice(names) for _ in range(rng.randrange(4))]
        return "/".join([*folders, rng.choice(names) + rng.choice(exts)])

    paths = list({path() for _ in range(300)})
    folders = {p for q in paths for p in ["/".join(q.split("/")[:n]) for n in range(1, q.count("/") + 1)]}
    paths = [p for p in paths if p not in folders]
    patterns = ["*.log", "!*.log", "src/", "/a", "b/*", "**/log/**", "!src", "a*", "!b.rs", "?.rs", "*.gz", "src/b", "!a/b", "log.rs", "[ab].log"]
    rules = []
    for base in ["", "a", "src/b", "log"]:
        rules += [(rng.choice(ignore.KINDS), base, n, rng.choice(patterns)) for n in range(rng.randrange(1, 7))]
    assert kept(spark, paths, rules) == brute_force(paths, rules)


def test_scopes_do_not_mix(spark):
    corpus = spark.createDataFrame([("r1", "a.log"), ("r2", "a.log"), ("r2", "b.txt")], "repo string, relative_path string")
    rules = spark.createDataFrame([("r1", "gitignore", "", 0, "*.log"), ("r2", "gitignore", "", 0, "b.*")], "repo string, " + TYPES)
    left = ignore.drop_ignored(corpus, rules, scope=["repo"])
    assert {tuple(r) for r in left.select("repo", "relative_path").collect()} == {("r2", "a.log")}
    back = ignore.drop_ignored(corpus, rules, scope=["repo"], last=["*.txt"])
    assert {tuple(r) for r in back.select("repo", "relative_path").collect()} == {("r2", "a.log"), ("r2", "b.txt")}


def test_many_copies_of_one_path(spark):
    corpus = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a.log").otherwise(F.concat(F.lit("f"), "id")).alias("relative_path"), "id")
    rules = spark.createDataFrame(ignore.rules_from_lines("*.rs\nf1*"), TYPES)
    left = ignore.drop_ignored(corpus, rules)
    assert left.where("relative_path = 'a.log'").count() == 1000
    assert left.where("relative_path like 'f1%'").count() == 0


def test_plans(spark):
    rules = spark.createDataFrame(ignore.rules_from_lines("*.log"), TYPES)

    def plan_of(rows):
        return rows._jdf.queryExecution().executedPlan().toString()

    joined = plan_of(ignore.drop_ignored(files(spark, ["a"]), rules))
    assert joined.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in joined
    inline = plan_of(ignore.drop_ignored(files(spark, ["a"]), ignore.rules_from_lines("*.log")))
    assert "Exchange" not in inline and "Join" not in inline


def test_long_lists_are_columns(spark):
    lines = [f"{'!' if k % 3 == 0 else ''}f{k}" for k in range(900)]
    paths = [f"f{k}" for k in range(1000)] + ["d/f1", "d/f3"]
    assert kept(spark, paths, ignore.rules_from_lines(lines)) == {p for p in paths if int(p.split("f")[1]) % 3 == 0 or int(p.split("f")[1]) >= 900}


def test_runs_of_regexes_keep_their_order(spark):
    """Patterns that need a regex, with other outcomes between them, and kinds that outrank deeper folders."""
    lines = ["a*1", "a*2", "!a?22", "b[0-9]*", "!b1*", "b1?", "x.log", "!x*", "a**9/"]
    rules = ignore.rules_from_lines(lines) + ignore.rules_from_lines(["!a*", "a*4"], base="d", kind="ignore")
    paths = [f"{d}{c}{n}" for d in ("", "d/", "e/") for c in "abx" for n in (1, 2, 12, 22, 122, 4, 9)] + ["x.log", "d/x.log", "a9/b", "d/a9/c"]
    assert kept(spark, paths, rules) == brute_force(paths, rules)


def test_long_rule_files_are_cut(spark, monkeypatch):
    rules = ignore.rules_from_lines([f"{'!' if k % 1700 == 0 else ''}a*{k}" for k in range(5000)])
    table = ignore.prepared_rules(spark.createDataFrame(rules, TYPES))
    pieces = [r.body.count("|") + 1 for r in table.where("probe = 'scan'").collect()]
    assert sum(pieces) == 5000 and max(pieces) <= 1024 and len(pieces) >= 8
    monkeypatch.setattr(ignore, "_BLOCK_BITS", 1)
    lines = ["*.log", "!b*", "a?", "!a1", "[ab]c/", "d*", "!d/*.x", "/e*", "b.log"]
    paths = [f"{a}{b}" for a in ("", "d/", "ac/", "q/e/") for b in ("a1", "a2", "b.log", "c.log", "d1", "e", "f.x", "dd\nd")]
    rules = ignore.rules_from_lines(lines) + ignore.rules_from_lines(["!*.log", "c*", "!?.x"], base="d")
    assert 0 < len(kept(spark, paths, rules)) < len(paths)
