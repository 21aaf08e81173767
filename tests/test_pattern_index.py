"""Patterns looked up by their literal parts, against patterns tried one by one."""

import random

import pytest
from pyspark.sql import functions as F

from folioloom.operators import select
from folioloom.operators.pattern_index import file_patterns, first_pattern, glob_key
from folioloom.plans.catalog import MANY_LAST

WORDS = ["a", "b", "ab", "src", "md", "x.md", "a.b", ".md", "a.tar.gz", "*", "[", "b\\c"]
PARTS = [*WORDS[:9], "*", "?", "**", "*.md", "a*", "[ab]", "[!a]", "s[r/]c", "*.tar.gz", "b\\c", "[*", "***"]


def globs(rng, n):
    return ["/" * (rng.random() < 0.05) + "/".join(rng.choices(PARTS, k=rng.choice([1, 1, 2, 3, 4]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_first_of_many(spark, seed):
    rng = random.Random(seed)
    patterns = globs(rng, 12 if seed else 150)
    paths = ["/".join(rng.choices(WORDS, k=rng.choice([1, 1, 2, 3, 4, 5]))) for _ in range(600)] + ["", "/a", "md", "a\nb.md", None, "a", "a"]
    rows = spark.createDataFrame([(p, 1) for p in paths], "path string, n int")
    got = first_pattern(rows, "path", patterns, "found").withColumn("want", select.last_order(F.col("path"), patterns)).collect()
    assert len(got) == len(paths) and len({r.found for r in got}) > 3
    assert [r for r in got if r.found != r.want and (r.found is not None or r.want is not None)] == []


def test_keys():
    assert glob_key("**/pkg1/.env") == (("end", 2), "pkg1/.env", False)
    assert glob_key("en/src1/*.rs") == (("start", 2), "en/src1", False)
    assert glob_key("doc.md") == (("end", 1), "doc.md", True) and glob_key("a/b") == (("start", 2), "a/b", False)
    assert glob_key("*.md") == (("extension", 0), "md", True) and glob_key("a*.md") == (("extension", 0), "md", False)
    assert glob_key("*") is None and glob_key("a*") is None
    filed, scanned = file_patterns(MANY_LAST)
    assert not scanned and max(len(v) for keys in filed.values() for v in keys.values()) == 1


def test_long_lists_move_no_rows(spark):
    corpus = spark.range(100).selectExpr("concat('en/src', id % 7, '/doc_', id, '.rs') as relative_path", "id")
    tagged = select.tag_last(corpus, MANY_LAST)
    plan = tagged._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert tagged.where("is_process_last").count() == 100
    assert select.tag_last(corpus.limit(0), MANY_LAST).count() == 0
