import random
import zlib
from collections import Counter
from itertools import combinations

import pytest

from folioloom.llm import spelling as S


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short, long = sorted((a, b), key=len)
    k = next((k for k, (x, y) in enumerate(zip(short, long)) if x != y), len(short))
    return short[k + (len(short) == len(long)):] == long[k + 1:]


def expected(words):
    near = {w: [] for w in words}
    for a, b in combinations(sorted(words), 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def table(spark, words):
    return spark.createDataFrame([(w, n, "x") for w, n in words.items()], "word string, n int, length string")


def test_against_all_pairs(spark):
    """Edits at every place of words with few letters, so that bigrams repeat, overlap and tie."""
    rng = random.Random(4)
    words = {}
    for _ in range(60):
        base = "".join(rng.choices("abé", k=rng.randrange(5, 11)))
        for _ in range(12):
            k = rng.randrange(len(base) + 1)
            base = rng.choice([base[:k] + rng.choice("abé") + base[k:], base[:k] + base[k + 1:], base[:k] + rng.choice("abc") + base[k + 1:]])
            if len(base) >= 5:
                words[base] = rng.choice([1, 2, 5, 10, 25, 26, 130, 700, 5 ** 7])
    words |= {"aaaaa": 1, "aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 126, "x" * 3000: 4, "x" * 2999 + "y": 20}
    got = S.spelling_groups(table(spark, words)).collect()
    assert {tuple(r) for r in got} == expected(words) and len(got) == len(words)
    assert sum(r.form is not None and r.root != r.form for r in got) > 5


def test_pivots_are_disjoint_and_rarest(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abcd", k=rng.randrange(5, 12))): 1 for _ in range(150)}
    for r in S.signatures(S.stored(table(spark, words).select("word", "n"), "test-words")).collect():
        pairs = [(a, b) for a in r.prefix for b in r.prefix if b.pos - a.pos >= 2]
        assert len(r.prefix) >= 3 and r.pivots[1].pos - r.pivots[0].pos >= 2
        assert r.pivots[0].f + r.pivots[1].f == min(a.f + b.f for a, b in pairs)


def test_query_on_odd_documents(spark, make_docs, odd_rows, tmp_path):
    import re

    texts = ["Wörter wörter WÖRTER ÀÉÎ×÷ÿabc don't-break_this4those", "colour color colours " * 9, "receive recieve " * 30, "receive " * 400, "languuage " * 8]
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(texts)] + [(200 + k, "language languages langage " * 3) for k in range(300)] + [(None, "nothing nothing")] * 4
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            v = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if v % 199 == 0:
                run = run[:v % len(run)] + run[v % len(run) + 1:]
            counts[run] += len(run) >= 6
    words = {w: n for w, n in counts.items() if n >= 5}
    got = S.op13_spelling_variants(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in got} == expected(words) and len(words) > 5 and any(r.form for r in got)


def test_empty_short_and_repeated(spark):
    assert S.spelling_groups(spark.createDataFrame([], "word string, n int")).count() == 0
    with pytest.raises(Exception, match="code points"):
        S.spelling_groups(table(spark, {"four": 3})).collect()
    with pytest.raises(ValueError):
        S.spelling_groups(table(spark, {"words": 3}), lead=1)
