import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from folioloom.llm import manifest as M


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row.doc_id, row.source, row.lang, None if row.n_chars is None else row.n_chars + more, row.text]
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """Levels from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k:k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def witness(levels, at):
    steps = []
    for level in levels[:-1]:
        steps.append((at & 1, level[at ^ 1]) if at ^ 1 < len(level) else (0, None))
        at >>= 1
    return steps


def fold(digest, steps):
    for left, other in steps:
        digest = h(digest) if other is None else h(other, digest) if left else h(digest, other)
    return digest


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of all rows, by whole trees."""
    by_lang = {}
    for row in rows:
        by_lang.setdefault(row.lang, []).append(row)
    langs = sorted(by_lang, key=lambda g: (g is not None, (g or "").encode()))
    levels = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        levels[lang] = tree([leaf(r) for r in by_lang[lang]])
    top = tree([levels[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, row in enumerate(by_lang[lang]):
            steps = witness(levels[lang], at) + witness(top, k)
            bad = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0 and row.n_chars is not None
            folded = fold(leaf(row, int(bad)), steps)
            out.append((row.doc_id, leaf(row), levels[lang][-1][0], top[-1][0], h(*(o for _, o in steps if o)), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
    return sorted((tuple(r) for r in M.op11_merkle_manifest(spark, f"{tmp_path}/{name}").collect()), key=repr), expected(docs.collect())


def test_odd_rows(spark, make_docs, odd_rows, tmp_path):
    """NULLs in every column, repeated rows and ids, empty and long texts, and languages that only bytes tell apart."""
    docs = make_docs(odd_rows)
    for lang in ("", "de", "z", "é", "\x00"):
        docs = docs.unionByName(make_docs([(k, f"t{k} {lang}") for k in range(len(lang.encode()) * 3 + 1)], lang))
    docs = docs.unionByName(make_docs([(77, None)]).withColumn("source", F.lit(None).cast("string")))
    got, want = result(spark, docs, tmp_path, "odd")
    assert got == want and len({r[6] for r in got}) == 2


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 5, 8, 9, 33])
def test_levels_of_blocks(spark, make_docs, tmp_path, monkeypatch, count):
    """Blocks of two nodes, so that every tree is appended in many rounds; ranges of a few rows."""
    monkeypatch.setattr(M, "LEVELS", 1)
    monkeypatch.setattr(M, "RANGE_ROWS", 4)
    docs = make_docs([(k, f"text {k}") for k in range(count)], "en").unionByName(make_docs([(k, "x") for k in range(count // 2)], "fr"))
    got, want = result(spark, docs, tmp_path, f"n{count}")
    assert got == want


def test_appending_extends_witnesses():
    """After every append the open subtrees' witnesses lead to their roots."""
    rng = random.Random(1)
    block, leaves = M.Appender(), []
    for k in range(70):
        leaves.append(h(str(rng.random())))
        block.append(leaves[-1])
        assert [height for height, _, _ in block.open] == [b for b in range(7, -1, -1) if (k + 1) >> b & 1]
        for height, root, below in block.open:
            for j in below:
                steps = [bytes(block.steps[j][s:s + M.STEP_BYTES]) for s in range(0, len(block.steps[j]), M.STEP_BYTES)]
                assert len(steps) == height and fold(leaves[j], [(s[:1] == b"L", s[1:].hex()) for s in steps]) == root
    assert block.close(whole=True) == tree(leaves)[-1][0]
