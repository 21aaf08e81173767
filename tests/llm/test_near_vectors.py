import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import near_vectors as V


def expected(rows, threshold=V.THRESHOLD):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    unit = []
    for _, v in rows:
        fit = v and all(c is not None and np.isfinite(c) for c in v) and any(v)
        unit.append(V.unit_vectors(np.array([v]))[0] if fit else None)
    links = [[k for k, b in enumerate(unit) if k != i and a is not None and b is not None and len(a) == len(b) and a @ b >= threshold - 1e-15] for i, a in enumerate(unit)]
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        part, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - part
            part |= new
            todo += new
        seen |= part
        low = min((rows[k][0] for k in part if rows[k][0] is not None), default=None)
        for k in part:
            out[k] = (rows[k][0], len(links[k]), low, rows[k][0] == low)
    return sorted(out, key=repr)


def result(spark, rows, kind="float"):
    table = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "k") for i, v in rows],
                                  f"vec_id long, embedding array<{kind}>, key long, n int, bucket string")
    return sorted((tuple(r) for r in V.near_copies(table).collect()), key=repr)


def clusters(rng, width, count, noise):
    rows = []
    for _ in range(count):
        centre = V.unit_vectors(rng.standard_normal((1, width)))[0]
        for _ in range(rng.integers(1, 30)):
            rows.append(centre + noise * rng.random() * rng.standard_normal(width) / np.sqrt(width))
    return [(k, v.astype(np.float32).tolist()) for k, v in enumerate(rows)]


@pytest.mark.parametrize("width, hashes", [(64, 1), (64, 2), (5, 1)])
def test_against_all_pairs(spark, monkeypatch, width, hashes):
    """Pairs on both sides of the threshold; blocks of a few rows, so that every bucket is cut."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    if hashes == 2:
        monkeypatch.setattr(V, "BUCKET_ROWS", 4)
    rows = clusters(np.random.default_rng(width + hashes), width, 30, 0.45)
    want = expected(rows)
    got = result(spark, rows)
    assert sum(r[1] for r in got) >= 0.999 * sum(r[1] for r in want) > 500
    if hashes == 1:
        assert got == want


def test_odd_vectors(spark):
    """NULL, empty, zero and broken vectors, other lengths, copies, other scales, repeated and NULL ids."""
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal(64).astype(np.float32).tolist(), rng.standard_normal(64).astype(np.float32).tolist()
    rows = [(9, a), (3, a), (4, a), (4, a), (5, [x * 2.0 ** 60 for x in a]), (6, [-x for x in a]), (7, b), (7, a[:32]), (8, b[:32]), (None, b), (None, None), (11, None), (12, []),
            (13, [0.0] * 64), (14, [-0.0] * 64), (15, a[:63] + [float("nan")]), (16, a[:63] + [float("inf")]), (17, a[:63] + [None]), (18, [3.0]), (19, [5.0]), (20, [-1.0])]
    for kind in ("float", "double"):
        assert result(spark, rows, kind) == expected(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None), (None, [])]) == [(1, 0, 1, True), (None, 0, None, True)]


def test_fast_transform_is_a_rotation():
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((7, 16))
    dense = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)])
    assert np.allclose(V._hadamard(rows), rows @ dense)
    assert (V.buckets(V.unit_vectors(rows), 2, 3) >= 0).all()


def test_hot_cluster_makes_no_pairs(spark):
    """A third of the rows are distinct near copies: what leaves the tasks grows with the rows."""
    rng = np.random.default_rng(8)
    centre, other = rng.standard_normal(64), rng.standard_normal((800, 64))
    rows = [(k, (centre + 0.05 * rng.standard_normal(64)).tolist()) for k in range(400)] + [(1000 + k, v.tolist()) for k, v in enumerate(other)]
    got = result(spark, rows, "double")
    assert sum(r[1] == 399 for r in got) == 400 and sum(r[3] for r in got) == 801
