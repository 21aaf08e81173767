import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from folioloom.llm import language, neighbours, quality
from folioloom.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block", [1, 2, 5, 64])
def test_viterbi_finds_the_best_path(block, monkeypatch):
    monkeypatch.setattr(language, "BLOCK", block)
    rng = np.random.default_rng(block)
    counts = np.array([0, 1, 5, 7, 0, 3, 6, 0])
    scores = rng.normal(size=(counts.sum(), 3)) * 2

    def value(path, part):
        return part[np.arange(len(path)), list(path)].sum() - 1.3 * sum(a != b for a, b in zip(path, path[1:], strict=False))

    got = np.split(language.viterbi(scores, counts, 1.3), np.cumsum(counts)[:-1])
    for path, part in zip(got, np.split(scores, np.cumsum(counts)[:-1]), strict=True):
        assert len(path) == len(part)
        if len(part):
            assert np.isclose(value(path, part), max(value(p, part) for p in itertools.product(range(3), repeat=len(part))))


TEXTS = {"en": "the house and the other thing that was there with them", "de": "das haus und die andere sache die dort mit ihnen war", "ru": "дом и другая вещь которая там была с ними"}


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choices(TEXTS[lang].split(), k=12)), lang) for k, lang in enumerate(list(TEXTS) * 40)]
    rows += [(None, "the the", "xx"), (500, None, "yy"), (501, "das", None)]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages_and_spans(spark, model):
    assert model.languages == sorted(TEXTS)
    mixed = f"{TEXTS['en']} {TEXTS['de']} {TEXTS['ru']}"
    texts = [None, "", "12 34 ...", TEXTS["de"], TEXTS["ru"].upper(), mixed, "日本語", "the 1 2 3 4 5 6"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = rows.select("k", language.predicted(model)("text").alias("p"), language.language_spans(model)("text").alias("s")).orderBy("k").collect()
    assert [r.p.lang for r in got][:5] == ["und", "und", "und", "de", "ru"] and got[6].p.lang in TEXTS and got[7].p.lang == "en"
    assert all(0 <= r.p.score <= 1 for r in got) and got[0].p.score == 0
    assert [(s.lang, s.first_word, s.n_words) for s in got[5].s] == [("en", 0, 11), ("de", 11, 11), ("ru", 22, 9)]
    assert got[0].s == [] and got[1].s == []


def test_nothing_learned(spark):
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    empty = language.learn(rows)
    assert rows.select(language.predicted(empty)("text").alias("p")).first().p.lang == "und"
    assert rows.select(language.language_spans(empty)("text").alias("s")).first().s == []


def test_language_held_out_accuracy(spark):
    got = QUERIES["op5_language"](spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 100 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97


def slow_features(text):
    words = (text or "").encode().split()
    if not words:
        return None
    lines = text.split("\n")
    return {"line_words": len(words) / len(lines), "distinct_words": len(set(words)) / len(words), "top_word": max(map(words.count, set(words))) / len(words),
            "distinct_lines": len(set(lines)) / len(lines), "length": np.log1p(len(text)), "short_words": sum(len(w.decode()) <= 3 for w in words) / len(words)}


def test_features():
    rng = random.Random(2)
    texts = [None, "", " \n ", "A", "a b\na b\n", "é È 12,5 %!? ###", *["".join(rng.choices("ab C.\n9é", k=rng.randrange(60))) for _ in range(60)]]
    got = quality.features(pa.array(texts, pa.string()))
    assert np.isfinite(got).all() and got.shape == (len(texts), len(quality.FEATURES))
    for text, row in zip(texts, got, strict=True):
        want = slow_features(text)
        if want is None:
            assert not row.any()
        else:
            assert all(np.isclose(row[quality.FEATURES.index(k)], v) for k, v in want.items())
    assert quality.features(pa.array([], pa.string())).shape[0] == 0


def test_additive_model_learns_lines_and_pairs():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.95
    y = ((x[:, 2] > 0.3) & (x[:, 2] < 0.6)).astype(float)
    assert ((quality.fit(x, y, pair_count=0).score(x) > 0.5) == y).mean() > 0.95


def test_constant_or_no_labels(spark, make_docs):
    assert quality.fit(np.zeros((0, 3)), np.zeros(0)).score(np.ones((2, 3))).tolist() == [0.5, 0.5]
    one = quality.fit(np.ones((5, 3)), np.ones(5)).score(np.ones((1, 3)))
    assert 0.5 < one[0] <= 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a"), (2, None), (None, "")])
    assert quality.accepted(docs, quality.learn(docs, labels)).count() == 3


def test_odd_documents_and_labels(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (7, 0, None), (7, 0, 1), (8, 1, 0), (9, None, 0), (4, 1, 0), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    got = quality.accepted(docs, model, 0.0)
    assert got.count() == len(odd_rows) and got.columns == docs.columns
    assert quality.accepted(make_docs([]), model).count() == 0


def test_quality_held_out(spark):
    got = QUERIES["op10_quality"](spark, SMALL)
    assert got.count() == 1000 and got.where("score is null or score < 0 or score > 1 or predicted <> if(score >= 0.3, 1, 0)").count() == 0
    rows = got.join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for g in good] for b in bad]) > 0.97


def slow_nearest(rows, k):
    valid = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            valid[i] = min(valid.get(i, v), v)
    out = {}
    for q in valid:
        if q % 50 == 0:
            found = [(-float(np.dot(valid[q], v) / np.linalg.norm(valid[q]) / np.linalg.norm(v)), i) for i, v in valid.items() if i != q and len(v) == len(valid[q])]
            out[q] = sorted(found)[:k]
    return out


def vectors_of(spark, rows):
    return neighbours.usable(spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, node int, shard int"))


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(k, np.round(rng.normal(size=8), 2).astype(np.float32).tolist()) for k in range(300)]
    rows += [(300 + k, rows[0][1]) for k in range(200)]  # a common vector, far more often than a list is long
    rows += [(600, None), (650, []), (700, [0.0] * 8), (750, [1.0, None, *[0.0] * 6]), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (None, [1.0] * 8),
             (900, [1.0, 2.0]), (901, [2.0, 1.0]), (950, [3.0]), (150, rows[150][1]), (1000, [1e-30] * 8), (1001, [1e30] * 8)]
    vectors = vectors_of(spark, rows).cache()
    got = {}
    for r in neighbours.search(neighbours.build_index(vectors, 5, 64), vectors.where("vec_id % 50 = 0"), 5, 4).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = slow_nearest(rows, 5)
    assert set(got) == {q for q, found in want.items() if found} and 950 not in got and set(got[900]) == {1}
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(want[q]) + 1))
        assert np.allclose([s for _, s in found.values()], [found[k][1] for k in sorted(found)])
    near = [[got[q][k + 1][1] >= -want[q][k][0] - 1e-6 for k in range(len(want[q]))] for q in got]
    assert np.mean([x for row in near for x in row]) > 0.97
    assert [got[0][k][0] for k in range(1, 6)] == [300, 301, 302, 303, 304]  # ties go to the smaller ids


def test_no_vectors(spark):
    vectors = vectors_of(spark, [(1, [0.0])])
    assert neighbours.search(neighbours.build_index(vectors, 5), vectors, 5).count() == 0


def test_every_node_can_be_reached():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 16)) * 4
    unit = neighbours._unit(centres[rng.integers(0, 5, 700)] + 0.01 * rng.normal(size=(700, 16)))
    graph, entry = neighbours.build_graph(unit)
    seen, wave = {entry}, [entry]
    while wave:
        wave = [int(v) for u in wave for v in graph[u] if v >= 0 and v not in seen and not seen.add(int(v))]
    assert len(seen) == 700


def test_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = slow_nearest(rows, 5)
    got = {}
    for r in QUERIES["op4_neighbours"](spark, SMALL).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for _, i in found}) / 5 for q, found in want.items()]) >= 0.95


def test_shards_move_once_whatever_the_queries(spark):
    """Blocks of queries share a shard's rows: the index is copied for idle cores only, and the result does not depend on that."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=6).astype(np.float32).tolist()) for k in range(400)]
    vectors = vectors_of(spark, rows).cache()
    want = {(q, i) for q, found in slow_nearest(rows, 5).items() for _, i in found}
    for shard, block in ((40, 1), (40, 400), (400, 2)):
        got = neighbours.search(neighbours.build_index(vectors, 5, shard), vectors.where("vec_id % 50 = 0"), 5, block).collect()
        assert {(r.query_id, r.vec_id) for r in got} == want and len(got) == 40
