import random

import pytest

from folioloom.llm import decontaminate


def test_masks_miss_no_window():
    assert all(decontaminate.lossless(n, n // 5) for n in range(decontaminate.SUBSTITUTABLE, decontaminate.WINDOW + 1))


def slow(docs, items):
    out = {}
    for d, words in docs:
        for item, passage in items:
            n = len(passage)
            width = min(n, 20)
            need = n if n < 10 else width - width // 5
            for diagonal in range(-n, len(words)):
                for s in range(max(0, -diagonal), min(n, len(words) - diagonal) - width + 1):
                    agree = sum(words[diagonal + k] == passage[k] for k in range(s, s + width))
                    if n >= 5 and agree >= need:
                        start, best = out.get((d, item), (10**9, 0))
                        out[d, item] = min(start, diagonal + s), max(best, agree)
    return {(*k, *v) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["the"] * 10
    items = [(k, rng.choices(vocabulary, k=rng.choice([3, 5, 7, 10, 12, 15, 19, 20, 33, 60]))) for k in range(25)]
    items += [(25, items[5][1]), (25, items[5][1]), (26, ["the"] * 30)]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary, k=rng.randrange(30))
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randrange(len(passage) // 4 + 1)):
                passage[rng.randrange(len(passage))] = "changed"
            begin = rng.randrange(3)
            words += passage[begin:] + rng.choices(vocabulary, k=rng.randrange(8))
        docs.append((d, words))
    docs.append((90, ["the"] * 200))
    return docs, items


def test_all_windows(spark, make_docs, tables):
    docs, items = tables
    benchmark = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items], "item_id long, text string")
    got = decontaminate.overlaps(make_docs([(i, ", ".join(w)) for i, w in docs]), benchmark, ["doc_id"]).collect()
    want = slow(docs, items)
    assert {(r.doc_id, r.item_id, r.word_start, r.words_agreeing) for r in got} == want and len(got) == len(want) > 30


def test_blocks_of_seeds(spark, make_docs, tables, monkeypatch):
    docs, items = tables
    docs = make_docs([(i, " ".join(w)) for i, w in docs[:30]])
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    want = set(decontaminate.overlaps(docs, benchmark, ["doc_id"]).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 200_000)
    assert set(decontaminate.overlaps(docs, benchmark, ["doc_id"]).collect()) == want


def test_odd_rows(spark, make_docs, odd_rows):
    passage = odd_rows[8][1][5000:5400]
    benchmark = spark.createDataFrame([(1, passage, 2), (None, "one two three four five six", 1), (2, None, 1), (3, "", 1)], "item_id long, text string, n long")
    rows = [*odd_rows, (None, "so one two, three four five six."), (None, "one two three")]
    docs = make_docs(rows)
    assert {r.doc_id for r in decontaminate.overlaps(docs, benchmark, ["doc_id"]).collect()} == {6, 7, 9, None}
    kept = decontaminate.decontaminated(docs, benchmark)
    assert kept.columns == docs.columns
    bad = (odd_rows[8][1], odd_rows[8][1] + "\nend", "so one two, three four five six.")
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, ((i, t) for i, t in rows if t not in bad)))
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(docs, nothing).count() == len(rows)
    assert decontaminate.overlaps(make_docs([]), benchmark, ["doc_id"]).count() == 0


def test_repetitive_text(spark, make_docs):
    benchmark = spark.createDataFrame([(k, "go " * 30) for k in range(20)], "item_id long, text string")
    got = decontaminate.overlaps(make_docs([(1, "go " * 8000), (2, "a go " * 4000)]), benchmark, ["doc_id"]).collect()
    assert sorted(tuple(r) for r in got) == [(1, k, 0, 20, 20) for k in range(20)]


def test_segments_cut_no_passage(spark, make_docs, tables, monkeypatch):
    docs, items = tables
    docs = [(i, docs[i][1] + docs[i + 1][1] + docs[i + 2][1]) for i in range(0, 75, 3)]
    items = [(i, w) for i, w in items if len(w) < 16]
    monkeypatch.setattr(decontaminate, "SEGMENT", 1)
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontaminate.overlaps(make_docs([(i, " ".join(w)) for i, w in docs]), benchmark, ["doc_id"]).collect()
    assert {(r.doc_id, r.item_id, r.word_start, r.words_agreeing) for r in got} == slow(docs, items)
