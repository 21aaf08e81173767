import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from folioloom.llm import simhash
from folioloom.llm.catalog import QUERIES
from folioloom.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def slow_groups(rows):
    prints = {(i, t): slow_fingerprint(t) for i, t in rows if i is not None}
    links = [(a[0], b[0]) for a, b in combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    return slow_components({i for i, _ in prints}, links)


def test_odd_documents(make_docs, odd_rows):
    got = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert sorted((r.doc_id, r.fp & (2**64 - 1)) for r in got if r.doc_id) == sorted((i, slow_fingerprint(t)) for i, t in odd_rows if i)
    # Rows that share an id are linked here, as all rows of an id bear equal texts.
    want = slow_groups(odd_rows)
    assert {r.doc_id: r.component_id for r in got} == want | {None: None}
    assert len(got) == len(odd_rows)


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.one_per_group(make_docs([])).count() == 0


def test_one_per_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    got = simhash.one_per_group(docs)
    want = slow_groups(odd_rows)
    assert got.columns == docs.columns
    # The text "only text here" has no id and no copy; the other row without an id is in the group of empty texts.
    wanted = {(i, t) for i, t in odd_rows if i is not None and want.get(i) == i} | {(None, "only text here")}
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, wanted))


def test_one_row_a_group_with_repeated_and_null_ids(make_docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (9, a), (None, c), (None, c), (None, a), (None, None), (None, "")]
    got = sorted((str(r.doc_id), r.text or "") for r in simhash.one_per_group(make_docs(rows)).collect())
    assert got == sorted([("3", b), ("5", a), ("None", c), ("None", "")])


@pytest.mark.parametrize("trie_rows", [1 << 20, 30])
def test_links_are_those_of_all_pairs(spark, trie_rows):
    """Dense balls of fingerprints, with tries walked whole and cut into node pairs."""
    rng, prints = random.Random(5), set()
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    nodes = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in enumerate(prints)], "node long, fp long")
    got = dict(connected_components(simhash.link_forest(nodes, trie_rows)).collect())
    a = np.array(prints, dtype=np.uint64)
    links = [(i, i + 1 + int(j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1:]) <= 3)]
    assert {i: got.get(i, i) for i in range(len(a))} == slow_components(range(len(a)), links)


def test_walk_in_small_steps(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    rng = np.random.default_rng(2)
    keys = np.unique((np.uint64(5) << np.uint64(48)) | (rng.integers(0, 2**9, 200, dtype=np.uint64) << np.uint64(20)))
    got = simhash.walk(keys, np.zeros(len(keys), dtype=np.int64), 16)
    links = [(i, j) for i, j in combinations(range(len(keys)), 2) if (int(keys[i]) ^ int(keys[j])).bit_count() <= 3]
    assert got.tolist() == list(slow_components(range(len(keys)), links).values())


def test_components_of_chain_star_and_loops(spark):
    rng = random.Random(1)
    chain = list(range(100, 160))
    links = list(zip(chain, chain[1:], strict=False)) + [(7, k) for k in range(200, 260)] + [(3, 3), (9, 8), (8, 9), (8, 9)]
    rng.shuffle(links)
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {n: c for n, c in slow_components({x for link in links for x in link}, links).items() if n != 3}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = slow_groups(rows)
    got = QUERIES["op1_simhash"](spark, folder).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{slow_fingerprint(t):016x}", want[i]) for i, t in rows)
