"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

A graph grows in batches. Greedy searches in what is there propose neighbours of each new vector; pruning keeps the nearest, drops the
candidates that are nearer to it than to the new vector by the factor RELAX, and goes on with the next, so edges lead in
different directions. Edges run back as well and are pruned by the same rule. A query walks every shard's graph with a beam.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.operators.skew import stored

#: Vectors per shard, which a task holds with their graph (some 15 MB at 64 dimensions), and queries that are worth a task of their own.
SHARD_VECTORS, BLOCK_QUERIES = 16384, 1024
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 192, 1.4
#: Vectors inserted, or searched for, at a time, and nodes that a step of a walk expands.
BATCH, EXPANDED = 256, 4


def _distances(unit: np.ndarray, a: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1 - cosine between each row of `a` and the vectors of its `ids`; infinite where an id is negative."""
    found = 1 - np.matmul(unit[np.maximum(ids, 0)], a[:, :, None])[:, :, 0]
    return np.where(ids < 0, np.inf, found)


def beam_search(unit: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The `beam` nearest nodes found for each query, nearest first, and their distances; -1 and infinity where there are fewer."""
    rows = np.arange(len(queries))[:, None]
    ids = np.full((len(queries), beam), -1)
    ids[:, 0] = entry
    far = _distances(unit, queries, ids)
    seen = np.zeros((len(queries), len(unit)), dtype=bool)
    seen[:, entry] = True
    done = np.zeros(ids.shape, dtype=bool)
    while True:
        waiting = np.where(done | (ids < 0), np.inf, far)
        best = np.argsort(waiting, axis=1, kind="stable")[:, :EXPANDED]
        open_ = np.isfinite(np.take_along_axis(waiting, best, axis=1))
        active = open_.any(axis=1)
        if not active.any():
            return ids, far
        done[rows, best] |= open_
        if not active.all():  # only rows that still move are worked on
            part = np.flatnonzero(active)
            i, f, d, s = _step(unit, graph, queries[part], ids[part], far[part], done[part], seen[part], best[part], open_[part])
            ids[part], far[part], done[part], seen[part] = i, f, d, s
        else:
            ids, far, done, seen = _step(unit, graph, queries, ids, far, done, seen, best, open_)


def _step(unit, graph, queries, ids, far, done, seen, best, open_):
    rows, beam = np.arange(len(queries))[:, None], ids.shape[1]
    nodes = np.where(open_, np.take_along_axis(ids, best, axis=1), -1)
    more = np.where(nodes[:, :, None] < 0, -1, graph[np.maximum(nodes, 0)]).reshape(len(queries), -1)
    more = np.sort(more, axis=1)
    more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
    more[seen[rows, np.maximum(more, 0)] & (more >= 0)] = -1
    at = np.nonzero(more >= 0)
    seen[at[0], more[at]] = True
    near = _distances(unit, queries, more)
    all_ids, all_far = np.concatenate([ids, more], axis=1), np.concatenate([far, near], axis=1)
    all_done = np.concatenate([done, np.zeros(more.shape, dtype=bool)], axis=1)
    order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
    return tuple(np.take_along_axis(x, order, axis=1) for x in (all_ids, all_far, all_done)) + (seen,)


def robust_prune(unit: np.ndarray, centres: np.ndarray, candidates: np.ndarray, degree: int) -> np.ndarray:
    """Up to `degree` diverse neighbours of each centre among its candidates (-1 for none), nearest first."""
    far = _distances(unit, unit[centres], np.where(candidates == centres[:, None], -1, candidates))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(far, order, axis=1)
    vectors = unit[np.maximum(candidates, 0)]
    alive, kept = np.isfinite(far), np.full((len(centres), degree), -1)
    rows = np.arange(len(centres))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        has = alive[rows, pick]
        if not has.any():
            break
        kept[has, k] = candidates[rows, pick][has]
        between = 1 - np.matmul(vectors, vectors[rows, pick][:, :, None])[:, :, 0]
        alive &= (RELAX * between > far) & (candidates != candidates[rows, pick][:, None])
        alive[rows, pick] = False
    return kept


def build_graph(unit: np.ndarray) -> tuple[np.ndarray, int]:
    """Neighbours of each of the distinct unit vectors (-1 for none), and the node where walks begin. Every node can be reached."""
    n = len(unit)
    entry = int(np.argmax(unit @ unit.mean(axis=0)))
    graph = np.full((n, DEGREE), -1)
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at = 1
    while at < n:
        new = order[at:at + min(BATCH, at)]  # a batch never outgrows what it is searched in
        found, _ = beam_search(unit, graph, entry, unit[new], min(BUILD_BEAM, n))
        graph[new] = robust_prune(unit, new, found, DEGREE)
        _link_back(unit, graph, new)
        at += len(new)
    return _reach_all(unit, graph, entry), entry


def _link_back(unit: np.ndarray, graph: np.ndarray, new: np.ndarray) -> None:
    source, target = np.repeat(new, DEGREE), graph[new].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    by_count = np.argsort(count, kind="stable")
    for begin in range(0, len(nodes), 1024):  # nodes with like numbers of new edges, so that padding stays small
        part = by_count[begin:begin + 1024]
        width = int(count[part].max(initial=0))
        fresh = np.full((len(part), width), -1)
        spot = np.arange(width)[None] < count[part][:, None]
        fresh[spot] = source[(first[part][:, None] + np.arange(width)[None])[spot]]
        graph[nodes[part]] = _joined(unit, nodes[part], np.concatenate([graph[nodes[part]], fresh], axis=1))


def _joined(unit: np.ndarray, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All candidates where they fit, else the pruned ones."""
    candidates = -np.sort(-candidates, axis=1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates = -np.sort(-candidates, axis=1)
    out, full = candidates[:, :DEGREE].copy(), (candidates >= 0).sum(axis=1) > DEGREE
    if full.any():
        out[full] = robust_prune(unit, nodes[full], candidates[full], DEGREE)
    return out


def _reach_all(unit: np.ndarray, graph: np.ndarray, entry: int) -> np.ndarray:
    """The graph with an edge more from a near node that is reached to each that is not."""
    while True:
        seen, wave = np.zeros(len(unit), dtype=bool), np.array([entry])
        seen[entry] = True
        while len(wave):
            wave = np.unique(graph[wave])
            wave = wave[wave >= 0]
            wave = wave[~seen[wave]]
            seen[wave] = True
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return graph
        lost = lost[:BATCH]
        found, _ = beam_search(unit, graph, entry, unit[lost], 1)
        order = np.argsort(found[:, 0], kind="stable")
        host, lost = found[order, 0], lost[order]
        rank = np.arange(len(host)) - np.searchsorted(host, host)
        graph = np.concatenate([graph, np.full((len(graph), int(rank.max()) + 1), -1)], axis=1)
        graph[host, graph.shape[1] - 1 - rank] = lost


def _unit(vectors: np.ndarray) -> np.ndarray:
    # Scaled by the largest component first, so that no square over- or underflows.
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of `a` with that of `b`, in double precision."""
    a, b = (x / np.abs(x).max(axis=1, keepdims=True) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def valid(vector: Column) -> Column:
    """Not NULL, not zero, and without NULL or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build_index(vectors: DataFrame, k: int, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """Stored graphs over `vectors` (vec_id, vector array<double>, all valid): dim, shard, node, ids, vector, neighbours, entry.

    Equal vectors are one node with their k + 1 smallest ids, more of which no list of k neighbours can need; tasks thin them out before the shuffle.
    Vectors of other lengths never meet. Shards are hashed by vector and hold about `shard_vectors` nodes.
    """
    first = Window.partitionBy("vector").orderBy("vec_id")
    rows = vectors.select("vec_id", "vector").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    nodes = stored(rows.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    shards = -(-nodes.count() // shard_vectors) or 1

    def finished(parts: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(parts)
        rows = rows.sort_values("ids", key=lambda c: c.map(lambda ids: ids[0])).reset_index(drop=True)
        graph, entry = build_graph(_unit(np.stack(rows["vector"].to_list()).astype(np.float64)))
        return rows.assign(node=np.arange(len(rows)), neighbours=[g[g >= 0] for g in graph], entry=entry)[["dim", "shard", "node", "ids", "vector", "neighbours", "entry"]]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts = None, []
        for batch in batches:
            for key, rows in batch.groupby(["dim", "shard"]):
                if key != at and parts:
                    yield finished(parts)
                    parts = []
                at = key
                parts.append(rows)
        if parts:
            yield finished(parts)

    sharded = nodes.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    # A partition for each shard by its number: a shard is little data but much work, and a hash would put some of them together.
    placed = sharded.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard")
    return stored(placed.mapInPandas(build, "dim int, shard int, node int, ids array<long>, vector array<double>, neighbours array<int>, entry int"), "graphs")


_HITS = "query_id long, vec_id long, score double"
_SHARD = ["dim", "shard", "block"]


class _Shard:
    """Vectors, ids and graph of a shard, put together from its rows as they come."""

    def __init__(self) -> None:
        self.vectors, self.ids, self.neighbours, self.entry, self.ready = [], [], [], 0, False

    def add(self, rows: pd.DataFrame) -> None:
        self.vectors.append(np.stack(rows["vector"].to_list()).astype(np.float64))
        self.ids += rows["ids"].to_list()
        self.neighbours += rows["neighbours"].to_list()
        self.entry = int(rows["entry"].iloc[0])

    def close(self) -> None:
        """All rows have come."""
        self.vectors = np.concatenate(self.vectors)
        lengths = np.array([len(n) for n in self.neighbours])
        self.graph = np.full((len(lengths), max(1, lengths.max())), -1)
        self.graph[np.arange(self.graph.shape[1])[None] < lengths[:, None]] = np.concatenate(self.neighbours)
        self.unit, self.neighbours, self.ready = _unit(self.vectors), [], True

    def hits(self, query_ids: np.ndarray, wanted: np.ndarray, k: int) -> pd.DataFrame:
        """The `k` nearest found of each query, never its own id."""
        found, _ = beam_search(self.unit, self.graph, self.entry, _unit(wanted), min(max(SEARCH_BEAM, 2 * k), len(self.unit)))
        query, place = np.nonzero(found >= 0)
        node = found[query, place]
        score = cosines(wanted[query], self.vectors[node])
        counts = np.array([len(self.ids[v]) for v in node])
        rows = pd.DataFrame({"query_id": np.repeat(query_ids[query], counts), "vec_id": np.concatenate([self.ids[v] for v in node]), "score": np.repeat(score, counts)})
        rows = rows[rows["query_id"] != rows["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return rows.groupby("query_id", sort=False).head(k)


def search(index: DataFrame, queries: DataFrame, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row of `queries` (vec_id, vector), never the row's own id.

    Nearest first by cosine, ties to the smaller vec_id. Queries visit the graphs of all shards of their length. A task reads a shard's rows first and then
    lets its queries go by, so it holds one shard and a batch of queries, however many there are. The index moves once; only where shards are fewer than
    cores do blocks of `block_queries` queries get copies of a shard. Ids must be distinct; a query that finds nothing has no row.
    """
    spark = index.sparkSession
    shards = stored(index.select("dim", "shard").distinct(), "shards")
    count = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    blocks = max(1, min(-(-queries.count() // block_queries), -(-spark.sparkContext.defaultParallelism // count)))
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "node", "ids", "vector", "neighbours", "entry")
    asked = (queries.select(F.size("vector").alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), F.array("vec_id").alias("ids"), "vector")
             .join(F.broadcast(shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))), "dim").withColumn("shard", F.explode("shards")).drop("shards"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, shard = None, _Shard()
        for batch in batches:
            for key, rows in batch.groupby([*_SHARD, "asks"]):
                if key[:3] != at:
                    at, shard = key[:3], _Shard()
                if not key[3]:
                    shard.add(rows)
                    continue
                if not shard.ready:
                    shard.close()
                for begin in range(0, len(rows), BATCH):
                    part = rows.iloc[begin:begin + BATCH]
                    yield shard.hits(part["ids"].map(lambda ids: ids[0]).to_numpy(), np.stack(part["vector"].to_list()).astype(np.float64), k)

    placed = held.unionByName(asked, allowMissingColumns=True).repartitionById(count * blocks, F.col("shard") * blocks + F.col("block"))
    found = placed.sortWithinPartitions(*_SHARD, "asks", "node").mapInPandas(walk, _HITS)
    nearest = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part: a vec_id, and a valid vector. Repeated rows of an id count once, by the smallest vector."""
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every vector whose id is divisible by 50, among all others."""
    vectors = stored(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "usable")
    return search(build_index(vectors, 5), vectors.where("vec_id % 50 = 0"), 5)
