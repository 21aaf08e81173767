"""Near copies among vectors: links of cosine 0.95 and more, counted, and their components.

Equal vectors are one node. Nodes are hashed by cross-polytopes: after a fast pseudo-random rotation (signs and Hadamard transforms, three times) the
largest coordinate in size, with its sign, is the hash. A table joins a few hashes into a bucket, the node's home; a node also probes the buckets that
were nearly its home. Nodes meet in a bucket that is home to one and home or probe to the other, and are verified there by their cosines. A pair
that meets several times counts where it meets first, which both nodes' buckets tell. No pair leaves its task: tasks return sums, and a forest of links.

Large buckets are cut into blocks, and every two blocks are a task. How many tables it takes is found by hashing random pairs at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from folioloom.llm.batches import in_small_batches
from folioloom.llm.components import connected_components
from folioloom.operators.skew import fits_broadcast, stored

THRESHOLD = 0.95
#: Share of the pairs at the threshold itself that should meet; nearer pairs meet more often.
RECALL = 0.9995
#: Buckets that a node is put in, per table, its home included.
PROBES = 3
#: Nodes per bucket that the number of hashes of a table aims at, and rows of a block of a larger bucket.
BUCKET_ROWS, BLOCK_ROWS = 1024, 2048
#: Random pairs that tell how often pairs at the threshold meet.
TRIAL_PAIRS = 4096


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision, whatever their scale; rows are finite and not zero."""
    vectors = np.asarray(vectors, dtype=np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose width is a power of two, without the constant factor."""
    count, width = rows.shape
    step = 1
    while step < width:
        rows = rows.reshape(count, -1, 2, step)
        rows = np.stack([rows[:, :, 0] + rows[:, :, 1], rows[:, :, 0] - rows[:, :, 1]], axis=2).reshape(count, width)
        step *= 2
    return rows


def padded_size(dimension: int) -> int:
    return max(16, 1 << (dimension - 1).bit_length())


def buckets(unit: np.ndarray, hashes: int, tables: int) -> np.ndarray:
    """(rows, tables, PROBES) bucket numbers of unit vectors, homes first, then those that lose least against them; -1 where there are not as many."""
    width = padded_size(unit.shape[1])
    rows = np.zeros((len(unit), width))
    rows[:, :unit.shape[1]] = unit
    out = np.empty((len(unit), tables, PROBES), dtype=np.int64)
    ways = np.array(list(product(range(PROBES), repeat=hashes)))
    for table in range(tables):
        codes, losses = [], []
        for k in range(hashes):
            turned = rows
            for signs in np.random.default_rng([table, k, width]).choice([-1.0, 1.0], (3, width)):
                turned = _hadamard(turned * signs) / math.sqrt(width)
            best = np.argsort(-np.abs(turned), axis=1, kind="stable")[:, :PROBES]
            value = np.take_along_axis(turned, best, axis=1)
            codes.append(2 * best + (value < 0))
            losses.append(np.abs(value[:, :1]) - np.abs(value))
        loss = sum(losses[k][:, ways[:, k]] for k in range(hashes))
        code = sum(codes[k][:, ways[:, k]] * (2 * width) ** k for k in range(hashes))
        chosen = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        out[:, table] = np.take_along_axis(code, chosen, axis=1)
    return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of (pairs, PROBES) buckets meet: the home of one among the buckets of the other."""
    return (a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1)


def plan_tables(width: int, nodes: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Hashes per table and tables for so many nodes of a padded size. Work on the driver is bounded by TRIAL_PAIRS."""
    hashes = max(1, math.ceil(math.log(max(1, nodes / BUCKET_ROWS)) / math.log(2 * width)))
    rng = np.random.default_rng(5)
    a, b = (unit_vectors(rng.standard_normal((TRIAL_PAIRS, width))) for _ in range(2))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = threshold * a + math.sqrt(1 - threshold ** 2) * unit_vectors(b)
    # The share that meets in none of four tables gives the loss of one; fewer missed pairs than one cannot be told apart.
    found_a, found_b = buckets(a, hashes, 4), buckets(b, hashes, 4)
    missed = np.all([~_met(found_a[:, table], found_b[:, table]) for table in range(4)], axis=0).mean()
    rate = max(missed, 1 / TRIAL_PAIRS) ** 0.25
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(rate)))


def _nodes(vectors: DataFrame, ids: str, column: str) -> tuple[DataFrame, str]:
    """`vec_id`, `key` (NULL if the vector takes no part), `dim` and `vector` of every row, and the numpy type of the stored vectors."""
    kind = "<f4" if vectors.schema[column].dataType.elementType == FloatType() else "<f8"
    element = pa.float32() if kind == "<f4" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column("vector")
            keys, dims, raw = [], [], []
            for values in lists:
                row = None if not values.is_valid else np.asarray(values.values.cast(element).to_numpy(zero_copy_only=False), dtype=kind)
                fit = row is not None and len(row) and values.values.null_count == 0 and np.isfinite(row).all() and row.any()
                data = (row + np.zeros(1, dtype=kind)).tobytes() if fit else None  # no negative zeros
                keys.append(xxhash.xxh3_128_digest(data) if fit else None)
                dims.append(len(row) if fit else None)
                raw.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())],
                                             names=["vec_id", "key", "dim", "vector"])

    rows = in_small_batches(vectors).select(F.col(ids).cast("long").alias("vec_id"), F.col(column).alias("vector"))
    return rows.mapInArrow(run, "vec_id long, key binary, dim int, vector binary"), kind


def _bucket_rows(nodes: DataFrame, plans: dict[int, tuple[int, int]], kind: str) -> DataFrame:
    """A row per node, table and bucket: `dim`, `tab`, `bucket`, `home`, and the node's `key`, `n`, `vector` and `places`, all its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                for at in np.array_split(np.flatnonzero(dims == dim), max(1, (dims == dim).sum() // 4096)):
                    part = batch.take(pa.array(at))
                    unit = unit_vectors(np.frombuffer(b"".join(part.column("vector").to_pylist()), dtype=kind).reshape(len(at), dim))
                    hashes, tables = plans[padded_size(int(dim))]
                    found = buckets(unit, hashes, tables)
                    flat = found.reshape(len(at), -1)
                    places = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                    row = np.repeat(np.arange(len(at)), flat.shape[1])
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int32), PROBES), len(at))
                    home = np.tile(np.arange(PROBES) == 0, len(at) * tables)
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([part.column("dim").take(take), pa.array(table), pa.array(flat.ravel()), pa.array(home), part.column("key").take(take),
                                                      part.column("n").take(take), part.column("vector").take(take), places.take(take)],
                                                     names=["dim", "tab", "bucket", "home", "key", "n", "vector", "places"])

    return in_small_batches(nodes).select("key", "n", "dim", "vector").mapInArrow(
        run, "dim int, tab int, bucket long, home boolean, key binary, n long, vector binary, places array<long>")


class _Block:
    """The rows of one block of a bucket, those at home first."""

    def __init__(self, rows: pd.DataFrame, kind: str):
        rows = rows.sort_values("home", ascending=False, kind="stable")
        self.rows, self.homes = len(rows), int(rows["home"].sum())
        self.key, self.n = rows["key"].to_numpy(), rows["n"].to_numpy()
        if self.rows:
            self.unit = unit_vectors(np.frombuffer(b"".join(rows["vector"]), dtype=kind).reshape(self.rows, -1))
            self.places = np.stack(rows["places"].to_numpy()).reshape(self.rows, -1, PROBES)


def _first_here(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether pairs with places (pairs, tables, PROBES) that meet in this bucket do not meet before."""
    first = np.ones(len(a), dtype=bool)
    for before in range(table):
        first &= ~_met(a[:, before], b[:, before])
    a, b = a[:, table], b[:, table]
    both = (a[:, :1] == b).any(axis=1) & (b[:, :1] == a).any(axis=1)
    return first & ~(both & (np.minimum(a[:, 0], b[:, 0]) < bucket))


def _links(left: _Block, right: _Block, table: int, bucket: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (left, right) of the pairs that link and meet here first; within one block each pair once."""
    same = left is right
    for rows, columns in (((0, left.homes), (0, right.rows)), ((left.homes, left.rows), (0, right.homes)))[:1 if same else 2]:
        for start in range(rows[0], rows[1], 512):
            stop = min(start + 512, rows[1])
            near = left.unit[start:stop] @ right.unit[columns[0]:columns[1]].T >= threshold
            if same:
                near &= np.arange(columns[1])[None] > np.arange(start, stop)[:, None]
            i, j = np.nonzero(near)
            i, j = i + start, j + columns[0]
            keep = _first_here(left.places[i], right.places[j], table, bucket)
            yield i[keep], j[keep]


def _verify(kind: str, threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = rows["low"][0], rows["high"][0]
        left = _Block(rows[rows["block"] == low], kind)
        right = left if low == high else _Block(rows[rows["block"] == high], kind)
        offset = 0 if right is left else left.rows
        key = left.key if right is left else np.concatenate([left.key, right.key])
        n = left.n if right is left else np.concatenate([left.n, right.n])
        links, root = np.zeros(len(key), dtype=np.int64), np.arange(len(key))
        if left.rows and right.rows:
            for i, j in _links(left, right, int(rows["tab"][0]), int(rows["bucket"][0]), threshold):
                j = j + offset
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                _join(root, i, j)
        has = links > 0
        return pd.DataFrame({"key": key[has], "links": links[has], "root": key[root[has]]})

    return run


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Let `root` name the smallest place of every component after the links (i, j) more."""
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, low, high = i[open_], j[open_], np.minimum(a, b)[open_], np.maximum(a, b)[open_]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def near_copies(vectors: DataFrame, ids: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """`vec_id`, `n_links`, `component_id` and `kept` of every row.

    Vectors link if their cosine, in double precision, is `threshold` or more; equal ones always do. Vectors of different lengths do not link, nor
    those that are NULL, empty, zero or hold NULL or non-finite components: these are components of their own. A component's id is its smallest id that
    is not NULL, and rows of that id are kept (a component of NULL ids keeps them). Rows that repeat an id are vectors of their own.
    Other columns are ignored, an empty table gives no row.
    """
    rows, kind = _nodes(vectors, ids, column)
    rows = stored(rows, "vectors")
    nodes = stored(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "vector-nodes")
    size = F.greatest(F.lit(16), F.pow(F.lit(2), F.ceil(F.log2("dim"))).cast("int"))
    plans = {width: plan_tables(width, count, threshold) for width, count in nodes.groupBy(size).count().collect()}
    placed = stored(_bucket_rows(nodes, plans, kind), "buckets")
    large = placed.groupBy("dim", "tab", "bucket").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK_ROWS)
    large = stored(large.select("dim", "tab", "bucket", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "large-buckets")
    cut = placed.join(F.broadcast(large) if fits_broadcast(large) else large, ["dim", "tab", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    met = cut.groupBy("dim", "tab", "bucket", "low", "high").applyInPandas(_verify(kind, threshold), "key binary, links long, root binary")
    met = stored(met, "met")
    linked = met.groupBy("key").agg(F.sum("links").alias("links"))
    components = connected_components(met.select(F.col("key").alias("a"), F.col("root").alias("b"))).withColumnsRenamed({"node": "key"})
    found = stored(nodes.select("key", "n", "low").join(linked, "key", "left").join(components, "key", "left")
                   .select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "low", F.coalesce("component", "key").alias("component")), "linked-nodes")
    lowest = stored(found.groupBy("component").agg(F.min("low").alias("component_id")), "lowest-ids")
    found = stored(found.join(lowest, "component").select("key", "n_links", "component_id"), "node-results")
    joined = rows.select("vec_id", "key").join(F.broadcast(found) if fits_broadcast(found) else found, "key", "left")
    joined = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return joined.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings`."""
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = f"""
with recursive e as (select vec_id, embedding::double[] v from embeddings where embedding is not null and len(embedding) > 0
  and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id a, b.vec_id b from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
r as (select vec_id, vec_id c from embeddings union select r.vec_id, p.b from r join p on p.a = r.c),
c as (select vec_id, min(c) component_id from r group by vec_id),
n as (select a vec_id, count(*) n from p group by a)
select vec_id, coalesce(n, 0)::bigint n_links, component_id, vec_id = component_id kept from c left join n using (vec_id)
"""
