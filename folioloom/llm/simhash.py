"""SimHash fingerprints, and the groups of documents whose fingerprints link.

Fingerprints are joined with themselves along binary tries. There are four tries, one for each 16-bit block put first: two
fingerprints that differ in at most three bits agree in at least one whole block, so the upper 16 levels of a trie need only
pairs of a node with itself, and a Spark shuffle by block and value spreads them. Below, node pairs are walked together: the
differing bits add up, a pair beyond the error budget is dropped with everything below it, and a pair of single leaves is settled
at once by the remaining bits. Links leave a task as a forest of its fingerprints, never as all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.batches import in_small_batches, runs, segment_sums, text_slices
from folioloom.llm.columns import unused
from folioloom.llm.components import connected_components
from folioloom.operators.skew import fits_broadcast, stored

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
#: Bits that one step of the walk goes down, and node pairs that are expanded at a time.
STEP, FRONTIER = 4, 1 << 18
#: Fingerprints of one block value that a task walks as one trie; a larger trie is cut into its node pairs 8 levels below.
TRIE_ROWS = 1 << 20
CUT_BITS = 8
#: Rows that a task gathers before it walks the tries among them.
GATHER_ROWS = 1 << 18


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bits that are set in more than half of the XXH64 values of the text's shingles; zero without words."""
    hashes, _ = _hashes([text], shingle_words)
    return int(_majority(hashes, np.array([len(hashes)]))[0])


def _hashes(texts: list[bytes], shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, and their number per text. Only A-Z are lower-cased; words are cut at ASCII white space."""
    import xxhash

    digest, found, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= shingle_words:
            shingles = [b" ".join(words)] if words else []
        else:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-shingle_words] + 1]).tolist()
            shingles = [joined[a:b] for a, b in zip(starts, ends[shingle_words - 1:].tolist(), strict=True)]
        counts.append(len(shingles))
        found.extend([digest(s, SEED) for s in shingles])
    return np.array(found, dtype=np.uint64), np.array(counts, dtype=np.int64)


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), dtype=np.uint64)
    for bit in range(64):
        ones = segment_sums(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), counts)
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, a hash of the text and the signed 64-bit `fp` of every row; a NULL text counts as empty. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, limit=2 << 20):
            texts = batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()
            fps = _majority(*_hashes(texts, shingle_words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest label reachable, after the links a-b are added. `label` points to a root, itself included."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            return label


def walk(keys: np.ndarray, groups: np.ndarray, depth: int, errors: np.ndarray | None = None, sides: np.ndarray | None = None,
         max_bits: int = MAX_BITS) -> np.ndarray:
    """Number of the first row of each row's component, over the tries that `groups` marks.

    `keys` ascend within each group, are distinct there, and agree in their upper `depth` bits. With `sides` (0 and 1), a group
    is a node pair instead: only rows of different sides link, and `errors` is what the pair has used of the budget.
    """
    n = len(keys)
    label = np.arange(n)
    if n < 2:
        return label
    new_group = np.flatnonzero(np.diff(groups, prepend=groups[0] - 1))
    if sides is None:
        starts = [new_group]
        pairs = np.stack([np.arange(len(new_group)), np.arange(len(new_group)), np.zeros(len(new_group), dtype=np.int64)])
        family = groups
    else:
        family = groups * 2 + sides
        heads = np.flatnonzero(np.diff(family, prepend=family[0] - 1))
        both = np.flatnonzero(groups[heads][1:] == groups[heads][:-1])
        starts = [heads]
        pairs = np.stack([both, both + 1, errors[heads[both]]])
    fresh = np.diff(family, prepend=family[0] - 1) != 0
    for d in range(depth + STEP, 64 + STEP, STEP):
        prefix = keys >> np.uint64(max(0, 64 - d))
        starts.append(np.flatnonzero(fresh | (np.diff(prefix, prepend=prefix[0]) != 0)))
    stack = [(0, pairs)]
    dirty, uniform = True, {}
    while stack:
        level, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [(level, pairs[:, k:k + FRONTIER]) for k in range(0, pairs.shape[1], FRONTIER)]
            continue
        if dirty:
            uniform, dirty = {}, False
        at = starts[level]
        size = np.diff(at, append=n)
        if level not in uniform:
            low, high = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            uniform[level] = np.where(low == high, low, -1)
        one = uniform[level]
        i, j, used = pairs
        open_ = (one[i] < 0) | (one[i] != one[j])  # the rest is one component already
        open_ &= (size[i] > 1) | (i != j)
        i, j, used = i[open_], j[open_], used[open_]
        leaf = (size[i] == 1) & (size[j] == 1)
        if leaf.any():
            rest = np.uint64(0xFFFFFFFFFFFFFFFF) >> np.uint64(min(63, depth + level * STEP)) if depth + level * STEP < 64 else np.uint64(0)
            a, b = at[i[leaf]], at[j[leaf]]
            linked = np.bitwise_count((keys[a] ^ keys[b]) & rest) + used[leaf] <= max_bits
            if linked.any():
                label, dirty = _labels(label, a[linked], b[linked]), True
        i, j, used = i[~leaf], j[~leaf], used[~leaf]
        if not len(i):
            continue
        below = starts[level + 1]
        first = np.searchsorted(below, at)
        count = np.diff(first, append=len(below))
        left, right = count[i], count[j]
        number = runs(left * right)
        span = np.repeat(right, left * right)
        pair = np.repeat(np.arange(len(i)), left * right)
        a, b = first[i][pair] + number // span, first[j][pair] + number % span
        keep = (i[pair] != j[pair]) | (a <= b)
        a, b, pair = a[keep], b[keep], pair[keep]
        top = np.uint64(max(0, 64 - depth - (level + 1) * STEP))
        differ = np.bitwise_count((keys[below[a]] >> top ^ keys[below[b]] >> top) & np.uint64((1 << STEP) - 1))
        errors_ = used[pair] + differ
        keep = errors_ <= max_bits
        stack.append((level + 1, np.stack([a[keep], b[keep], errors_[keep]])))
    return label


def _links(keys: np.ndarray, firsts: np.ndarray, groups: np.ndarray, depth: int, errors=None, sides=None) -> pa.RecordBatch:
    label = walk(keys, groups, depth, errors, sides)
    tied = np.flatnonzero(label != np.arange(len(label)))
    return pa.RecordBatch.from_arrays([pa.array(firsts[tied]), pa.array(firsts[label[tied]])], names=["a", "b"])


def link_forest(nodes: DataFrame, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """Links (a, b) between the `node` ids of distinct fingerprints `fp` that together connect what at most 3 bits connect."""
    fp = F.col("fp")
    turned = [fp, *[F.shiftleft(fp, k).bitwiseOR(F.shiftrightunsigned(fp, 64 - k)) for k in (16, 32, 48)]]
    rotated = nodes.select("node", F.posexplode(F.array(*turned)).alias("block", "key"))
    rotated = rotated.withColumn("trie", F.shiftrightunsigned("key", 48).cast("int"))
    # At most 4 * N / trie_rows tries are over the bound, and never more than 4 * 65,536 in all: the list is bounded.
    large = rotated.groupBy("block", "trie").count().where(F.col("count") > trie_rows).drop("count")
    large = stored(large, "large-tries")
    schema = "a long, b long"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, lambda t: _links(t["key"].view(np.uint64), t["node"], (t["block"].astype(np.int64) << 16) | t["trie"], 16), ("block", "trie"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(batches, lambda t: _cut_links(t), ("block", "trie", "low", "high"))

    small_rows = rotated.join(F.broadcast(large), ["block", "trie"], "left_anti")
    forest = (small_rows.repartition("block", "trie").sortWithinPartitions("block", "trie", *_unsigned("key"))
              .select("node", "block", "trie", "key").mapInArrow(whole, schema))
    if large.isEmpty():
        return forest
    child = F.shiftrightunsigned("key", 48 - CUT_BITS).bitwiseAND(F.lit((1 << CUT_BITS) - 1)).cast("int")
    masks = [m for m in range(1 << CUT_BITS) if m.bit_count() <= MAX_BITS]
    paired = (rotated.join(F.broadcast(large), ["block", "trie"], "left_semi").withColumn("child", child)
              .withColumn("other", F.explode(F.array(*[F.col("child").bitwiseXOR(F.lit(m)) for m in masks])))
              .select("node", "block", "trie", "key", F.least("child", "other").alias("low"), F.greatest("child", "other").alias("high")))
    keys = ["block", "trie", "low", "high"]
    side = F.shiftrightunsigned("key", 48 - CUT_BITS).bitwiseAND(F.lit((1 << CUT_BITS) - 1))
    return forest.unionByName(paired.repartition(*keys).sortWithinPartitions(*keys, side, *_unsigned("key")).mapInArrow(cut, schema))


def _unsigned(name: str) -> list:
    return [F.col(name) < 0, F.col(name)]


def _cut_links(t: dict[str, np.ndarray]) -> pa.RecordBatch:
    keys, low, high = t["key"].view(np.uint64), t["low"].astype(np.int64), t["high"].astype(np.int64)
    child = ((keys >> np.uint64(48 - CUT_BITS)) & np.uint64((1 << CUT_BITS) - 1)).astype(np.int64)
    groups = ((t["block"].astype(np.int64) << 16 | t["trie"]) << 2 * CUT_BITS) | low << CUT_BITS | high
    same, depth, out = low == high, 16 + CUT_BITS, []
    for part, sides in ((same, None), (~same, (child == high).astype(np.int64))):
        if part.any():
            out.append(_links(keys[part], t["node"][part], groups[part], depth, np.bitwise_count(low ^ high)[part].astype(np.int64), None if sides is None else sides[part]))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if len(out) > 1 else out[0]


def _gathered(batches: Iterator[pa.RecordBatch], work, by: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """`work` on whole groups of rows that come sorted by `by`, many small groups at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        return {name: np.concatenate([np.asarray(p.column(name)) for p in parts]) for name in parts[0].schema.names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < GATHER_ROWS:
            continue
        table = columns(held)
        changes = np.flatnonzero(np.logical_or.reduce([np.diff(table[name]) != 0 for name in by]))
        if len(changes):
            stop = changes[-1] + 1
            yield work({name: values[:stop] for name, values in table.items()})
            held = [pa.RecordBatch.from_pydict({name: values[stop:] for name, values in table.items()})]
            rows -= stop
    if rows:
        yield work(columns(held))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, trie_rows: int = TRIE_ROWS) -> DataFrame:
    """doc_id, signed `fp` and `component_id` (smallest doc_id reachable over links) of every row.

    NULL and empty texts have fingerprint zero and form one group like any other. A NULL doc_id is part of no group: its
    component_id is NULL. Repeated rows stay and share a component. An empty table gives no row.
    """
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "fingerprint-nodes")
    found = connected_components(link_forest(nodes, trie_rows))
    groups = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("_component"))
    return marked.join(groups, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("_component")).alias("component_id"))


def one_per_group(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group of linked fingerprints, unchanged, whatever other columns it has: the smallest doc_id (NULL last), then the smallest hash of the text.

    Rows are told apart by doc_id (NULL included) and a hash of the text. NULL texts and texts without words form one group. Of rows that agree in
    doc_id and text one stays; which, if other columns differ, is open. An empty table gives no row.
    """
    own, doc, text = unused(docs, "_hash", "_doc", "_text")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash")
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min(rank).alias("first")), "fingerprint-nodes")
    found = connected_components(link_forest(nodes.select(F.col("fp").alias("node"), "fp"), trie_rows=TRIE_ROWS))
    placed = stored(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")), "placed-fingerprints")
    best = stored(placed.groupBy("component").agg(F.min("first").alias("kept")), "kept-rows")
    kept = stored(placed.join(best, "component").select("fp", "kept"), "kept-of-fingerprints")
    gone = marked.join(F.broadcast(kept) if fits_broadcast(kept) else kept, "fp").where(rank != F.col("kept"))
    gone = stored(gone.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "near-copies")
    again = marked.groupBy("doc_id", "text_hash").count().where("count > 1")
    again = stored(again.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)), "repeated-rows")
    same = F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text))
    left = docs.withColumn(own, F.xxhash64("text")).join(F.broadcast(gone) if fits_broadcast(gone) else gone, same, "left_anti")
    again = F.broadcast(again) if fits_broadcast(again) else again
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates(["doc_id", own])).drop(own)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
