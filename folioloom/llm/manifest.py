"""Merkle manifest of a dataset, with a witness for every row.

Leaves are digests of rows. The leaves of one group, in order, are the bottom of a binary tree whose odd last node of a level is hashed alone; the roots
of the groups, in order, are the bottom of another. A witness is what leads from a leaf to the root: a step a level, with the sibling's digest.

A tree is built by appending. Open subtrees of falling heights are kept, each with the witnesses of what stands below it; a new node that is the
right sibling of the last open subtree completes it, and both sides' witnesses are extended by the other's root. Tasks append aligned blocks of
nodes, and the roots of the blocks are appended in the same way to the level above, so no task and no driver sees a whole tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.operators.order import group_key
from folioloom.operators.skew import fits_broadcast, stored

#: Levels that one task appends: blocks of 4,096 nodes.
LEVELS = 12
#: Rows per range when rows are put in order.
RANGE_ROWS = 1 << 18
#: A step of a witness: the side on which the sibling stands (L, R; N for none) and its digest, zeros if there is none.
STEP_BYTES = 33
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Appender:
    """One block of a tree, whose nodes arrive in order. `first` is a node's place in the block, a witness the steps so far."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str, range]] = []  # height, digest, the nodes below
        self.steps: list[bytearray] = []

    def append(self, digest: str) -> None:
        self.open.append((0, digest, range(len(self.steps), len(self.steps) + 1)))
        self.steps.append(bytearray())
        self._complete()

    def close(self, whole: bool) -> str:
        """Hash odd last nodes alone, up to the root of the block: the only node if the block is the whole tree, else one of LEVELS."""
        while len(self.open) > 1 or not whole and self.open[0][0] < LEVELS:
            height, digest, below = self.open.pop()
            for k in below:
                self.steps[k] += b"N" + bytes(STEP_BYTES - 1)
            self.open.append((height + 1, hashlib.sha256(digest.encode()).hexdigest(), below))
            self._complete()
        return self.open[0][1]

    def _complete(self) -> None:
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            height, right, after = self.open.pop()
            _, left, before = self.open.pop()
            to_right, to_left = b"R" + bytes.fromhex(right), b"L" + bytes.fromhex(left)
            for k in before:
                self.steps[k] += to_right
            for k in after:
                self.steps[k] += to_left
            self.open.append((height + 1, hashlib.sha256((left + right).encode()).hexdigest(), range(before.start, after.stop)))


def leaf_digest(values: Iterable[Column]) -> Column:
    """SHA-256 of the values of a row: `-` for NULL, else the number of UTF-8 bytes, a colon and the text of the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds `_place`, from 0, and `_n`, the rows of the `_group`. Equal rows are told apart by where they were stored."""
    rows = stored(rows.withColumn("_tie", F.monotonically_increasing_id()), "leaves")
    keys = ["_group", *order, "_digest", "_tie"]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    count = rows.count()
    parts = max(1, -(-count // RANGE_ROWS), min(cores, count // 4096))
    # The number that Spark gives a row holds its range and its place in it, and is written down before it is used.
    ordered = stored(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_id", F.monotonically_increasing_id()), "ordered-leaves")
    ordered = ordered.withColumn("_range", F.shiftright("_id", 33))
    totals = ordered.groupBy("_group", "_range").agg(F.count("*").alias("n"), F.min("_id").alias("_first"))
    group = Window.partitionBy("_group")
    before = F.sum("n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    totals = stored(totals.select("_group", "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("n").over(group).alias("_n")), "ranges")
    placed = ordered.join(F.broadcast(totals) if fits_broadcast(totals) else totals, ["_group", "_range"])
    return placed.withColumn("_place", F.col("_id") - F.col("_first") + F.col("_before")).drop("_id", "_range", "_first", "_before")


def _append_block(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_place", ignore_index=True)
    block = Appender()
    for digest in rows["_digest"]:
        block.append(digest)
    rows["_root"] = block.close(rows["_n"][0] <= 1 << LEVELS)
    rows["_steps"] = [bytes(s) for s in block.steps]
    return rows


def _appended(nodes: DataFrame) -> DataFrame:
    """The nodes with the root of their block (`_root`) and their steps to it."""
    nodes = nodes.withColumn("_block", F.shiftright("_place", LEVELS))
    return stored(nodes.groupBy("_group", "_block").applyInPandas(_append_block, _schema(nodes) + ", _root string, _steps binary"), "witnesses")


def _schema(table: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)


def with_witnesses(rows: DataFrame, group: Sequence[str], order: Sequence[str], digest: str) -> DataFrame:
    """The rows with `place` in their group (from 0), `top`, the root of the group's tree, and `steps`, the witness of `digest` (lowercase hex) below it.

    Leaves ascend by `order`, NULL first, then by digest. Rows should be narrow, since they are written a few times.
    """
    level = _appended(_numbered(rows.withColumn("_group", group_key(group)).withColumn("_digest", F.col(digest)), order))
    levels = [level]
    while (level.agg(F.max("_n")).first()[0] or 0) > 1 << LEVELS:
        # A tree that is done has one node from here on, which is its root.
        roots = level.where(F.col("_place") == F.shiftleft("_block", LEVELS))
        level = _appended(roots.select("_group", F.col("_block").alias("_place"), F.col("_root").alias("_digest"),
                                       F.shiftright(F.col("_n") + ((1 << LEVELS) - 1), LEVELS).alias("_n")))
        levels.append(level)
    found = levels.pop()
    while levels:
        above = stored(found.select("_group", F.col("_place").alias("_block"), F.col("_steps").alias("_more"), "_root"), "witnesses-above")
        found = levels.pop().drop("_root").join(F.broadcast(above) if fits_broadcast(above) else above, ["_group", "_block"])
        found = found.withColumn("_steps", F.concat("_steps", "_more"))
    return found.select(*rows.columns, F.col("_place").alias("place"), F.col("_root").alias("top"), F.col("_steps").alias("steps"))


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = FIELDS, changed: Column | None = None) -> DataFrame:
    """`order` and `group` of every row, `leaf`, `place` in its group, `subroot` of the group, `root`, and `steps`: its witness from leaf to root.

    `changed` may be another digest, carried along under that name. Groups ascend by their value (NULL first, then by UTF-8 bytes), the leaves of
    one by `order` (NULL first), then by digest, so equal rows are neighbours and each has a witness. A NULL text is told from an empty one.
    Other columns are ignored, whatever their names; an empty table gives no row.
    """
    rows = docs.select(F.col(group).alias("group"), F.col(order).alias("order"), leaf_digest(F.col(f) for f in fields).alias("leaf"),
                       (F.lit(None) if changed is None else changed).cast("string").alias("changed"))
    rows = with_witnesses(rows, ["group"], ["order"], "leaf").withColumnsRenamed({"top": "subroot", "steps": "_below"})
    subroots = with_witnesses(rows.where("place = 0").select(F.col("group").alias("_of"), "subroot"), [], ["_of"], "subroot")
    subroots = stored(subroots.select("_of", F.col("top").alias("root"), F.col("steps").alias("_above")), "subroots")
    joined = rows.join(F.broadcast(subroots) if fits_broadcast(subroots) else subroots, F.col("group").eqNullSafe(F.col("_of")))
    return joined.select(F.col("order").alias(order), F.col("group").alias(group), "leaf", "changed", "place", "subroot", "root", F.concat("_below", "_above").alias("steps"))


def _places(steps: str) -> str:
    return f"filter(sequence(0, cast(octet_length({steps}) / {STEP_BYTES} as int)), k -> k * {STEP_BYTES} < octet_length({steps}))"


def folded(leaf: str, steps: str) -> Column:
    """The root that a leaf and its witness give."""
    side, digest = f"substring({steps}, k * {STEP_BYTES} + 1, 1)", f"lower(hex(substring({steps}, k * {STEP_BYTES} + 2, {STEP_BYTES - 1})))"
    return F.expr(f"""aggregate({_places(steps)}, {leaf}, (below, k) -> sha2(case {side} when X'4C' then concat({digest}, below)
        when X'52' then concat(below, {digest}) else below end, 256))""")


def siblings(steps: str) -> Column:
    """The digests of a witness, one after the other."""
    side, digest = f"substring({steps}, k * {STEP_BYTES} + 1, 1)", f"lower(hex(substring({steps}, k * {STEP_BYTES} + 2, {STEP_BYTES - 1})))"
    return F.expr(f"array_join(transform(filter({_places(steps)}, k -> {side} <> X'4E'), k -> {digest}), '')")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and witness of every document; a seventh of them is checked with a changed `n_chars`, which must not verify."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS))
    found = manifest(docs, changed=tampered).withColumn("used", F.coalesce("changed", "leaf"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings("steps"), 256).alias("proof_sha256"), folded("used", "steps").alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: A step of crc32 for a byte b.
_CRC = """list_reduce(list_concat([4294967295::bigint], {bytes}), lambda c, b: xor(c >> 8, list_reduce([xor(c & 255, b), 0, 0, 0, 0, 0, 0, 0, 0],
  lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)))"""


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 of a text whose code points lie below U+0800, as DuckDB SQL."""
    code = "unicode(c)::bigint"
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: case when {code} < 128 then [{code}] else [192 | ({code} >> 6), 128 | ({code} & 63)] end))"
    return f"xor({_CRC.format(bytes=octets)}, 4294967295)"


def _leaf_sql(n_chars: str) -> str:
    parts = ["doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text"]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + "))"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes (g, lvl, pos, h, n) of the trees over leaves (g, pos, h)."""
    return f"""{name}(g, lvl, pos, h, n) as (select g, 0, pos, h, count(*) over (partition by g) from {leaves} union all
  select g, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (any_value(n) + 1) // 2 from {name} where n > 1 group by g, lvl, pos // 2)"""


def _steps_sql(tree: str, leaves: str) -> str:
    """A list of (side and digest) for each leaf (g, pos)."""
    return f"""select l.g, l.pos, coalesce(list(case when s.h is null then 'N' when s.pos < t.pos then 'L' || s.h else 'R' || s.h end order by t.lvl) filter (t.n > 1), []) steps
  from {leaves} l join {tree} t on t.g is not distinct from l.g and t.pos = l.pos >> t.lvl
  left join {tree} s on s.g is not distinct from t.g and s.lvl = t.lvl and s.pos = xor(t.pos, 1) group by l.g, l.pos"""


SQL = f"""
with recursive d as (select doc_id, lang, {_leaf_sql('n_chars')} leaf, {_leaf_sql('n_chars + 1')} other, {crc32_sql('doc_id::varchar')} % 7 = 0 bad from documents),
l as (select *, lang g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, leaf h from d),
{_tree_sql('t', 'l')},
r as (select g lang, h, row_number() over (order by encode(g) nulls first) - 1 pos, 0 g from t where n = 1),
{_tree_sql('u', 'r')},
a as ({_steps_sql('t', 'l')}),
b as ({_steps_sql('u', 'r')}),
w as (select l.doc_id, l.leaf, case when l.bad then l.other else l.leaf end used, r.h subroot, (select h from u where n = 1) root, list_concat(a.steps, b.steps) steps
      from l join a on a.g is not distinct from l.g and a.pos = l.pos join r on r.lang is not distinct from l.g join b on b.pos = r.pos),
f as (select *, list_reduce(list_concat([used], steps), lambda x, s: sha256(case s[1] when 'L' then s[2:] || x when 'R' then x || s[2:] else x end)) folded_root from w)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_concat([''], list_transform(steps, lambda s: s[2:])), 'string_agg', '')) proof_sha256, folded_root, folded_root = root verified from f
"""
