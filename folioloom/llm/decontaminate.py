"""Benchmark passages in training texts, found by spaced seeds.

A seed is five words of a passage, taken at the places of a mask; the places between are free. Test and training seeds meet in a hash join,
and every hit is verified on its diagonal: a window of WINDOW words in which at least four of five agree. Words may be
substituted, not inserted. The three masks together miss no such window (see `lossless`), so the result is that of comparing
every document with every passage.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.columns import unused
from folioloom.operators.skew import BROADCAST_BYTES, stored

MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Words of a window; a shorter passage is one window. Below SUBSTITUTABLE words all must agree, below LEAST a passage is no evidence.
WINDOW, SUBSTITUTABLE, LEAST = 20, 10, 5
NO_WORD = r"[^\p{L}\p{N}]+"
#: Bytes that a seed of a passage of WINDOW words takes in memory, as a bound; longer passages count by their words.
_SEED_BYTES, _WORD_BYTES = 216, 24
#: Words whose hits one task holds at a time; as many as the longest passage has, if that is more.
SEGMENT = 256


def lossless(length: int, substitutions: int) -> bool:
    """Whether some mask fits between the substitutions, wherever these are in a window of `length` words."""
    def missed(places: tuple[int, ...]) -> bool:
        return all(any(at + k in places for k in mask) for mask in MASKS for at in range(length - mask[-1]))

    return not any(missed(places) for places in combinations(range(length), substitutions))


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def _seeds(words: str, at: str) -> Column:
    """One hash per mask at a word; NULL where the mask leaves the text."""
    return F.array(*[F.when(F.col(at) + mask[-1] < F.size(words), F.xxhash64(F.lit(m), *[F.get(words, F.col(at) + k) for k in mask])) for m, mask in enumerate(MASKS)])


def _seed_at(words: str, at: Column, mask: str) -> Column:
    """The hash of one mask, as in `_seeds`; the mask must lie within the text."""
    out = F.lit(None).cast("long")
    for m, places in enumerate(MASKS):
        out = F.when(F.col(mask) == m, F.xxhash64(F.lit(m), *[F.get(words, at + k) for k in places])).otherwise(out)
    return out


def _positions(rows: DataFrame, keys: list[str], own: str = "words", skipped: str = "0") -> DataFrame:
    """A row for each word of `own` and mask; `at` counts in `words`, where `own` begins after `skipped`.

    Outer generators keep the text from being split a second time for a filter on its size.
    """
    each = rows.select(*keys, "words", F.expr(skipped).alias("_skipped"), F.posexplode_outer(F.expr(own)).alias("_at", "_word"))
    each = each.select(*keys, "words", (F.col("_skipped") + F.col("_at")).alias("at"))
    return each.select(*keys, "words", "at", F.posexplode_outer(_seeds("words", "at")).alias("mask", "seed"))


def _segments(texts: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """Texts in rows of `length` words with those around them that a passage can reach: `words` begin at word `base` of the text.

    Generated code keeps what one row yields, so rows must be short for the hits of repetitive text to be few at a time.
    """
    margin = max(longest, MASKS[-1][-1] + 1)
    length = max(SEGMENT, margin)
    cut = f"""transform(sequence(0, greatest(size(words) - 1, 0), {length}), s -> named_struct(
        'base', greatest(s - {margin}, 0), 'skipped', least(s, {margin}), 'words', slice(words, greatest(s - {margin}, 0) + 1, least(s, {margin}) + {length + margin})))"""
    parts = texts.select(*keys, F.explode_outer(F.expr(cut)).alias("_part"))
    parts = parts.select(*keys, F.col("_part.base").alias("base"), F.col("_part.skipped").alias("skipped"), F.col("_part.words").alias("words"))
    return _positions(parts, [*keys, "base"], f"slice(words, skipped + 1, {length})", "skipped").drop("mask")


def _benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where(f"n >= {LEAST}")
    width = F.least("n", F.lit(WINDOW))
    need = F.when(F.col("n") < SUBSTITUTABLE, F.col("n")).otherwise(width - F.floor(width / 5)).cast("int")
    items = items.select("item_id", "words", "n", width.alias("width"), need.alias("need"))
    found = _positions(items, ["item_id", "n", "width", "need"]).where("seed is not null")
    span = F.element_at(F.array(*[F.lit(mask[-1] + 1) for mask in MASKS]), F.col("mask") + 1)
    earlier = F.when(F.col("at") > 0, _seed_at("words", F.col("at") - 1, "mask")).alias("earlier")
    return found.select("seed", "mask", "item_id", F.col("words").alias("item_words"), F.col("at").alias("item_at"), span.alias("span"), "n", "width", "need",
                        earlier, _seeds("words", "at")[0].alias("plain"))


def _first_on_its_run() -> Column:
    """Whether a hit must be verified: its mask does not hit one word earlier, nor the first mask at the same place.

    The windows of those hits include its own, since the first mask is the shortest. As a condition of the join this is decided before a hit
    becomes a row, so text that repeats itself gives about one row for each diagonal.
    """
    continues = (F.col("at") > 0) & (_seed_at("words", F.col("at") - 1, "mask") == F.col("earlier"))
    doubled = (F.col("mask") > 0) & (_seeds("words", "at")[0] == F.col("plain"))
    return ~F.coalesce(continues, F.lit(False)) & ~F.coalesce(doubled, F.lit(False))


def _verified(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The first and the best window that is good enough, among those on the hit's diagonal that hold the hit or begin later.

    Only the words beside the passage go on from the join, so a long text with many hits is not copied for each. One pass slides the window
    along; its lambda refers to columns only. It stands in a generator, because a filter on its result would move into the join,
    which then would be too large for generated code.
    """
    diagonal = F.col("at") - F.col("item_at")
    first = F.greatest(F.lit(0), -diagonal, F.col("item_at") + F.col("span") - F.col("width"))
    last = F.least(F.col("n") - F.col("width"), F.size("words") - F.col("width") - diagonal)
    beside = F.slice("words", F.greatest(F.lit(0), diagonal) + 1, F.col("n"))
    placed = hits.select(*keys, "base", "item_id", "item_words", "width", "need", diagonal.alias("diagonal"), first.alias("first"), last.alias("last"), beside.alias("beside"))
    same = "if(get(beside, {0} + least(diagonal, 0)) = get(item_words, {0}), 1, 0)"
    slid = f"""aggregate(sequence(first, last + width - 1), named_struct('now', 0, 'best', 0, 'start', cast(null as int)),
        (a, i) -> transform(array(a.now + {same.format('i')} - if(i - width >= first, {same.format('(i - width)')}, 0)), now -> named_struct('now', now,
            'best', if(i - first + 1 >= width, greatest(a.best, now), a.best),
            'start', if(a.start is null and i - first + 1 >= width and now >= need, i - width + 1, a.start)))[0])"""
    found = placed.select(*keys, "base", "item_id", "width", "diagonal", F.explode_outer(F.array(F.when(F.col("first") <= F.col("last"), F.expr(slid)))).alias("slid")).where("slid.start is not null")
    return found.select(*keys, "item_id", (F.col("base") + F.col("diagonal") + F.col("slid.start")).alias("word_start"), F.col("width").alias("window_words"), F.col("slid.best").alias("words_agreeing"))


def overlaps(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, item_id, word_start, window_words, words_agreeing for each document and passage that overlap.

    `word_start` counts words before the first window that agrees; `words_agreeing` is the best window's. NULL and empty texts
    overlap with nothing, rows that agree in `keys` count as one document, NULL keys and ids are values like others. An empty table on either
    side gives no row. Other columns of both tables are ignored. A benchmark whose seeds outgrow a broadcast goes in blocks.
    """
    texts = docs.select(*keys, words_of(F.col("text")).alias("words"))
    seeds = stored(_benchmark_seeds(benchmark), "seeds")
    size, longest = seeds.agg(F.sum(F.lit(_SEED_BYTES) + _WORD_BYTES * F.col("n") + F.octet_length(F.concat_ws(" ", "item_words"))), F.max("n")).first()
    blocks = -(-(size or 0) // BROADCAST_BYTES) or 1
    positions = _segments(texts, keys, longest or 0).alias("text")
    found = None
    for block in range(blocks):
        part = seeds if blocks == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block)
        hit = (F.col("text.seed") == F.col("passage.seed")) & _first_on_its_run()
        more = _verified(positions.join(F.broadcast(part.alias("passage")), hit), keys)
        found = more if found is None else found.unionByName(more)
    return found.groupBy(*keys, "item_id").agg(F.min("word_start").alias("word_start"), F.first("window_words").alias("window_words"), F.max("words_agreeing").alias("words_agreeing"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that overlap with no passage, unchanged, whatever other columns they have.

    Rows are told apart by doc_id (NULL included) and a hash of the text, so rows that share an id are judged by their own texts.
    """
    own, doc, text = unused(docs, "_hash", "_doc", "_text")
    found = overlaps(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), benchmark, ["doc_id", "text_hash"])
    found = stored(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct(), "contaminated")
    marked = docs.withColumn(own, F.xxhash64("text"))
    return marked.join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text)), "left_anti").drop(own)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of `benchmark`, with that passage."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["doc_id"])


SQL = f"""
with d as (select doc_id, w, generate_subscripts(w, 1) - 1 p, unnest(w) word, len(w) n
           from (select doc_id, list_filter(string_split_regex(lower(text), '{NO_WORD}'), lambda x: x <> '') w from documents)),
b as (select item_id, generate_subscripts(w, 1) - 1 i, unnest(w) word, len(w) n
      from (select item_id, list_filter(string_split_regex(lower(text), '{NO_WORD}'), lambda x: x <> '') w from benchmark)),
m as (select d.doc_id, b.item_id, d.p - b.i as diag, b.i i, d.n dn, b.n bn, least(b.n, {WINDOW}) width,
             case when b.n < {SUBSTITUTABLE} then b.n else least(b.n, {WINDOW}) - least(b.n, {WINDOW}) // 5 end need
      from d join b using (word) where b.n >= {LEAST}),
g as (select doc_id, item_id, diag, any_value(dn) dn, any_value(bn) bn, any_value(width) width, any_value(need) need, list(i) places
      from m group by doc_id, item_id, diag having count(*) >= any_value(need)),
s as (select doc_id, item_id, diag, width, need, places, unnest(generate_series(greatest(0, -diag), least(bn - width, dn - width - diag))) s from g),
c as (select doc_id, item_id, diag + s word_start, width, need, len(list_filter(places, lambda x: x >= s and x < s + width)) agree from s)
select doc_id, item_id, min(word_start)::int word_start, any_value(width)::int window_words, max(agree)::int words_agreeing from c where agree >= need group by doc_id, item_id
"""
