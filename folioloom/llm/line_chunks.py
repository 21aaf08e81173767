"""Repeated multi-line chunks, cut at content-defined boundaries.

A line ends a chunk when the rolling hash of it and the line before is a multiple of DIVISOR. Boundaries thus depend on two lines only, and
texts that share a passage fall into step after two lines, wherever it stands. A chunk is known by a 64-bit digest; digests that occur more
than once are looked at again with their bytes, and only chunks of equal bytes count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm.columns import unused
from folioloom.operators.skew import fits_broadcast, stored

DIVISOR, BASE = 3, 31
#: A chunk of fewer lines or words is left alone: texts share those by chance.
MIN_LINES, MIN_WORDS = 2, 8
_KEYS = ["doc_id", "text_hash"]


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def _spans(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row per chunk: `first` and `n` lines, and its text. Lines are kept in a column of their own, so that no lambda splits the text again."""
    lines = docs.select(*keys, F.split("text", "\n", -1).alias("lines"))
    hashed = lines.select(*keys, "lines", F.transform("lines", _line_hash).alias("hashes"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("hashes", 1, F.greatest(F.size("hashes") - 1, F.lit(0))))
    ends = F.zip_with("hashes", before, lambda h, b: F.pmod(h + BASE * b, F.lit(DIVISOR)) == 0)
    placed = F.filter(F.transform(ends, lambda e, i: F.when(e, i)), lambda i: i.isNotNull())
    cut = hashed.select(*keys, "lines", F.array_union(placed, F.array(F.size("lines") - 1)).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice("ends", 1, F.size("ends") - 1), lambda e: e + 1))
    spans = cut.select(*keys, "lines", F.explode_outer(F.arrays_zip(starts.alias("first"), F.col("ends").alias("last"))).alias("span"))
    spans = spans.select(*keys, "lines", F.col("span.first").alias("first"), (F.col("span.last") - F.col("span.first") + 1).alias("n"))
    return spans.where(f"n >= {MIN_LINES}").select(*keys, "first", "n", F.array_join(F.slice("lines", F.col("first") + 1, F.col("n")), "\n").alias("chunk"))


def _passages(docs: DataFrame, keys: list[str]) -> DataFrame:
    """A row per shortest passage: `first` and `n` lines, and its text. Each of at most MIN_WORDS lines with words, and the blank ones between.

    Every array is referred to more than once, which keeps the optimizer from computing it anew inside a lambda.
    """
    lines = docs.select(*keys, F.split("text", "\n", -1).alias("lines"))
    numbered = F.transform("lines", lambda line, i: F.struct(i.alias("at"), F.regexp_count(line, F.lit(r"[^ \n]+")).alias("words")))
    worded = lines.select(*keys, "lines", F.filter(numbered, lambda x: x["words"] > 0).alias("worded"))

    def reaching(k: Column, step: int) -> Column:
        """The line at which the words from the k-th line with words on, forwards or backwards, are enough; NULL if they never are."""
        at, words = F.get("worded", k)["at"], F.get("worded", k)["words"]
        far = F.when(words >= MIN_WORDS, at + step * (MIN_LINES - 1))
        for m in range(1, MIN_WORDS):
            # Before the first element, get() is NULL as it is after the last one.
            other = F.get("worded", k + step * m)
            words = words + other["words"]
            beyond = F.greatest(other["at"], at + MIN_LINES - 1) if step > 0 else F.least(other["at"], at - MIN_LINES + 1)
            far = F.coalesce(far, F.when(words >= MIN_WORDS, beyond))
        return F.when((far >= 0) & (far < F.size("lines")), far)

    def code(first: Column, last: Column) -> Column:
        return F.shiftleft(first.cast("long"), 32) + last

    def both(_: Column, k: Column) -> Column:
        at = F.get("worded", k)["at"]
        return F.array(code(at, reaching(k, 1)), code(reaching(k, -1), at))

    # Numbers, not structs: only of those array_distinct makes a hash set.
    codes = F.array_distinct(F.filter(F.flatten(F.transform("worded", both)), lambda c: c.isNotNull()))
    coded = worded.select(*keys, "lines", codes.alias("codes"))

    def cut(c: Column) -> Column:
        first, last = F.shiftright(c, 32).cast("int"), c.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
        return F.struct(first.alias("first"), (last - first + 1).alias("n"), F.array_join(F.slice("lines", first + 1, last - first + 1), "\n").alias("chunk"))

    return coded.select(*keys, F.explode(F.transform("codes", cut)).alias("span")).select(*keys, "span.*")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _repeated(docs: DataFrame) -> DataFrame:
    """Chunks to remove: keys, `first`, `n`, and the place `kept_doc_id`, `kept_line` of the earliest occurrence."""
    return _later(_spans(_keyed(docs), _KEYS))


def _later(chunks: DataFrame) -> DataFrame:
    """Those of the chunks (keys, `first`, `n`, `chunk`) that an earlier one equals without sharing lines with it, and the place of the earliest."""
    enough = F.regexp_count("chunk", F.lit(r"[^ \n]+")) >= MIN_WORDS
    chunks = chunks.withColumn("digest", F.xxhash64("chunk"))
    # Digests come from a narrow pass; bytes are carried only for those that occur again.
    again = chunks.where(enough).groupBy("digest").agg(F.count("*").alias("_n")).where("_n > 1").select("digest")
    again = stored(again, "repeated-digests")
    small = fits_broadcast(again)
    texts = stored(chunks.join(F.broadcast(again) if small else again, "digest", "left_semi").where(enough), "repeated-chunks")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "first")
    # Bytes are compared by grouping on them; map-side sums leave one row per task and chunk, however often it occurs.
    earliest = stored(texts.groupBy("digest", "chunk").agg(F.min(rank).alias("kept"), F.count("*").alias("_n")).where("_n > 1").drop("_n"), "earliest-chunks")
    found = texts.withColumn("rank", rank).join(earliest, ["digest", "chunk"]).where("rank != kept")
    found = found.where("not (doc_id <=> kept.doc_id and text_hash = kept.text_hash and first < kept.first + n)")
    return found.select(*_KEYS, "first", "n", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.first").alias("kept_line"))


def removed_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, first_line, n_lines, kept_doc_id, kept_line of every chunk that repeats an earlier one. Lines count from 0.

    Earlier is the smaller doc_id (NULL last), then the text's hash, then the line. Rows that agree in doc_id and text are one document to
    this operator: neither is later than the other. NULL texts have no chunk, other columns are ignored, an empty table gives no row.
    """
    return _repeated(docs).select("doc_id", F.col("first").alias("first_line"), F.col("n").alias("n_lines"), "kept_doc_id", "kept_line")


def without_repeated_chunks(docs: DataFrame) -> DataFrame:
    """All rows of `docs` with later occurrences cut from `text` (and `n_chars` counted anew, if there is one and the text changed).

    No row is dropped; a text of which nothing is left becomes empty. Other columns stay as they are.
    """
    return _without(docs, _repeated(docs))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Like `removed_chunks`, for every shortest passage that repeats an earlier one: two lines and eight words, wherever they stand.

    They overlap; together they cover all lines with words of all longer repeats. Blank lines at the edges of a repeat may be missing.
    """
    return _repeated_passages(docs).select("doc_id", F.col("first").alias("first_line"), F.col("n").alias("n_lines"), "kept_doc_id", "kept_line")


def _repeated_passages(docs: DataFrame) -> DataFrame:
    return _later(_passages(_keyed(docs), _KEYS))


def without_repeated_passages(docs: DataFrame) -> DataFrame:
    """Like `without_repeated_chunks`, for all repeated passages; chunks are cut as well, since they may have more blank lines at the edges."""
    return _without(docs, _repeated_passages(docs).unionByName(_repeated(docs)))


def _without(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    own, doc, text_hash, cuts, lines, kept = unused(docs, "_hash", "_doc", "_text", "_cuts", "_lines", "_kept")
    found = stored(repeated.select(*_KEYS, "first", "n").distinct(), "removed-chunks")
    gone = found.groupBy(*_KEYS).agg(F.collect_list(F.struct("first", "n")).alias(cuts)).select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), cuts)
    if fits_broadcast(found):
        gone = F.broadcast(gone)
    joined = docs.withColumn(own, F.xxhash64("text")).join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text_hash)), "left")
    numbers = F.flatten(F.transform(cuts, lambda c: F.sequence(c["first"], c["first"] + c["n"] - 1)))
    # Kept line numbers come from one set difference: a test of every line against every cut would be quadratic.
    joined = joined.withColumn(lines, F.when(F.col(cuts).isNotNull(), F.split("text", "\n", -1)))
    joined = joined.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op9_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated multi-line chunk of `documents`, and where its first occurrence stays."""
    return removed_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shortest repeated passage of `documents`, and where its first occurrence stays."""
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Of `op9_line_chunks`.
SQL = f"""
with l as (select doc_id, unnest(ls) line, generate_subscripts(ls, 1) - 1 i, len(ls) n from (select doc_id, string_split(text, chr(10)) ls from documents)),
h as (select *, ('0x' || md5(line)[1:8])::bigint h from l),
e as (select *, (h + {BASE} * coalesce(lag(h) over (partition by doc_id order by i), 0)) % {DIVISOR} = 0 ends from h),
c as (select *, coalesce(sum(ends::int) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) k from e),
chunks as (select doc_id, min(i) first_line, count(*) n_lines, string_agg(line, chr(10) order by i) chunk from c group by doc_id, k having count(*) >= {MIN_LINES}),
long_ones as (select * from chunks where len(regexp_extract_all(chunk, '[^ \\n]+')) >= {MIN_WORDS}),
ranked as (select *, first_value(doc_id) over w kept_doc_id, first_value(first_line) over w kept_line, row_number() over w r
           from long_ones window w as (partition by chunk order by doc_id, first_line rows between unbounded preceding and unbounded following))
select doc_id, first_line::int first_line, n_lines::int n_lines, kept_doc_id, kept_line::int kept_line from ranked where r > 1
"""
