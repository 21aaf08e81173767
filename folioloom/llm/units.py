"""Repeated paragraphs, lines or sentences.

Units are normalised and known by a 128-bit digest. Digests are grouped over the corpus; the earliest occurrence stays. Passages are often copied from
within a line into another, so that none of their lines is whole on both sides; their sentences are. Short units also recur by
chance or as the furniture of texts, so what is a repeated passage are adjoining later occurrences of MIN_WORDS words together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.llm.batches import in_small_batches, text_slices
from folioloom.llm.columns import unused
from folioloom.operators.skew import stored

#: Words of adjoining repeated units that make them a repeated passage.
MIN_WORDS = 25
#: What separates units. A sentence also ends with its line.
SEPARATORS = {"sentence": r"(?<=[.!?])[ \t]+|\n", "line": "\n", "paragraph": r"\n[ \t]*\n\s*"}


def normalised(unit: str) -> bytes:
    """A-Z lower-cased, runs of ASCII white space as one space, none at the ends; as UTF-8."""
    return b" ".join(unit.encode().lower().split())


def units(docs: DataFrame, kind: str = "line") -> DataFrame:
    """A row per unit that has a word: doc_id, text_hash, unit (its number among these), start, stop (characters of the original text), words, digest."""
    separator = SEPARATORS[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        boundary, digest = re.compile(separator), xxhash.xxh3_128_digest
        for batch in text_slices(batches, limit=4 << 20):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, text_hash, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True):
                start, number = 0, 0
                for stop, after in [*((m.start(), m.end()) for m in boundary.finditer(text)), (len(text), 0)]:
                    plain = normalised(text[start:stop])
                    if plain:
                        for column, value in zip(out, (doc_id, text_hash, number, start, stop, plain.count(b" ") + 1, digest(plain)), strict=True):
                            column.append(value)
                        number += 1
                    start = after
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                                             names=["doc_id", "text_hash", "unit", "start", "stop", "words", "digest"])

    texts = in_small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").where("text is not null")
    return texts.mapInArrow(run, "doc_id long, text_hash long, unit int, start int, stop int, words int, digest binary")


def repeated_units(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, bridge: int = 0) -> DataFrame:
    """doc_id, text_hash, unit, start, stop, kept_doc_id, kept_start of every unit to remove: those of `later_units` in runs of `min_words` and more."""
    return later_units(docs, kind, bridge).where(F.col("run_words") >= min_words).drop("run_words")


def later_units(docs: DataFrame, kind: str = "line", bridge: int = 0) -> DataFrame:
    """doc_id, text_hash, unit, start, stop, kept_doc_id, kept_start, run_words of every later occurrence; offsets are characters of the original text.

    `run_words` are the words of the repeated units of its run; up to `bridge` other units between two repeated ones do not end a run.
    The earliest occurrence has the smallest doc_id (NULL last), then the smallest text hash, then the smallest offset. Rows that agree in
    doc_id and text are one document. NULL texts and units without a word are never repeated, other columns are ignored, an empty
    table gives no row. Minima are summed up before the shuffle; a digest with many occurrences may be split in the join.
    """
    found = stored(units(docs, kind), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_hash", "start")
    earliest = stored(found.groupBy("digest").agg(F.min(rank).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "earliest-units")
    # Without its digest a row may go anywhere for the distinct, which leaves the join free to split a hot digest.
    later = found.withColumn("rank", rank).join(earliest, "digest").where("rank != kept").drop("digest", "rank").distinct()
    # Units without words have no number, so they break no run.
    document = Window.partitionBy("doc_id", "text_hash").orderBy("unit")
    breaks = later.withColumn("breaks", F.when(F.col("unit") - F.lag("unit").over(document) <= 1 + bridge, 0).otherwise(1))
    run = breaks.withColumn("run", F.sum("breaks").over(document)).withColumn("run_words", F.sum("words").over(Window.partitionBy("doc_id", "text_hash", "run")))
    return run.select("doc_id", "text_hash", "unit", "start", "stop", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.start").alias("kept_start"), "run_words")


def without_repeated_units(docs: DataFrame, kind: str = "sentence", min_words: int = MIN_WORDS, bridge: int = 0) -> DataFrame:
    """All rows of `docs` with the repeated units cut from `text`, and `kept_spans`: (start, stop) of what stays, in the original text.

    Separators stay with the unit before them. NULL texts have NULL spans. Other columns stay as they are; if one is called `kept_spans`, the new one has
    an underscore before its name.
    """
    own, doc, text_hash, cuts, kept = unused(docs, "_hash", "_doc", "_text", "_cuts", "kept_spans")
    found = repeated_units(docs, kind, min_words, bridge).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    found = stored(found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), cuts), "cuts")
    joined = docs.withColumn(own, F.xxhash64("text")).join(found, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(text_hash)), "left")
    gone = F.coalesce(F.col(cuts), F.array().cast("array<struct<start:int,stop:int>>"))
    begins = F.concat(F.array(F.lit(0)), F.transform(gone, lambda c: c["stop"]))
    ends = F.concat(F.transform(gone, lambda c: c["start"]), F.array(F.length("text")))
    spans = F.when(F.col("text").isNotNull(), F.filter(F.arrays_zip(begins.alias("start"), ends.alias("stop")), lambda s: s["stop"] > s["start"]))
    joined = joined.withColumn(kept, spans)
    pieces = F.expr(f"array_join(transform({kept}, s -> substring(text, s.start + 1, s.stop - s.start)), '')")
    return joined.withColumn("text", F.when(F.col(cuts).isNull(), F.col("text")).otherwise(pieces)).select(*docs.columns, kept)


def op8_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence or line of `documents` that is part of a repeated passage, with the place of its first occurrence."""
    found = repeated_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "unit", "start", "stop", "kept_doc_id", "kept_start")


def op8_later_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every later occurrence of a line of `documents`, with the words of its run, bridging one other line."""
    return later_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), bridge=1).drop("text_hash")


#: Of `op8_repeated_lines`.
SQL = f"""
with l as (select doc_id, unnest(ls) piece, generate_subscripts(ls, 1) u from (select doc_id, regexp_extract_all(text, '[^\\n]*?(?:[.!?][ \\t]+|\\n|\\z)') ls from documents)),
o as (select *, coalesce(sum(length(piece)) over (partition by doc_id order by u rows between unbounded preceding and 1 preceding), 0) s,
             regexp_replace(piece, '([.!?])[ \\t]+$|\\n$', '\\1') unit_text from l),
q as (select *, trim(regexp_replace(translate(unit_text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\n\\x0b\\x0c]+', ' ', 'g'), ' ') plain from o),
r as (select *, len(string_split(plain, ' ')) words, row_number() over (partition by doc_id order by s) - 1 v, row_number() over w k, first_value(doc_id) over w kept_doc_id, first_value(s) over w kept_start
      from q where plain <> '' window w as (partition by plain order by doc_id, s rows between unbounded preceding and unbounded following)),
g as (select *, v - row_number() over (partition by doc_id order by v) run from r where k > 1),
w as (select *, sum(words) over (partition by doc_id, run) run_words from g)
select doc_id, v::int unit, s::int "start", (s + length(unit_text))::int stop, kept_doc_id, kept_start::int kept_start from w where run_words >= {MIN_WORDS}
"""
