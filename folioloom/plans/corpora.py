"""Corpora that the registered queries derive from the given tables.

Most expressions are plain SQL text valid in Spark and in ANSI engines alike, so that a query and its check read the
same input. Every row and every whole text takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.sources.tables import corpus_from_table

# Folder and name of a document below its language: hidden, version-control and build folders, lockfiles and the like.
INNER_PATH = """concat_ws('/', source,
  case doc_id % 13 when 0 then 'target' when 1 then '.git' when 2 then '.github' when 3 then 'build/out'
    when 4 then 'logs' else null end,
  case doc_id % 17 when 0 then concat('pkg', doc_id, '/Cargo.lock') when 1 then concat('pkg', doc_id, '/dev.lock')
    when 2 then concat('pkg', doc_id, '/.env') when 3 then concat('pkg', doc_id, '/MYMETA.yml')
    when 4 then concat('pkg', doc_id, '/Makefile') when 5 then concat('pkg', doc_id, '/.env.local')
    else concat('doc_', doc_id, case doc_id % 7 when 0 then '.txt' when 1 then '.md' when 2 then '.rs'
      when 3 then '.log' when 4 then '.Rs' when 5 then '.tar.gz' else '.' end) end)"""
PATH = f"concat_ws('/', lang, {INNER_PATH})"
FLAT_PATH = f"case when doc_id % 5 = 0 then concat('top_', doc_id, '.txt') else {PATH} end"

# Values that a careless key would mix up, and one path for many documents beside paths below it.
ODD_ONE = "case doc_id % 6 when 0 then null when 1 then '' when 2 then chr(1) when 3 then concat(chr(1), chr(4)) when 4 then 'x' else source end"
ODD_TWO = "case doc_id % 5 when 0 then null when 1 then '' when 2 then 'x' else lang end"
COPIED_PATH = "case when doc_id % 2 = 0 then lang when doc_id % 3 = 0 then concat(lang, '/b') else concat(lang, '.c') end"

# The text with comments, literals, quotes, escapes, Windows line ends, blank lines and Unicode spaces worked in.
CODE = """concat('/* ', source, ' */ "// kept" ', case doc_id % 3
  when 0 then replace(text, ', ', concat(chr(39), ' // '))
  when 1 then replace(replace(text, '. ', concat('. // note "x"', chr(10), ' 　  ', chr(10))),
    ', ', concat(chr(9), ' ', chr(13), chr(10)))
  else replace(replace(text, '. ', concat('. /* a', chr(10), '*/* b **/ ', chr(13), chr(10), chr(13), chr(10),
    'https://x.y/z "//q', chr(92), '" /* in */" ')), ', ', concat(' / ', chr(10), chr(10))) end, chr(10))"""

# Bytes that are text or not for every reason the classifier knows.
MIXED_BYTES = """case doc_id % 10
  when 0 then concat(X'00', cast(text as binary)) when 1 then concat(cast(text as binary), X'FF')
  when 2 then cast(concat('%PDF-', text) as binary) when 3 then concat(X'EFBBBF', cast(text as binary), X'FF')
  when 4 then concat(cast(text as binary), X'00') else cast(text as binary) end"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt_out(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt out over them: the given tables are single files of a single row group."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores, "doc_id")


def documents(spark: SparkSession, sf_dir: str, path: str = PATH, content: str = "text",
              keep: tuple[str, ...] = ()) -> DataFrame:
    """The documents as a corpus; where their content is worked on, a small table is dealt out over the cores."""
    docs = table(spark, sf_dir, "documents")
    return corpus_from_table(_dealt_out(docs) if content != "text" else docs, F.expr(path), F.expr(content), keep)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = "concat(lpad(cast(turn as string), 19, '0'), '_', role, '.txt')"
    return corpus_from_table(table(spark, sf_dir, "conversations"), F.expr(path), "text", keep=("conv_id",))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{PAGE_URL} as url", f"{PAGE_HINT} as hint")


PAGE_URL = """case page_id % 8
  when 0 then concat('https://github.com/user', page_id % 7, '/repo', page_id % 11, '/tree/main/', substr(url, 9))
  when 1 then concat('https://github.com/user', page_id % 7, '/repo', page_id % 11, '.git/', substr(url, 9))
  when 2 then concat('https://github.com/user', page_id % 7, '/repo', page_id % 11, '/issues/', page_id)
  when 3 then concat('https://github.com/user', page_id % 7, '/repo', page_id % 11, '/blob/release/v', page_id % 3, '/src/a.rs/')
  when 4 then concat('git@github.com:user', page_id % 7, '/repo', page_id % 11, '.git')
  when 5 then concat('https://github.com/user', page_id % 7, '/repo', page_id % 11)
  when 6 then concat('/srv/', substr(url, 9))
  else url end"""
PAGE_HINT = "case when page_id % 2 = 1 then concat('release/v', page_id % 3) else null end"
