"""A training-data pipeline: documents in, packed sequences out. Each stage calls one operator of `folioloom.llm`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.llm import quality
from folioloom.llm.decontaminate import decontaminated
from folioloom.llm.language import held_out
from folioloom.llm.line_chunks import without_repeated_passages
from folioloom.llm.packing import pack
from folioloom.llm.simhash import one_per_group
from folioloom.llm.tokens import word_bpe_path
from folioloom.operators.skew import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labels that are not held out, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.learn(docs, labels.where(~held_out(F.col("doc_id")))))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the multi-line passages that an earlier document has."""
    return without_repeated_passages(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints link: three-word shingles, three differing bits at most."""
    return one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens."""
    return pack(docs, word_bpe_path(), 1)


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("SimHash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", decontamination), ("packing", packing)]

#: SQL cannot express boosted tables, SimHash or the tokenizer; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
