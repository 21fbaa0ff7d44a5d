"""The corpus pipeline: documents pass through the stages in order, each a table in the shared folder.

Every stage works on all rows that its predecessor kept and returns the columns of ``documents``, further ones included;
the last returns the packed pieces.  Repeated rows are judged one by one but for near_dedup, which keeps one; very long
texts pass whole; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm import common, decontam, neardup, packing, pii, rules
from reelquery.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go; so do null and empty texts, which fail the base rule."""
    return rules.filter_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (similarity 0.8 or more) stays: the one with the smallest doc_id.

    Empty texts and null ids are in no group and stay; of rows that repeat an id in a group one stays.
    """
    return neardup.deduplicate(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its shingles or more) go; null and empty texts hold none and stay."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the new text (null where that is null); every row stays."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of every row; a null or empty text is its end id alone."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", redact_pii),
    ("harmonic_packing", harmonic_packing),
]

#: Stages learn thresholds and models, and cut texts by a tokenizer, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; the result is the last stage's, lazily."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = common.materialize(docs, f"stage-{name}")
    return docs
