"""A corpus pipeline of five of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read back as
the docs of the next. The last one returns a row per document of the mix with the digests of its
encoding; the others return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taintrank.llm import bpe, mixing, neardup, pii, queries, rules
from taintrank.session import Scratch, prepare


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rules keep."""
    prepare(spark)
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    prepare(spark)
    return neardup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts (and n_chars counted anew)."""
    prepare(spark)
    out = pii.redact(docs, pii.train(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a document stands as often as it is taken."""
    prepare(spark)
    return mixing.mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of the mix."""
    prepare(spark)
    return bpe.digests(bpe.encode(docs, queries.tokenizer_path()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("encoding", encoding),
]

# robust estimates, trained trees and keyed draws have no SQL twin; tests compare the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    tmp = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tmp.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
