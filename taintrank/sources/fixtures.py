"""The driver's tables and the ranking fixtures derived from them.

Every fixture is a lazy DataFrame over the whole given table; nothing is
collected. ``N`` (number of benchmark queries) enters as a scalar subquery,
so the plans stay declarative.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, sampling
from ..operators.schema import binarize_relevance

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def n_queries(spark: SparkSession, sf_dir: str) -> Column:
    """N = rows of ``benchmark`` as a scalar subquery column."""
    return table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qid, query`` (the whole benchmark text is the query)."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docno, text``."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("docno"), "text")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graded judgements ``qid, docno, relevance`` (0..3)."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        (F.col("doc_id") % n_queries(spark, sf_dir)).cast("string").alias("qid"),
        F.col("doc_id").cast("string").alias("docno"),
        (F.col("quality") * 2 + (1 - F.col("toxic"))).cast("int").alias("relevance"))


def vectors(spark: SparkSession, sf_dir: str, dims: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(query vectors ``qid, vec``, doc vectors ``docno, vec``).

    ``dims`` keeps the first ``dims`` components (the student's view, F5).
    """
    emb = table(spark, sf_dir, "embeddings")
    vec = F.col("embedding") if dims is None else F.slice("embedding", 1, dims)
    n = n_queries(spark, sf_dir)
    q = emb.where(F.col("vec_id") < n).select(
        F.col("vec_id").cast("string").alias("qid"), vec.alias("vec"))
    d = emb.where(F.col("vec_id") >= n).select(
        F.col("vec_id").cast("string").alias("docno"), vec.alias("vec"))
    return q, d


def vector_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4 judgements: F3 restricted (semi-join) to docs that have a vector."""
    _, d = vectors(spark, sf_dir)
    return qrels(spark, sf_dir).join(d.select("docno"), "docno", "left_semi")


def triples(spark: SparkSession, sf_dir: str, seed: int = 42) -> DataFrame:
    """positives x one md5-chosen negative per query, with ``origin``.

    ``origin`` is ``clean`` for even doc ids (the training queries) and
    ``leaked`` for odd ones (the test queries whose judgements leak).
    """
    from ..plans.contaminate import qrels_to_triples
    t = qrels_to_triples(qrels(spark, sf_dir), seed=seed)
    return t.withColumn("origin", F.when(F.col("doc_id_a").cast("long") % 2 == 0, F.lit("clean"))
                        .otherwise(F.lit("leaked")))


def positives_and_negatives(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """F7 as long rows: ``query_id, doc_id_a`` of the positives, ``query_id, doc_id_b`` of the negatives."""
    b = binarize_relevance(qrels(spark, sf_dir))
    pick = lambda grade, name: b.where(F.col("relevance") == grade).select(
        F.col("qid").alias("query_id"), F.col("docno").alias(name))
    return pick(1, "doc_id_a"), pick(0, "doc_id_b")


def multi_negative_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """per query, every positive with the sorted list of all negatives.

    Positives are few bytes and their lists many, so they are dealt by the negatives that they meet; the lists, once a query, are
    sent to them where they are small.
    """
    b = binarize_relevance(qrels(spark, sf_dir))
    pos = b.where(F.col("relevance") == 1).select(
        F.col("qid").alias("query_id"), F.col("docno").alias("doc_id_a"))
    rows = b.where(F.col("relevance") == 0).select(F.col("qid").alias("query_id"), "docno")
    neg = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("docno")).alias("doc_id_b"))
    if joins.measured_bytes(rows) > joins.BROADCAST_MAX_BYTES:
        return pos.join(neg, "query_id", "inner")
    parts = joins.parts_for(pos, rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "query_id")
    return pos.repartition(parts, "query_id", "doc_id_a").join(F.broadcast(neg), "query_id", "inner")


def event_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 run: ``qid=user_id, docno=event_id, score=value``."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("qid"),
        F.col("event_id").cast("string").alias("docno"),
        F.col("value").cast("double").alias("score"))


def event_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8 judgements: every third event is judged with grade ``event_id % 4``."""
    ev = table(spark, sf_dir, "events")
    return ev.where(F.col("event_id") % 3 == 0).select(
        F.col("user_id").cast("string").alias("qid"),
        F.col("event_id").cast("string").alias("docno"),
        (F.col("event_id") % 4).cast("int").alias("relevance"))


def score_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled score sample ``model_type, score`` from lineitem."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_linestatus").alias("model_type"),
        F.col("l_extendedprice").cast("double").alias("score"))


def user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """all turns of ``conversations`` as query texts to clean."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("query"))


def lookup_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """two collections in one id space, in priority order (last wins)."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "text")
    p = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    return [d, p]


__all__ = ["table", "queries", "docs", "qrels", "vectors", "vector_qrels", "triples",
           "multi_negative_triples", "positives_and_negatives", "event_run", "event_qrels", "score_sample", "user_texts",
           "lookup_sources", "n_queries", "sampling"]
