"""Triples and collections on disk.

A gzip TSV cannot be split: one file is one task. ``read_triples``
therefore repartitions by query right after the scan when asked to, so
later per-query work runs in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import pivot_pairs
from ..operators.schema import require_columns

TRIPLES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                               ("query_id", "doc_id_a", "doc_id_b")])
QUERIES_SCHEMA = "query_id string, text string"
DOCS_SCHEMA = "doc_id string, text string"
QRELS_SCHEMA = "query_id string, doc_id string, relevance int, iteration string"


def read_triples(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Tab-separated triples with a header (gzip by extension); ids are strings."""
    df = spark.read.csv(path, sep="\t", header=True, schema=TRIPLES_SCHEMA, enforceSchema=False)
    require_columns(df, TRIPLES_SCHEMA.fieldNames(), "triples")
    if partitions:
        df = df.repartition(partitions, "query_id")
    return df


def write_triples(df: DataFrame, path: str, compression: str | None = "gzip",
                  mode: str = "overwrite") -> None:
    """Header, tab-separated, gzip by default; multi-negative lists are joined by ','."""
    cols = []
    for c in ("query_id", "doc_id_a", "doc_id_b"):
        f = df.schema[c].dataType
        cols.append(F.array_join(c, ",").alias(c) if isinstance(f, T.ArrayType) else F.col(c).cast("string"))
    w = df.select(*cols).write.mode(mode).option("sep", "\t").option("header", True)
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


def read_collection(spark: SparkSession, docs: str | None = None, queries: str | None = None,
                    qrels: str | None = None, docpairs: str | None = None,
                    fmt: str = "parquet") -> dict[str, DataFrame]:
    """S3: the four collection parts from local tables, in run vocabulary.

    ``docs -> (docno, text)``, ``queries -> (qid, query)``,
    ``qrels -> (qid, docno, relevance)``, ``docpairs -> (query_id, doc_id_a, doc_id_b)``.
    """
    def load(path: str, schema: str) -> DataFrame:
        r = spark.read.format(fmt)
        if fmt == "csv":
            r = r.option("sep", "\t").option("header", True).schema(schema)
        return r.load(path)

    out: dict[str, DataFrame] = {}
    if docs:
        d = load(docs, DOCS_SCHEMA)
        out["docs"] = d.select(F.col("doc_id").cast("string").alias("docno"), "text")
    if queries:
        q = load(queries, QUERIES_SCHEMA)
        out["queries"] = q.select(F.col("query_id").cast("string").alias("qid"), F.col("text").alias("query"))
    if qrels:
        r = load(qrels, QRELS_SCHEMA)
        out["qrels"] = r.select(F.col("query_id").cast("string").alias("qid"),
                                F.col("doc_id").cast("string").alias("docno"),
                                F.col("relevance").cast("int").alias("relevance"))
    if docpairs:
        p = load(docpairs, "query_id string, doc_id_a string, doc_id_b string")
        out["docpairs"] = p.select(*[F.col(c).cast("string") for c in TRIPLES_SCHEMA.fieldNames()])
    return out


def initialise_pairs(docpairs: DataFrame) -> DataFrame:
    """Docpairs -> pivoted pairs (R1); training uses the triples themselves."""
    return pivot_pairs(docpairs)
