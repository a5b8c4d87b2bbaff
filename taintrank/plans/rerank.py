"""E1 re-ranking and score generation.

Shuffles: the run is grouped by document and joined to the texts, so a text moves and is
sent to Python once however many queries ask for it; scores are ranked with one window on qid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import joins, reshape, scoring
from ..operators.rank import add_ranks
from ..session import cut_lineage


def rerank(run: DataFrame, queries: DataFrame, docs: DataFrame, factory: Callable | None = None,
           bi_factory: Callable | None = None, text_field: str = "text",
           batch_size: int = scoring.DEFAULT_BATCH) -> DataFrame:
    """Run -> attach query (strict) -> attach text (strict, J4/J5) -> score -> rank.

    Exactly the (qid, docno) set of the input run comes out; ties keep the
    first-stage order (``first_rank``).
    """
    if (factory is None) == (bi_factory is None):
        raise ValueError("give exactly one of factory (cross) or bi_factory (bi-encoder)")
    cols = ["qid", "docno"] + ([F.col("rank").alias("first_rank")] if "rank" in run.columns else [])
    r = run.select(*cols)
    if factory is not None:
        scored = scoring.score_by_document(r, queries, docs, factory, batch_size=batch_size, text_field=text_field)
    else:
        # the candidates are written once; every distinct query and document is encoded once, from its own table
        r = cut_lineage(r, "candidates")
        qv = scoring.encode(joins.used_only(queries.select("qid", "query"), r, "qid"), bi_factory, "query", "query_vec", batch_size)
        d = docs.select("docno", F.col(text_field).alias("text"))
        dv = scoring.encode(joins.used_only(d, r, "docno"), bi_factory, "text", "doc_vec", batch_size)
        r = joins.attach_text_strict(r, qv, key="qid", text_field="query_vec")
        r = joins.attach_text_strict(r, dv, key="docno", text_field="doc_vec")
        scored = r.withColumn("score", V.dot("query_vec", "doc_vec")).drop("query_vec", "doc_vec")
    return add_ranks(scored).select("qid", "docno", "score", "rank")


def generate_scores(triples: DataFrame, queries: DataFrame, docs: DataFrame, factory: Callable,
                    batch_size: int = scoring.DEFAULT_BATCH) -> DataFrame:
    """Triples -> pairs (R1) -> lenient texts (J3) -> cross scores (K2).

    Returns the long ``(qid, docno, score)`` table; write it with
    ``sources.jsonio.write_score_map`` (R4 + S10).
    """
    pairs = reshape.pivot_pairs(triples).select("qid", "docno").distinct()
    return scoring.score_by_document(pairs, queries, docs, factory, batch_size=batch_size, strict=False)


def generate_bi_scores(triples: DataFrame, queries: DataFrame, docs: DataFrame, factory: Callable,
                       batch_size: int = scoring.DEFAULT_BATCH) -> DataFrame:
    """Pairs (R1) -> only used queries/docs (J9) -> encode each once (K4/K5)
    -> vectors by id (J8, missing side dropped) -> native dot (K7)."""
    pairs = reshape.pivot_pairs(triples).select("qid", "docno").distinct()
    q = joins.used_only(queries, pairs, "qid")
    d = joins.used_only(docs, pairs, "docno")
    qv = scoring.encode(q, factory, "query", "vec", batch_size).select("qid", "vec")
    dv = scoring.encode(d, factory, "text", "vec", batch_size).select("docno", "vec")
    return vector_scores(pairs, qv, dv)


def vector_scores(pairs: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    """J8 + K7: dot product of the pair's vectors (pairs without both dropped)."""
    j = joins.attach_vectors(pairs, query_vecs, doc_vecs)
    return j.select("qid", "docno", V.dot("query_vec", "doc_vec").alias("score"))
