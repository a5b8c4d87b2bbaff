"""Texts sent once, query blocks, hot documents, unknown ids."""

import pytest
from pyspark.sql import functions as F

from taintrank.operators import scoring
from taintrank.plans import rerank

QUERIES = [(f"q{i}", f"word{i % 7} other{i % 3}") for i in range(40)] + [("empty", None)]
DOCS = [(f"d{i}", " ".join(f"word{j}" for j in range(i % 9)) + " other1") for i in range(30)] + [("none", None)]


@pytest.fixture(scope="module")
def tables(spark):
    q = spark.createDataFrame(QUERIES, "qid string, query string")
    d = spark.createDataFrame(DOCS, "docno string, text string")
    pairs = [(a, b, i) for i, (a, b) in enumerate((a, b) for a, _ in QUERIES for b, _ in DOCS if (len(a) + len(b)) % 3 or b == "d1")]
    return q, d, spark.createDataFrame(pairs, "qid string, docno string, first_rank int"), pairs


@pytest.mark.parametrize("query_bytes,members", [(1 << 20, 4096), (1 << 20, 8), (300, 4096), (300, 8)])
def test_same_rows_as_pair_by_pair(tables, query_bytes, members):
    q, d, df, pairs = tables
    queries, docs = dict(QUERIES), dict(DOCS)
    got = scoring.score_by_document(df, q, d, scoring.TokenOverlapScorer, query_bytes=query_bytes, members=members)
    assert got.columns == ["qid", "docno", "first_rank", "score"]
    want = {(a, b, i): float(len(set((queries[a] or "").split()) & set((docs[b] or "").split()))) for a, b, i in pairs}
    assert {tuple(r)[:3]: r.score for r in got.collect()} == want


def test_a_text_crosses_once(tables):
    q, d, df, pairs = tables
    plan = scoring.score_by_document(df, q, d, scoring.TokenOverlapScorer)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan and plan.index("MapInPandas") < plan.index("collect_list")   # pairs are grouped below the scorer

    def counting():
        return lambda queries, texts: [len(texts)] * len(texts)
    got = scoring.score_by_document(df, q, d, counting, batch_size=10_000).agg(F.max("score")).first()[0]
    assert got >= 100                                  # batches go over document borders


def test_unknown_ids(spark, tables):
    q, d, df, _ = tables
    for row in (("nobody", "d1", 0), ("q1", "nothing", 0)):
        odd = spark.createDataFrame([row], df.schema)
        for query_bytes in (1 << 20, 300):
            with pytest.raises(Exception, match="unknown"):
                scoring.score_by_document(odd, q, d, scoring.TokenOverlapScorer, query_bytes=query_bytes).collect()
            assert scoring.score_by_document(odd, q, d, scoring.TokenOverlapScorer, strict=False, query_bytes=query_bytes).first().score == 0
    assert scoring.score_by_document(df.limit(0), q, d, scoring.TokenOverlapScorer).count() == 0


def test_logits_and_rerank(tables):
    q, d, df, pairs = tables
    got = scoring.score_by_document(df, q, d, scoring.OverlapLogitsScorer, logits=True, out="logits").collect()
    assert len(got) == len(pairs) and all(list(r.logits) == [-r.logits[1], r.logits[1]] for r in got)
    ranked = rerank.rerank(df.withColumnRenamed("first_rank", "rank"), q, d, factory=scoring.TokenOverlapScorer)
    assert ranked.count() == len(pairs) and ranked.columns == ["qid", "docno", "score", "rank"]


def test_modes_of_the_bi_encoder(spark):
    """Each of the six column sets; (text) needs no docno, and two texts under one id get two vectors."""
    def encoder():
        return scoring.HashedBowEncoder(8)
    rows = [("1", "a b", "d", "a b"), ("1", "a b", "d", "c c c"), ("2", "c", "e", "")]
    full = spark.createDataFrame(rows, "qid string, query string, docno string, text string")
    both = scoring.encode_docs(scoring.encode_queries(full, encoder), encoder)
    want = sorted((r.qid, r.text, sum(x * y for x, y in zip(r.query_vec, r.doc_vec))) for r in both.collect())
    assert want == [("1", "a b", 2.0), ("1", "c c c", 0.0), ("2", "", 0.0)]
    for columns in (["qid", "query", "docno", "text"], ["qid", "query_vec", "docno", "text"], ["qid", "query", "docno", "doc_vec"],
                    ["qid", "query_vec", "docno", "doc_vec"]):
        got = scoring.bi_transform(both.select(*columns), encoder)
        assert sorted(r.score for r in got.collect()) == sorted(w[2] for w in want) and "rank" in got.columns
    assert [len(r.query_vec) for r in scoring.bi_transform(full.select("query"), encoder).collect()] == [8] * 3
    texts = {r.text: list(r.doc_vec) for r in scoring.bi_transform(full.select("text"), encoder).collect()}
    assert set(texts) == {"a b", "c c c", ""} and sum(texts["c c c"]) == 3 and sum(texts[""]) == 0
    with pytest.raises(RuntimeError):
        scoring.bi_transform(full.select("docno"), encoder)
