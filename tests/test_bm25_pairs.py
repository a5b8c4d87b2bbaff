"""BM25 of given pairs: the scores of the retriever, for the asked pairs alone."""

import random

from pyspark.sql import functions as F

from taintrank.operators import retrieval


def test_pairs_get_the_scores_of_the_retriever(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    docs = [(f"d{i}", " ".join(rng.choices(words, weights=range(30, 0, -1), k=rng.randrange(1, 25)))) for i in range(60)] + [("empty", ""), ("null", None)]
    queries = [(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(8)] + [("none", "zzz"), ("void", None)]
    d, q = spark.createDataFrame(docs, "docno string, text string"), spark.createDataFrame(queries, "qid string, query string")
    full = {(r.qid, r.docno): r.score for r in retrieval.bm25(q, d, budget=None).collect()}
    asked = [(a, b) for a, _ in queries for b, _ in docs if rng.random() < 0.4] + [("q1", "d1"), ("q1", "d1"), ("q1", "empty"), ("none", "d1"), ("void", "null"), ("q1", "gone")]
    got = retrieval.bm25_pairs(spark.createDataFrame(asked, "qid string, docno string").withColumn("score", F.lit(-1.0)), q, d).collect()
    assert {(r.qid, r.docno): r.score for r in got} == {p: full.get(p, 0.0) for p in asked} and len(got) == len(set(asked))
    nothing = retrieval.bm25_pairs(spark.createDataFrame([], "qid string, docno string"), q, d)
    assert nothing.count() == 0 and nothing.columns == ["qid", "docno", "score"]
    assert [r.score for r in retrieval.bm25_pairs(spark.createDataFrame([("q1", "d1")], "qid string, docno string"), q, d.limit(0)).collect()] == [0.0]
