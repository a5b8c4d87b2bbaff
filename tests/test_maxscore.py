"""K1 with pruning: equal to the exhaustive sums to the last digit, from fewer contributions."""

import random

import pytest
from pyspark.sql import functions as F

from taintrank.operators import retrieval


def corpus(spark, n, seed):
    """Zipf-like words, copies of documents, empty and null texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    share = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(words, share, k=rng.randrange(1, 60))) for _ in range(n)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)] + [(f"c{i}", texts[0]) for i in range(5)] + [("e", ""), ("n", None)]
    return spark.createDataFrame(rows, "docno string, text string"), rng, words


@pytest.mark.parametrize("length,budget", [(3, 5), (3, 20), (40, 10), (2, 5000)])
def test_equal_to_all_sums(spark, length, budget):
    docs, rng, words = corpus(spark, 1500, length)
    rows = [(str(q), " ".join(rng.choices(words[:200], k=length))) for q in range(12)]
    rows += [("none", "unknown words"), ("empty", ""), ("null", None), ("twice", "w0 w0 w399 w399"), ("common", "w0 w1")]
    queries = spark.createDataFrame(rows, "qid string, query string")
    got = retrieval.bm25_maxscore(queries, docs, budget=budget)
    want = retrieval.bm25(queries, docs, budget=budget)
    assert sorted(map(tuple, got.select("qid", "docno", "score", "rank").collect())) == sorted(map(tuple, want.select("qid", "docno", "score", "rank").collect()))


def test_fewer_contributions(spark):
    docs, rng, words = corpus(spark, 4000, 3)
    rows = [(str(q), f"{rng.choice(words[150:])} {rng.choice(words[60:150])} w0 w1 w2") for q in range(15)]
    m = retrieval.MaxScore(spark.createDataFrame(rows, "qid string, query string"), docs, budget=10)
    assert m.run().count() == 150
    work = m.work()
    assert work["summed"] < 0.5 * work["all"], work


def test_every_document_once_on_shuffled_input(spark):
    docs, rng, words = corpus(spark, 300, 8)
    queries = spark.createDataFrame([("1", "w0 w5 w40"), ("2", "w1 w77")], "qid string, query string")
    a, b = (retrieval.bm25_maxscore(queries, d, budget=30).collect() for d in (docs, docs.repartition(9).orderBy(F.rand(3))))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 60
