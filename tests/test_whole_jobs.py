"""Queries that must do their whole job, on tables made here."""

import random

import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """A small folder of tables: 4 queries, 12 documents, vectors, judgements and events."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("benchmark", [(i, f"w{i} common words") for i in range(4)], "item_id long, text string")
    write("documents", [(i, f"w{i % 4} common text {i}") for i in range(12)], "doc_id long, text string")
    write("labels", [(i, i // 4 % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    write("embeddings", [(i, [float(i % 3), 1.0, float(i)]) for i in range(12)], "vec_id long, embedding array<double>")
    write("events", [(i, i % 2, float(i)) for i in range(20)], "event_id long, user_id long, value double")
    return str(tmp_path)


def test_g7_judges_the_dense_run(spark, tables):
    from taintrank.plans.coverage import g7_missing_queries
    from taintrank.plans.registry import dense_run
    rows = {(r["name"], r["qid"]): r for r in g7_missing_queries(spark, tables).collect()}
    assert set(rows) == {(n, str(q)) for n in ("dense", "half", "events") for q in range(4)}
    assert {r.qid for r in dense_run(spark, tables).collect()} == {"0", "1", "2", "3"}
    assert all(rows["dense", str(q)].r_at_100 == 1.0 for q in range(4))
    assert [rows["half", str(q)].r_at_100 for q in range(4)] == [1.0, 0.0, 1.0, 0.0]
    assert rows["events", "2"].ap == rows["events", "3"].ap == 0.0 < rows["events", "0"].ap


def test_g7_with_null_vectors(spark, tables):
    from taintrank.plans.coverage import g7_missing_queries
    rows = [(0, None), (1, [1.0, None, 0.0]), (2, [1.0, 1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), *[(i, [1.0, 2.0, 3.0]) for i in range(5, 12)]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.mode("overwrite").parquet(f"{tables}/embeddings.parquet")
    found = {(r["name"], r["qid"]): r.r_at_100 for r in g7_missing_queries(spark, tables).collect()}
    assert found["dense", "0"] == found["dense", "1"] == 0.0 and found["dense", "2"] == found["dense", "3"] == 1.0


def _lines(rows):
    return sorted(map(tuple, rows), key=repr)


def test_bm25_holds_no_pairs(spark):
    """Top-k rows equal those of all sums, with null and repeated ids, copies that tie, and many documents in one tile or few."""
    from taintrank.operators import rank, retrieval
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(400)]
    rows = [(f"d{i}", t) for i, t in enumerate(texts)] + [(f"c{i}", texts[0]) for i in range(80)] + [("d3", "w1 w2"), ("d3", "w1 w2"), (None, texts[1]), (None, "w7")]
    docs = spark.createDataFrame(rows, "docno string, text string")
    queries = spark.createDataFrame([("a", texts[0]), ("b", "w1 w2 w2"), (None, "w7 w8"), ("c", "w3"), ("none", "x"), ("empty", None)], "qid string, query string")
    for budget in (7, 60, 1000):
        want = rank.top_k(retrieval.bm25(queries, docs, budget=None), budget)
        for run in (retrieval.bm25, retrieval.bm25_maxscore):
            got = run(queries, docs, budget=budget)
            assert _lines(got.select("qid", "docno", "score", "rank").collect()) == _lines(want.select("qid", "docno", "score", "rank").collect())


def test_bm25_sums_are_bounded_by_tiles(spark):
    """Whatever the number of documents, a task holds a tile and the best k of each query."""
    import numpy as np
    import pyarrow as pa

    from taintrank.operators.retrieval import _Tiles
    one = np.array([0, 1]), np.array([0]), np.array([1.0])
    none = np.array([0, 0]), np.zeros(0, np.int64), np.zeros(0)
    t = _Tiles(["q"], pa.array(["w"]), one, none, np.zeros(1), np.zeros(1), 3, 8 * 50)
    t.limit = 20
    for part in range(30):
        n = 200
        t.add(pa.array([f"{part}-{i}" for i in range(n)]), pa.array(["w"] * n), np.arange(1, n + 1) + 1000.0 * part)
        assert len(t.q) <= 40
    t.cut()
    assert sorted(t.d) == ["29-197", "29-198", "29-199"]


def test_samples_make_no_row_per_pair(spark):
    """The choice of all pairs' keys, with null and repeated ids and more negatives than one list holds."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from taintrank.operators import sampling
    pos = spark.createDataFrame([("q", f"p{i % 20}") for i in range(25)] + [("q", None), ("r", "a"), ("s", "none"), (None, "x")], "query_id string, doc_id_a string")
    neg = spark.createDataFrame([("q", f"n{i % 1100}") for i in range(1300)] + [("q", None), ("r", "b"), (None, "y"), ("t", "z")], "query_id string, doc_id_b string")
    pairs = pos.distinct().join(neg, "query_id")
    w = Window.partitionBy("query_id", "doc_id_a").orderBy(sampling.order_key(42, "query_id", "doc_id_a", "doc_id_b"), "doc_id_b")
    for k in (1, 3):
        want = pairs.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= k)
        got = sampling.sample_pairs(pos, neg, k)
        assert got.columns == want.columns and _lines(got.collect()) == _lines(want.collect())
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_list" in plan and "WindowGroupLimit" in plan


def test_r10_is_dealt_by_its_pairs(spark, tmp_path):
    """One small file of labels makes many pairs: more than one task makes them."""
    from pyspark.sql import functions as F

    from taintrank.operators import joins, reshape
    from taintrank.plans.registry import r10_pos_pairs
    spark.createDataFrame([(0, "x"), (1, "y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, i // 2 % 2, 0) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    found = r10_pos_pairs(spark, str(tmp_path))
    assert found.count() == found.distinct().count() == 2 * 50 * 50
    assert len(found.select(F.spark_partition_id().alias("p")).distinct().collect()) > 1
    made = spark.createDataFrame([("p", ["n", "m"]), ("p", []), (None, ["n"]), ("p", None)], "a string, b array<string>").select(
        reshape.pos_pairs(F.concat(F.array("a"), "b")).alias("x"))
    assert [r.x for r in made.collect()] == [[["p", "n"], ["p", "m"]], [], [[None, "n"]], None]
    made = spark.range(3).select(reshape.pos_pairs(F.concat(F.array(F.col("id")), F.sequence(F.col("id"), F.lit(9)))).alias("x"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sequence(") == 1
    left = spark.createDataFrame([("a",)] * 30 + [("b",)], "k string")
    sizes = spark.createDataFrame([("a", 100), ("b", 1)], "k string, _n long")
    assert joins.parts_for(left, sizes, "k", 10) == 301


def test_k13_scores_a_pair_once(spark):
    import numpy as np

    from taintrank.operators import scoring

    class Counter:
        """Every scored row gets another number."""

        def __init__(self):
            self.n = 0

        def __call__(self, queries, texts):
            self.n += len(texts)
            return np.arange(self.n - len(texts), self.n, dtype=np.float64)

    triples = spark.createDataFrame([("q", f"p{i % 30}", "x") for i in range(40)], "query_id string, doc_id_a string, doc_id_b string")
    negatives = spark.createDataFrame([("q", ["n1", "n2", "n2"])], "qid string, docnos array<string>")
    queries = spark.createDataFrame([("q", "w")], "qid string, query string")
    docs = spark.createDataFrame([("n1", "a"), ("n2", "b"), ("p0", "c")], "docno string, text string")
    rows = scoring.teacher_scores(Counter, pairs=triples, negatives=negatives, queries=queries, docs=docs).collect()
    found = {}
    for r in rows:
        found.setdefault(r.docno, []).append((r.qid, r.query, r.text, r.score))
    assert len(found["n1"]) == 40 and len(found["n2"]) == 80 and len(found["p0"]) == 2 and len(rows) == 160
    assert all(len(set(v)) == 1 for v in found.values())
