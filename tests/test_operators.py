"""Schema checks, joins, reshape, sampling, ranking, scoring and plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from taintrank.functions import text as TX
from taintrank.functions import vectors as V
from taintrank.operators import joins, rank, reshape, retrieval, sampling, schema, scoring, setops


def test_required_columns_and_binary_relevance(spark):
    df = spark.createDataFrame([("q", "d", g) for g in (0, 1, 2, 3, 4)], "qid string, docno string, relevance int")
    with pytest.raises(ValueError, match="query_id"):
        schema.require_columns(df, ["qid", "query_id"])
    got = [r["relevance"] for r in schema.binarize_relevance(df).orderBy("docno").collect()]
    assert sorted(got, key=lambda x: (x is None, x)) == [0, 0, 1, 1, None]
    pos, neg = schema.split_labels(schema.binarize_relevance(df))
    assert pos.count() == 2 and neg.count() == 2


def test_clean_query_matches_python(spark):
    import re
    texts = ["Ça va, l'été! x_y 12", "naïve café — ok?", "tab\there nbsp"]
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    got = [r[0] for r in df.select(TX.clean_query("q")).collect()]
    assert got == [re.sub(r"[^\w\s]", "", t) for t in texts]


def test_truncation_and_duo(spark):
    df = spark.createDataFrame([(" ".join(str(i) for i in range(300)), "q")], "t string, q string")
    r = df.select(TX.truncate_tokens("t", 200).alias("x"), TX.duo_text("q", "q", "q").alias("d")).collect()[0]
    assert len(r["x"].split()) == 200 and r["d"] == "[CLS] q [SEP] q [SEP] q"


def test_strict_attach_raises_and_lenient_is_null(spark):
    run = spark.createDataFrame([("q", "a"), ("q", "zz")], "qid string, docno string")
    docs = spark.createDataFrame([("a", "text a")], "docno string, text string")
    lenient = {r["docno"]: r["text"] for r in joins.attach_text(run, docs).collect()}
    assert lenient == {"a": "text a", "zz": None}
    with pytest.raises(Exception, match="unknown docno"):
        joins.attach_text_strict(run, docs).collect()
    scored = joins.attach_scores(run, spark.createDataFrame([("q", "a", 2.0)], "qid string, docno string, score double"))
    assert {r["docno"]: r["teacher_score"] for r in scored.collect()} == {"a": 2.0, "zz": 0.0}


def test_merge_lookups_last_wins(spark):
    a = spark.createDataFrame([("1", "old"), ("2", "keep")], "id string, text string")
    b = spark.createDataFrame([("1", "new")], "id string, text string")
    assert dict(map(tuple, setops.merge_lookups([a, b]).collect())) == {"1": "new", "2": "keep"}


def test_pivots_and_pairs(spark):
    t = spark.createDataFrame([("q", "p", "n")], "query_id string, doc_id_a string, doc_id_b string")
    assert sorted(map(tuple, reshape.pivot_pairs(t).collect())) == [("q", "n", 0), ("q", "p", 1)]
    negs = spark.createDataFrame([("q", ["n1", "n2"])], "qid string, docnos array<string>")
    r = reshape.pivot_with_negatives(t, negs).orderBy("idx").collect()
    assert [(x["docno"], x["pos"]) for x in r] == [("p", 1), ("n1", None), ("n2", None)]
    with pytest.raises(Exception, match="no negatives"):
        reshape.pivot_with_negatives(t.withColumn("query_id", F.lit("other")), negs).collect()
    df = spark.createDataFrame([(["p", "n1", "n2"],), (["p"],)], "a array<string>")
    got = [r[0] for r in df.select(reshape.pos_pairs("a")).collect()]
    assert got == [[["p", "n1"], ["p", "n2"]], []]
    with pytest.raises(ValueError):
        reshape.group_rows(t, group_size=3)


def test_sampling_is_deterministic_and_clamped(spark):
    df = spark.range(50).selectExpr("CAST(id AS STRING) AS k")
    a = sorted(r["k"] for r in sampling.sample_n(df, 10, ["k"]).collect())
    b = sorted(r["k"] for r in sampling.sample_n(df.repartition(7), 10, ["k"]).collect())
    assert a == b and len(a) == 10
    assert sampling.sample_n(df, 500, ["k"]).count() == 50
    arr = spark.createDataFrame([(["a", "b", "c"],)], "x array<string>")
    assert len(arr.select(sampling.sample_array("x", 2)).collect()[0][0]) == 2
    with pytest.raises(Exception, match="Sample larger"):
        arr.select(sampling.sample_array("x", 4)).collect()


def test_large_sample_is_exact_and_stays_spread(spark):
    df = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k").repartition(8)
    got = sampling.sample_n(df, 7_000, ["k"], seed=3)
    want = df.orderBy(sampling.order_key(3, "k"), "k").limit(7_000)
    assert sorted(r["k"] for r in got.collect()) == sorted(r["k"] for r in want.collect())
    sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) >= 8 and max(r["count"] for r in sizes) < 3_000
    assert sampling.sample_n(df, 0, ["k"]).count() == 0


def test_long_samples_equal_list_samples(spark):
    pos = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "a"), ("s", "z")], "query_id string, doc_id_a string")
    neg = spark.createDataFrame([("q", str(i)) for i in range(40)] + [("r", "7")], "query_id string, doc_id_b string")
    lists = pos.join(neg.groupBy("query_id").agg(F.collect_list("doc_id_b").alias("x")), "query_id")
    salt = F.concat_ws(":", "query_id", "doc_id_a")
    want = {(r[0], r[1]): r[2] for r in lists.select("query_id", "doc_id_a", sampling.sample_array("x", 3, 42, salt, short="keep")).collect()}
    got = {}
    for r in sorted(sampling.sample_pairs(pos, neg, 3).collect(), key=lambda r: r["idx"]):
        got.setdefault((r["query_id"], r["doc_id_a"]), []).append(r["doc_id_b"])
    assert got == want
    assert "WindowGroupLimit" in sampling.sample_pairs(pos, neg, 3)._jdf.queryExecution().executedPlan().toString()


def test_pair_text_cuts_the_document_only(spark):
    words = lambda n, w: " ".join([w] * n)
    df = spark.createDataFrame([(words(50, "q"), words(300, "d")), (words(240, "q"), "d d"), (None, "d"), ("q", "")], "q string, t string")
    got = [r[0].split() for r in df.select(TX.pair_text("q", "t")).collect()]
    assert [(x.count("q"), x.count("d")) for x in got] == [(50, 180), (240, 0), (0, 1), (1, 0)]
    line = df.select(TX.duo_text("t", "t", "t").alias("x")).collect()[0]["x"]
    assert len(line.split()) == 512


def test_group_ids_do_not_depend_on_partitions(spark):
    from taintrank.operators import reshape
    t = spark.createDataFrame([("q", "a", "b"), ("q", "a", "b"), ("q", "c", "b")], "query_id string, doc_id_a string, doc_id_b string")
    ids = lambda df: sorted(r["gid"] for r in reshape.group_rows(df).collect())
    assert ids(t) == ids(t.repartition(5)) and len(set(ids(t))) == 3


def test_top_k_plans_window_group_limit(spark):
    run = spark.createDataFrame([("q", str(i), float(i % 5)) for i in range(50)], "qid string, docno string, score double")
    out = rank.top_k(run, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    rows = out.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [0, 1, 2] and [r["docno"] for r in rows] == ["14", "19", "24"]


def test_native_scorers_have_no_python(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "a array<double>, b array<double>")
    q = df.select(V.dot("a", "b").alias("d"), V.softmax("a").alias("s"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    r = q.collect()[0]
    assert r["d"] == 11.0 and sum(r["s"]) == pytest.approx(1.0)


def test_dense_block_path_equals_broadcast(spark):
    rng = np.random.default_rng(5)
    qv = spark.createDataFrame([(f"q{i}", rng.normal(size=8).tolist()) for i in range(7)], "qid string, vec array<double>")
    dv = spark.createDataFrame([(f"d{i}", rng.normal(size=8).tolist()) for i in range(300)], "docno string, vec array<double>")
    a = sorted(map(tuple, retrieval.dense_retrieve(qv, dv, k=5).collect()))
    b = sorted(map(tuple, retrieval.dense_retrieve(qv, dv, k=5, broadcast_bytes=100, doc_blocks=3).collect()))
    assert len(a) == 35 and [x[:2] + x[3:] for x in a] == [x[:2] + x[3:] for x in b]
    assert [x[2] for x in a] == pytest.approx([x[2] for x in b], abs=1e-9)
    # exact against numpy
    Q = np.array([r["vec"] for r in qv.orderBy("qid").collect()])
    D = np.array([r["vec"] for r in dv.collect()])
    names = [r["docno"] for r in dv.collect()]
    best = names[int(np.argmax(D @ Q[0]))]
    assert [x for x in a if x[0] == "q0" and x[3] == 0][0][1] == best


def test_cross_and_bi_rerank(spark):
    from taintrank.plans.rerank import rerank
    run = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "c", 2)], "qid string, docno string, rank int")
    queries = spark.createDataFrame([("q", "red apple")], "qid string, query string")
    docs = spark.createDataFrame([("a", "blue sky"), ("b", "red apple pie"), ("c", "apple")], "docno string, text string")
    r = rerank(run, queries, docs, factory=scoring.TokenOverlapScorer).orderBy("rank").collect()
    assert [x["docno"] for x in r] == ["b", "c", "a"]
    r2 = rerank(run, queries, docs, bi_factory=lambda: scoring.HashedBowEncoder(64)).orderBy("rank").collect()
    assert {x["docno"] for x in r2} == {"a", "b", "c"} and r2[0]["docno"] == "b"
    with pytest.raises(RuntimeError):
        scoring.bi_transform(spark.createDataFrame([("x",)], "other string"))
    with pytest.raises(ValueError):
        scoring.teacher_scores(scoring.TokenOverlapScorer)


def test_bm25_small(spark):
    q = spark.createDataFrame([("1", "apple pie")], "qid string, query string")
    d = spark.createDataFrame([("a", "apple pie apple"), ("b", "pie crust"), ("c", "nothing here")],
                              "docno string, text string")
    run = {r["docno"]: r["score"] for r in retrieval.bm25(q, d).collect()}
    assert set(run) == {"a", "b"}
    n, avgdl = 3, (3 + 2 + 2) / 3

    def w(tf, dl, df):
        return np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))
    assert run["a"] == pytest.approx(w(2, 3, 1) + w(1, 3, 2), abs=1e-9)
    assert run["b"] == pytest.approx(w(1, 2, 2), abs=1e-9)


def test_empty_inputs(spark):
    from taintrank.operators import losses, metrics
    empty_run = spark.createDataFrame([], "qid string, docno string, score double")
    qrels = spark.createDataFrame([("q1", "a", 1)], "qid string, docno string, relevance int")
    w = metrics.evaluate(empty_run, qrels).collect()
    assert w == []  # no run rows: no run name to report
    pq = metrics.per_query(empty_run, qrels).collect()
    assert pq == []
    qv = spark.createDataFrame([], "qid string, vec array<double>")
    dv = spark.createDataFrame([("d", [1.0])], "docno string, vec array<double>")
    assert retrieval.dense_retrieve(qv, dv).count() == 0
    g = spark.createDataFrame([], "pred array<double>, label array<double>")
    assert losses.loss(g, "mse").collect()[0]["loss"] is None
    assert rank.top_k(empty_run, 5).count() == 0
    enc = scoring.encode(spark.createDataFrame([], "text string"), lambda: scoring.HashedBowEncoder(8), "text", "v")
    assert enc.count() == 0


def test_null_text_scores_zero(spark):
    df = spark.createDataFrame([("q", None), (None, "t")], "query string, text string")
    out = scoring.score_pairs(df, scoring.TokenOverlapScorer).collect()
    assert [r["score"] for r in out] == [0.0, 0.0]


def test_scans_read_only_needed_columns(spark):
    from taintrank.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    plan = retrieval.bm25(fx.queries(spark, d), fx.docs(spark, d))._jdf.queryExecution().executedPlan().toString()
    plan += fx.qrels(spark, d)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.split("\n") if "FileScan parquet" in ln or "ReadSchema" in ln]
    assert scans
    for ln in scans:
        for unused in ("lang", "source", "n_chars"):
            assert unused not in ln, ln


def test_bm25_and_kl_repartition_invariant(spark):
    from taintrank.operators import compare
    from taintrank.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    q, docs = fx.queries(spark, d), fx.docs(spark, d)
    base = sorted(map(tuple, retrieval.bm25(q, docs, budget=10).collect()))
    for n in (1, 7, 50):
        again = sorted(map(tuple, retrieval.bm25(q.repartition(n), docs.repartition(n), budget=10).collect()))
        assert again == base
    s = spark.createDataFrame([(f"q{i % 5}", f"d{i}", float(i % 7) - 2.5) for i in range(200)],
                              "qid string, docno string, score double")
    t = s.withColumn("score", F.col("score") * 0.5 + 3.0)
    k0 = compare.kl_divergence(s, t).collect()[0]["kl"]
    for n in (1, 7, 50):
        assert compare.kl_divergence(s.repartition(n), t.repartition(n)).collect()[0]["kl"] == pytest.approx(k0, rel=1e-12)


def test_group_rows_sizes(spark):
    t = spark.createDataFrame([("q", "p", ["n1", "n2", "n3"])], "query_id string, doc_id_a string, doc_id_b array<string>")
    sizes = {g: reshape.group_rows(t, group_size=g).collect()[0]["docnos"] for g in (1, 2, 3, 4)}
    assert sizes[1] == ["p"] and len(sizes[2]) == 2 and len(sizes[3]) == 3 and len(sizes[4]) == 4
    assert sizes[2][0] == "p" and set(sizes[4][1:]) == {"n1", "n2", "n3"}
    lw = reshape.group_rows(t, group_size=3, include_positive=False).collect()[0]["docnos"]
    assert len(lw) == 2 and "p" not in lw
