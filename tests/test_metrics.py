"""Hand-worked ranking metrics (M1-M7) on the FIXTURES.md pytest example."""

import math

import pytest
from pyspark.sql import functions as F

from taintrank.operators import metrics


@pytest.fixture
def qrels(spark):
    rows = [("q1", "a", 3), ("q1", "b", 0), ("q1", "c", 1), ("q2", "d", 2), ("q3", "e", 0)]
    return spark.createDataFrame(rows, "qid string, docno string, relevance int")


@pytest.fixture
def run(spark):
    rows = [("q1", "c", 2.0), ("q1", "a", 1.0), ("q1", "x", 1.0), ("q9", "a", 1.0)]
    return spark.createDataFrame(rows, "qid string, docno string, score double")


def test_per_query_q1(run, qrels):
    pq = {r["qid"]: r.asDict() for r in metrics.per_query(run, qrels).collect()}
    assert set(pq) == {"q1", "q2", "q3"}  # q9 unjudged -> ignored; q2/q3 are missing from the run -> zeros
    assert all(v == 0.0 for q in ("q2", "q3") for k, v in pq[q].items() if k not in ("name", "qid"))
    q1 = pq["q1"]
    # order: c (1), x (unjudged, docno desc beats a on the tie), a (3)
    assert q1["ap"] == pytest.approx((1 + 2 / 3) / 2)
    idcg10 = 3 + 1 / math.log2(3)
    assert q1["ndcg_at_10"] == pytest.approx(2.5 / idcg10)
    assert q1["ndcg_at_5"] == pytest.approx(2.5 / idcg10)
    assert q1["ndcg_at_1"] == pytest.approx(1 / 3)
    assert q1["p_at_10"] == pytest.approx(0.2)
    assert q1["rr"] == 1.0 and q1["rr_at_10"] == 1.0
    assert q1["r_at_100"] == 1.0 and q1["r_at_1000"] == 1.0


def test_mean_over_judged_queries(run, qrels):
    w = metrics.evaluate(run, qrels).collect()[0].asDict()
    assert w["name"] == "run"
    assert w["ap"] == pytest.approx((1 + 2 / 3) / 2 / 3)
    assert w["rr"] == pytest.approx(1 / 3)
    assert w["p_at_10"] == pytest.approx(0.2 / 3)


def test_rel_threshold_and_parse(run, qrels):
    m = metrics.parse_measure("R(rel=2)@100")
    assert (m.name, m.rel, m.cutoff) == ("R", 2, 100)
    assert m.label == "R(rel=2)@100" and m.column == "r_rel2_at_100"
    pq = metrics.per_query(run, qrels, ["R(rel=2)@100", "AP(rel=2)", "P(rel=2)@2"]).where("qid = 'q1'").collect()[0]
    assert pq["r_rel2_at_100"] == 1.0            # only a is relevant at rel=2
    assert pq["ap_rel2"] == pytest.approx(1 / 3)  # a at position 3
    assert pq["p_rel2_at_2"] == 0.0
    for bad in ("MAP", "nDCG(rel=2)@10", "P@0", "AP(rel=x)"):
        with pytest.raises(ValueError):
            metrics.parse_measure(bad)


def test_many_runs_one_plan_and_long_form(run, qrels):
    runs = run.withColumn("name", F.lit("a")).unionByName(
        run.withColumn("name", F.lit("b")).withColumn("score", -F.col("score")))
    w = {r["name"]: r for r in metrics.evaluate(runs, qrels).collect()}
    assert set(w) == {"a", "b"}
    assert w["a"]["ap"] != w["b"]["ap"]
    long = metrics.to_long(metrics.per_query(runs, qrels)).collect()
    assert {r["metric"] for r in long} >= {"AP(rel=1)", "nDCG@10", "RR(rel=1)@10"}
    labels = metrics.with_measure_labels(metrics.evaluate(runs, qrels)).columns
    assert labels[0] == "AP(rel=1)" and labels[-1] == "name"


def test_repartition_invariance(spark, run, qrels):
    base = sorted(metrics.evaluate(run, qrels).collect()[0].asDict().items())
    for n in (1, 7, 200):
        again = metrics.evaluate(run.repartition(n), qrels.repartition(n)).collect()[0].asDict()
        assert sorted(again.items()) == base


def test_metric_bounds_on_events(spark):
    from taintrank.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    w = metrics.evaluate(fx.event_run(spark, d), fx.event_qrels(spark, d)).collect()[0].asDict()
    for k, v in w.items():
        if k != "name":
            assert 0.0 <= v <= 1.0, k


def test_skew_safe_equals_window_on_hot_query(spark):
    import random
    rnd = random.Random(3)
    run_rows = [("hot", f"d{i}", float(rnd.randint(0, 300))) for i in range(4000)]
    run_rows += [(f"q{j}", f"d{i}", float(rnd.random())) for j in range(5) for i in range(30)]
    qrels_rows = [("hot", f"d{i}", rnd.randint(0, 3)) for i in range(0, 4000, 7)]
    qrels_rows += [(f"q{j}", f"d{i}", rnd.randint(0, 3)) for j in range(5) for i in range(0, 30, 3)]
    run = spark.createDataFrame(run_rows, "qid string, docno string, score double")
    qrels = spark.createDataFrame(qrels_rows, "qid string, docno string, relevance int")
    a = metrics.evaluate(run, qrels, skew_safe=False).collect()[0].asDict()
    b = metrics.evaluate(run, qrels, skew_safe=True, partitions=3).collect()[0].asDict()
    for k in a:
        if k != "name":
            assert b[k] == pytest.approx(a[k], rel=1e-12), k
