"""Property checks: metric bounds, plan-shape invariance, KL(x||x) = 0."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from taintrank.operators import compare, metrics

runs = st.lists(st.tuples(st.sampled_from(["q1", "q2", "q3"]), st.sampled_from(list("abcdefgh")),
                          st.integers(-3, 3).map(float)), min_size=1, max_size=25,
                unique_by=lambda r: (r[0], r[1]))
qrels = st.lists(st.tuples(st.sampled_from(["q1", "q2", "q4"]), st.sampled_from(list("abcdefgh")),
                           st.integers(0, 3)), min_size=1, max_size=15, unique_by=lambda r: (r[0], r[1]))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(run=runs, judged=qrels)
def test_metrics_bounded_and_plan_independent(spark, run, judged):
    r = spark.createDataFrame(run, "qid string, docno string, score double")
    q = spark.createDataFrame(judged, "qid string, docno string, relevance int")
    a = metrics.evaluate(r, q, skew_safe=False).collect()[0].asDict()
    b = metrics.evaluate(r.repartition(3), q, skew_safe=True, partitions=5).collect()[0].asDict()
    for k, v in a.items():
        if k == "name":
            continue
        assert 0.0 <= v <= 1.0 + 1e-12, k
        assert b[k] == pytest.approx(v, abs=1e-12), k


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(run=runs)
def test_kl_of_identical_maps_is_zero(spark, run):
    s = spark.createDataFrame([(q, d, abs(x) + 1.0) for q, d, x in run], "qid string, docno string, score double")
    r = compare.kl_divergence(s, s).collect()[0]
    assert r["kl"] == pytest.approx(0.0, abs=1e-12)
