"""KL divergence (G5/G6), moments (G3), t-test (G4), distribution tables."""

import math
import numpy as np
import pytest
from pyspark.sql import functions as F

from taintrank.functions.stats import pooled_t, t_two_sided_p
from taintrank.operators import compare, distributions


def scores(spark, rows):
    return spark.createDataFrame(rows, "qid string, docno string, score double")


def kl_ref(s, t):
    out = []
    for q in s:
        if q not in t:
            continue
        common = [d for d in s[q] if d in t[q]]
        if not common:
            continue
        a = np.array([s[q][d] for d in common])
        b = np.array([t[q][d] for d in common])
        if a.sum() == 0 or b.sum() == 0:
            continue
        a = np.clip(a / a.sum(), 1e-10, 1)
        b = np.clip(b / b.sum(), 1e-10, 1)
        out.append(np.sum(a * np.log(a / b)))
    return np.mean(out) if out else float("nan")


def test_kl_edge_cases(spark):
    s = {"q1": {"a": 1.0, "b": 3.0, "c": 9.0}, "q2": {"a": 1.0, "b": -1.0}, "q3": {"x": -2.0, "y": 5.0},
         "q4": {"z": 1.0}}
    t = {"q1": {"a": 2.0, "b": 2.0}, "q2": {"a": 3.0, "b": 1.0}, "q3": {"x": 1.0, "y": 1.0}}
    sd = scores(spark, [(q, d, v) for q, m in s.items() for d, v in m.items()])
    td = scores(spark, [(q, d, v) for q, m in t.items() for d, v in m.items()])
    r = compare.kl_divergence(sd, td).collect()[0]
    assert r["kl"] == pytest.approx(kl_ref(s, t))
    assert r["n_matched"] == 2 and r["n_skipped"] == 1  # q2's student sum is 0
    assert [x["qid"] for x in compare.skipped_queries(sd, td).collect()] == ["q2"]
    same = compare.kl_divergence(td, td).collect()[0]
    assert same["kl"] == pytest.approx(0.0, abs=1e-12)


def test_kl_no_match_is_null(spark):
    a = scores(spark, [("q1", "a", 1.0)])
    b = scores(spark, [("q2", "a", 1.0)])
    assert compare.kl_divergence(a, b).collect() == [] or compare.kl_divergence(a, b).collect()[0]["kl"] is None


def test_moments_and_ttest(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, 200), rng.normal(0.3, 2, 150)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", float(v)) for v in y],
                               "model_type string, score double")
    m = {r["model_type"]: r for r in compare.moments(df).collect()}
    mu = x.mean()
    assert m["a"]["variance"] == pytest.approx(x.var(ddof=1))
    assert m["a"]["skewness"] == pytest.approx(np.mean((x - mu) ** 3) / np.mean((x - mu) ** 2) ** 1.5)
    assert m["a"]["kurtosis"] == pytest.approx(np.mean((x - mu) ** 4) / np.mean((x - mu) ** 2) ** 2 - 3)
    t, p = compare.t_test(df, "a", "b")
    sp2 = ((199) * x.var(ddof=1) + 149 * y.var(ddof=1)) / 348
    assert t == pytest.approx((x.mean() - y.mean()) / np.sqrt(sp2 * (1 / 200 + 1 / 150)))
    assert 0 < p < 1
    row = compare.t_test_table(df, "a", "b").collect()[0]
    assert row["t"] == pytest.approx(t) and row["dof"] == 348


def test_t_distribution_p_values():
    # two-sided critical values of Student's t
    assert t_two_sided_p(2.228138851986274, 10) == pytest.approx(0.05, abs=1e-9)
    assert t_two_sided_p(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided_p(0.0, 5) == pytest.approx(1.0)
    assert t_two_sided_p(12.706204736174698, 1) == pytest.approx(0.05, abs=1e-9)
    t, p = pooled_t(3, 1.0, 1.0, 3, 1.0, 1.0)
    assert t == 0 and p == pytest.approx(1.0)


def test_exact_quantiles_with_refinement(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([rng.normal(0, 1, 3000), np.full(500, 0.25), rng.exponential(5, 1000)])
    df = spark.createDataFrame([("g", float(v)) for v in vals] + [("h", 1.0), ("h", 2.0)],
                               "model_type string, score double")
    q = {(r["model_type"], r["p"]): r["q"] for r in distributions.exact_quantiles(
        df, probs=(0.1, 0.25, 0.5, 0.75, 0.99), buckets=8, last=4).collect()}
    for p in (0.1, 0.25, 0.5, 0.75, 0.99):
        assert q[("g", p)] == pytest.approx(np.percentile(vals, p * 100), abs=1e-12)
    assert q[("h", 0.5)] == pytest.approx(1.5)


def test_box_histogram_kde_ecdf(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(0, 1, 500), [8.0, -9.0]])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "model_type string, score double")
    b = distributions.box_stats(df).collect()[0]
    q1, q3 = np.percentile(vals, [25, 75])
    iqr = q3 - q1
    assert b["median"] == pytest.approx(np.median(vals))
    inside = vals[(vals >= q1 - 1.5 * iqr) & (vals <= q3 + 1.5 * iqr)]
    assert b["whisker_lo"] == inside.min() and b["whisker_hi"] == inside.max()
    assert b["n_outliers"] == len(vals) - len(inside)
    h = distributions.histogram(df, bins=10).collect()
    assert sum(r["count"] for r in h) == len(vals)
    k = distributions.kde(df).orderBy("i").collect()
    xs = np.array([r["x"] for r in k])
    dens = np.array([r["density"] for r in k])
    assert len(k) == 200 and np.trapezoid(dens, xs) == pytest.approx(1.0, abs=0.02)
    e = distributions.ecdf(df).orderBy("score").collect()
    assert e[-1]["cdf"] == pytest.approx(1.0) and e[0]["cdf"] == pytest.approx(1 / len(vals))


SHAPES = {
    "hot group and ties": [("hot", str(i), float(i % 17)) for i in range(3000)] + [("cold", str(i), float(i)) for i in range(5)],
    "one value, ids with a long common prefix": [("hot", f"collection-document-{i:05d}", 1.0) for i in range(3000)] + [("cold", "a", 0.5)],
    "one outlier": [("hot", str(i), float(i % 1000) / 1000) for i in range(3000)] + [("hot", "far", 1e9)],
    "null group": [(None, str(i), float(i % 7)) for i in range(2000)] + [("q", str(i), None if i % 5 == 0 else 1.0) for i in range(100)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_ordered_positions_match_window_in_bounded_slices(spark, shape):
    from pyspark.sql import Window
    from taintrank.operators.rank import ordered_positions, range_parts
    df = spark.createDataFrame(SHAPES[shape], "qid string, docno string, score double").withColumn("w", F.length("docno").cast("long"))
    order = [F.col("score").desc(), F.col("docno").desc()]
    got = ordered_positions(df, ["qid"], "score", True, [F.col("docno").desc()], sums=[(None, "pos"), ("w", "cum")], partitions=10)
    w = Window.partitionBy("qid").orderBy(*order)
    exp = df.withColumn("pos", F.row_number().over(w)).withColumn("cum", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    key = lambda r: (r["qid"] or "", r["docno"], r["pos"], r["cum"])
    assert sorted(map(key, got.collect())) == sorted(map(key, exp.collect()))
    largest = range_parts(df, ["qid"], order, 10).groupBy("_part").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * df.count() / 10


def test_constant_groups(spark):
    df = spark.createDataFrame([("a", 1.0)] * 4 + [("b", 1.0)] * 3 + [("c", 2.0)] * 3, "model_type string, score double")
    r = compare.t_test_table(df, "a", "b", p_value=True).collect()[0]
    assert r["t"] is None and r["p"] is None
    r = compare.t_test_table(df, "a", "c", p_value=True).collect()[0]
    assert r["t"] == -math.inf and r["p"] == 0.0 and compare.t_test(df, "a", "c") == (-math.inf, 0.0)
    assert all(x["density"] is None for x in distributions.kde(df.where("model_type = 'a'")).collect())


def test_quantiles_of_hot_ties_and_outliers(spark):
    rng = np.random.default_rng(4)
    vals = np.concatenate([np.zeros(3000), rng.normal(0, 1, 300), [1e12, -1e9]])
    df = spark.createDataFrame([("g", float(v)) for v in vals], "model_type string, score double")
    q = {r["p"]: r["q"] for r in distributions.exact_quantiles(df, probs=(0.01, 0.05, 0.5, 0.95, 0.999), buckets=64, last=10).collect()}
    for p in q:
        assert q[p] == pytest.approx(np.percentile(vals, p * 100), rel=1e-12, abs=1e-12)
