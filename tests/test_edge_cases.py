"""Hard cases of positions, densities, tests and zero-sum queries on small made-up frames."""

import math

from pyspark.sql import functions as F

from taintrank.operators import compare, distributions, metrics, rank

RUN = "qid string, docno string, score double"


def positions(spark, rows):
    df = spark.createDataFrame(rows, RUN)
    got = rank.ordered_positions(df, ["qid"], "score", True, [F.col("docno").desc()]).select("qid", "docno", "pos").collect()
    want = {}
    for q in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == q), key=lambda r: r[1], reverse=True)
        own.sort(key=lambda r: -r[2])
        want |= {(q, r[1]): k for k, r in enumerate(own, 1)}
    assert {(r.qid, r.docno): r.pos for r in got} == want


def test_positions_of_a_null_group(spark):
    positions(spark, [(None if i % 5 == 0 else str(i % 5), str(i), float(i * 7 % 11)) for i in range(200)])


def test_positions_with_an_outlier(spark):
    positions(spark, [("all", str(i), 1e9 if i == 7 else float(i % 13)) for i in range(300)])


def test_positions_of_one_value_and_a_long_common_prefix(spark):
    positions(spark, [("all", f"collection-document-{i}", 1.0) for i in range(300)])


def test_density_of_a_constant_group_is_null(spark):
    df = spark.createDataFrame([("O", 5.0)] * 9 + [("F", float(i)) for i in range(9)], "model_type string, score double")
    got = distributions.kde(df).where("model_type = 'O'").collect()
    assert len(got) == 200 and all(r.x == 5.0 and r.density is None for r in got)


def test_t_test_without_variance_is_null(spark):
    df = spark.createDataFrame([("O", 1.0)] * 4 + [("F", 1.0)] * 5, "model_type string, score double")
    r = compare.t_test_table(df, "O", "F", p_value=True).first()
    assert (r.n1, r.n2, r.m1, r.m2, r.dof) == (4, 5, 1.0, 1.0, 7) and all(x is None or math.isnan(x) for x in (r.t, r.p))


def test_zero_sum_queries_are_skipped(spark):
    s = spark.createDataFrame([("1", "a", 0.0), ("1", "b", 0.0), ("2", "a", 1.0)], RUN)
    t = spark.createDataFrame([("1", "a", 2.0), ("1", "b", 1.0), ("2", "a", 1.0)], RUN)
    assert [tuple(r) for r in compare.skipped_queries(s, t).select("qid", "s_sum", "t_sum").collect()] == [("1", 0.0, 3.0)]


def test_missing_queries_are_zero(spark):
    run = spark.createDataFrame([("x", "1", "a", 1.0)], "name string, " + RUN)
    qrels = spark.createDataFrame([("1", "a", 1), ("2", "a", 1)], "qid string, docno string, relevance int")
    rows = {r.qid: tuple(r)[2:] for r in metrics.per_query(run, qrels).collect()}
    assert all(v == 0 for v in rows["2"]) and any(v > 0 for v in rows["1"])
