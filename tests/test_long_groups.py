"""Groups on long rows against the array forms and plain Python."""

from collections import defaultdict

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from taintrank.operators import long_groups, reshape

PAIRS_A, PAIRS_B = "query_id string, doc_id_a string", "query_id string, doc_id_b string"


def data(spark):
    pos = [("hot", f"p{i}") for i in range(40)] + [("b", "p1"), ("b", "p1"), ("b", "p2"), ("few", "p1"), (None, "p9"), ("b", None)]
    neg = [("hot", f"n{i}") for i in range(30)] * 2 + [("b", f"n{i}") for i in range(5)] + [("few", "x"), ("other", "n"), (None, "n")]
    return pos, neg, spark.createDataFrame(pos, PAIRS_A), spark.createDataFrame(neg, PAIRS_B)


@pytest.mark.parametrize("bucket", [1024, 7, 1])
def test_pivot_equals_the_array_form(spark, bucket):
    _, _, p, n = data(spark)
    p, n = p.dropna(), n.dropna()
    numbered = long_groups.numbered_negatives(n).cache()
    arrays = numbered.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("idx", "docno"))).getField("docno").alias("docnos"))
    want = sorted(map(repr, reshape.pivot_with_negatives(p, arrays).collect()))
    got = long_groups.pivot_with_negatives(p, numbered, bucket)
    assert sorted(map(repr, got.select("qid", "idx", "docno", "pos").collect())) == want
    empty = long_groups.pivot_with_negatives(p.limit(0), numbered, bucket)
    assert empty.count() == 0 and empty.columns == ["qid", "idx", "docno", "pos"]
    with pytest.raises(PySparkException, match="no negatives for query none"):
        long_groups.pivot_with_negatives(spark.createDataFrame([("none", "p")], PAIRS_A), numbered, bucket).collect()


def test_groups_hold_the_positive_and_distinct_negatives(spark):
    pos, neg, p, n = data(spark)
    negs = defaultdict(set)
    for q, d in neg:
        negs[q].add(d)
    rows = long_groups.groups(p, n, 4, short="keep").collect()
    found = defaultdict(dict)
    for r in rows:
        assert r.pos_idx not in found[r.gid, r.qid]
        found[r.gid, r.qid][r.pos_idx] = r.docno
    whole = {x for x in pos if None not in x}
    assert {(q, g[0]) for (_, q), g in found.items()} == whole and len(found) == len(whole)
    for (_, q), g in found.items():
        rest = [g[i] for i in range(1, len(g))]
        assert len(rest) == min(3, len(negs[q])) == len(set(rest)) and set(rest) <= negs[q]
    alone = long_groups.groups(p, n, 4, include_positive=False, short="keep").collect()
    assert sorted((r.gid, r.pos_idx, r.docno) for r in alone) == sorted((r.gid, r.pos_idx - 1, r.docno) for r in rows if r.pos_idx)
    assert sorted((r.gid, r.docno) for r in long_groups.groups(p, n, 1).collect()) == sorted((r.gid, r.docno) for r in rows if not r.pos_idx)
    pairs = long_groups.pos_pairs(long_groups.groups(p, n, 4, short="keep")).collect()
    assert sorted((r.gid, r.idx, r.positive, r.negative) for r in pairs) == sorted((k[0], i, g[0], g[i]) for k, g in found.items() for i in g if i)


def test_short_groups_fail_or_stay(spark):
    _, _, p, n = data(spark)
    with pytest.raises(PySparkException, match="larger than population for query few"):
        long_groups.groups(p, n, 3).collect()
    with pytest.raises(PySparkException, match="larger than population"):
        long_groups.groups(p.where("query_id = 'few'"), n, 3, include_positive=False).collect()
    assert long_groups.groups(p.where("query_id = 'hot'"), n, 31).count() == 40 * 31
    with pytest.raises(ValueError):
        long_groups.groups(p, n, 0)
    with pytest.raises(ValueError):
        long_groups.groups(p, n, 2, short="drop")


def test_assemble_is_the_cross_layout(spark):
    _, _, p, n = data(spark)
    rows = long_groups.groups(p, n, 3, short="keep").cache()
    queries = spark.createDataFrame([(q, f"query {q}") for q in ("hot", "b", "few")], "qid string, query string")
    docs = rows.select("docno").distinct().withColumn("text", F.concat(F.lit("text "), "docno"))
    teacher = spark.createDataFrame([("hot", "n1", 2.5), ("b", "p1", -1.0)], "qid string, docno string, score double")
    got = long_groups.assemble(rows, queries, docs, teacher)
    arrays = rows.groupBy("gid", "qid").agg(F.sort_array(F.collect_list(F.struct("pos_idx", "docno"))).getField("docno").alias("docnos"))
    want = reshape.cross_layout(reshape.assemble_groups(arrays, queries, docs, teacher))
    cols = ["gid", "qid", "pos_idx", "docno", "query", "text", "label"]
    assert sorted(map(repr, got.select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    with pytest.raises(PySparkException, match="unknown docno"):
        long_groups.assemble(rows, queries, docs.where("docno != 'n1'")).collect()
