"""A5/A6 on a ring of negatives, L8/L9 on long rows: equal to the array forms, hot groups split."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from taintrank.operators import losses, sampling

LONG = "g string, i int, s double, t double"


def groups(seed, sizes):
    rng = random.Random(seed)
    return [(g, i, rng.uniform(-3, 3), float(rng.randrange(4))) for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("name", losses.PAIRWISE_LONG)
def test_pairwise_long_equals_the_array_form(spark, name):
    rows = groups(4, {"a": 2, "b": 1, "hot": 60, "c": 7, None: 5})
    df = spark.createDataFrame(rows, LONG)
    arrays = df.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "s", "t"))).alias("x")).select(F.col("x.s").alias("pred"), F.col("x.t").alias("label"))
    for reduction in ("mean", "sum", "batchmean"):
        want = losses.loss(arrays, name, reduction=reduction).first()[0]
        for tile in (512, 8, 1):
            got = losses.pairwise_loss_long(df, name, ["g"], [F.col("i").asc()], reduction=reduction, tile=tile).first()[0]
            assert got == pytest.approx(want, rel=1e-12)


def test_ranknet_without_labels_and_without_pairs(spark):
    df = spark.createDataFrame(groups(5, {"a": 9, "b": 4}), LONG)
    arrays = df.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("x")).select(F.col("x.s").alias("pred"))
    want = losses.loss(arrays, "ranknet", label=None).first()[0]
    assert losses.pairwise_loss_long(df, "ranknet", ["g"], [F.col("i").asc()], label=None, tile=4).first()[0] == pytest.approx(want, rel=1e-12)
    assert losses.pairwise_loss_long(df.where("i = 0"), "ranknet", ["g"], [F.col("i").asc()]).first()[0] is None
    with pytest.raises(ValueError):
        losses.pairwise_loss_long(df, "mse", ["g"], [F.col("i").asc()])


def test_ring_gives_distinct_negatives(spark):
    pos = [("hot", f"p{i}") for i in range(300)] + [("b", "p1"), ("b", "p1"), ("few", "p1"), ("none", "p1")]
    neg = [("hot", f"n{i}") for i in range(200)] * 2 + [("b", f"n{i}") for i in range(9)] + [("few", "x"), ("few", "y"), ("other", "n")]
    p, n = spark.createDataFrame(pos, "query_id string, doc_id_a string"), spark.createDataFrame(neg, "query_id string, doc_id_b string")
    got = sampling.sample_pairs_ring(p, n, 4).collect()
    again = sampling.sample_pairs_ring(p.repartition(5), n.repartition(3), 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    picked = defaultdict(list)
    for r in got:
        assert (r.query_id, r.doc_id_b) in set(neg)
        picked[(r.query_id, r.doc_id_a)].append((r.idx, r.doc_id_b))
    assert {k: len(v) for k, v in picked.items()} == {k: {"few": 2}.get(k[0], 4) for k in set(pos) if k[0] != "none"}
    assert all(len({d for _, d in v}) == len(v) and sorted(i for i, _ in v) == list(range(1, len(v) + 1)) for v in picked.values())
    spread = Counter(r.doc_id_b for r in got if r.query_id == "hot")
    assert len(spread) > 150 and max(spread.values()) < 6 * math.ceil(1200 / 200)
    other = sampling.sample_pairs_ring(p, n, 4, seed=7).collect()
    assert sorted(map(tuple, other)) != sorted(map(tuple, got))


def test_training_order_and_log(spark):
    rows = [(str(i), [float(i), 0.0], [0.0, 1.0]) for i in range(53)]
    df = spark.createDataFrame(rows, "id string, pred array<double>, label array<double>")
    order = losses.training_order(df, ["id"], 4, accumulation=3, epochs=2).collect()
    per = Counter((r.epoch, r.micro) for r in order)
    assert len(order) == 106 and sorted(per.values()) == [1, 1] + [4] * 26
    assert all(r.step == r.epoch * 5 + r.micro // 3 for r in order) and {r.step for r in order} == set(range(10))
    first = [sorted(r.id for r in order if (r.epoch, r.micro) == (e, 0)) for e in (0, 1)]
    assert first[0] != first[1]                            # epochs are shuffled apart
    want = defaultdict(float)
    for (e, m), n in per.items():
        own = [r for r in order if (r.epoch, r.micro) == (e, m)]
        want[own[0].step // 4] += sum(r.pred[0] ** 2 + 1 for r in own) / (2 * n)
    got = {r.window: (r.n_steps, r.loss) for r in losses.step_log(df, "mse", ["id"], 4, accumulation=3, log_every=4, epochs=2).collect()}
    assert got == {w: (n, pytest.approx(want[w] / n / 3, abs=1e-4)) for w, n in ((0, 4), (1, 4), (2, 2))}


def test_in_batch_scores(spark):
    from taintrank.operators import scoring
    b = spark.createDataFrame([(0, "q1", ["a", "b"]), (0, "q2", ["b", "x"]), (1, "q1", ["c"])], "batch long, qid string, docnos array<string>")
    q = spark.createDataFrame([("q1", [1.0, 2.0]), ("q2", [0.0, 1.0])], "qid string, vec array<double>")
    d = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 0.0]), ("c", [0.0, 3.0])], "docno string, vec array<double>")
    got = {(r.batch, r.qid, r.docno): r.score for r in scoring.in_batch_scores(b, q, d).collect()}
    assert got == {(0, "q1", "a"): 3.0, (0, "q1", "b"): 2.0, (0, "q2", "a"): 1.0, (0, "q2", "b"): 0.0, (1, "q1", "c"): 6.0}
