"""Losses (L1-L16, G8) against independent numpy formulas on small groups."""

import numpy as np
import pytest

from taintrank.operators import losses

GROUPS = [([1.0, 0.0], [2.0, 1.0]), ([0.5, 1.5], [0.0, 3.0]), ([-1.0, 2.0], [1.0, 1.0])]


def lsm(x, t=1.0):
    x = np.asarray(x) / t
    m = x.max()
    return x - (m + np.log(np.exp(x - m).sum()))


def sm(x, t=1.0):
    return np.exp(lsm(x, t))


def sig(x):
    return 1 / (1 + np.exp(-np.asarray(x)))


def frame(spark, groups):
    return spark.createDataFrame([(p, l) for p, l in groups], "pred array<double>, label array<double>")


def value(df):
    return df.collect()[0]["loss"]


def res(a):
    a = np.asarray(a)
    return a[0] - a[1:]


EXPECTED = {
    "mse": lambda G: np.mean(np.concatenate([(np.array(p) - l) ** 2 for p, l in G])),
    "margin_mse": lambda G: np.mean(np.concatenate([(res(p) - res(l)) ** 2 for p, l in G])),
    "hinge": lambda G: np.mean(np.concatenate([
        np.maximum(1 - np.sign(res(sig(l))) * np.maximum(res(sig(p)), 0), 0) for p, l in G])),
    "clear": lambda G: np.mean(np.concatenate([np.maximum(1 - res(l) - res(p), 0) for p, l in G])),
    "lce": lambda G: np.mean([-lsm(p)[int(np.argmax(l))] for p, l in G]),
    "contrastive": lambda G: np.mean([-lsm(p)[int(np.argmax(l))] for p, l in G]),
    "kl_div": lambda G: sum(np.sum(sm(l) * (np.log(sm(l)) - lsm(p))) for p, l in G) / len(G),
    "ranknet": lambda G: np.mean(np.concatenate([[
        max(p[i] - p[j], 0) - (p[i] - p[j]) * float(l[i] > l[j]) + np.log1p(np.exp(-abs(p[i] - p[j])))
        for i in range(len(p)) for j in range(i + 1, len(p))] for p, l in G])),
    "listnet": lambda G: np.mean([-np.sum(sm(l) * lsm(p)) for p, l in G]),  # labels outside [0,1]
    "poly1": lambda G: np.mean([
        -np.sum(np.array(l) / np.sum(l) * lsm(p)) + (1 - np.sum(np.array(l) / np.sum(l) * sm(p)))
        for p, l in G]),
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_loss_matches_numpy(spark, name):
    assert value(losses.loss(frame(spark, GROUPS), name)) == pytest.approx(EXPECTED[name](GROUPS), rel=1e-9)


def test_group_of_five_and_size_one(spark):
    G5 = [([0.1, 0.4, -0.3, 2.0, 0.0], [0.2, 0.1, 0.0, 0.9, 0.5])]
    assert value(losses.loss(frame(spark, G5), "kl_div")) == pytest.approx(EXPECTED["kl_div"](G5))
    assert value(losses.loss(frame(spark, G5), "ranknet")) == pytest.approx(EXPECTED["ranknet"](G5))
    # labels in [0, 1]: listnet uses them as given
    exp = np.mean([-np.sum(np.array(l) * lsm(p)) for p, l in G5])
    assert value(losses.loss(frame(spark, G5), "listnet")) == pytest.approx(exp)
    # a group of one: softmax over one element, contrastive is 0; residual losses have no element
    one = frame(spark, [([1.3], [0.2])])
    assert value(losses.loss(one, "contrastive")) == pytest.approx(0.0)
    assert value(losses.loss(one, "margin_mse", reduction="sum")) is None or \
        value(losses.loss(one, "margin_mse", reduction="sum")) == 0.0


def test_reductions_and_errors(spark):
    df = frame(spark, GROUPS)
    per = [np.sum(sm(l) * (np.log(sm(l)) - lsm(p))) for p, l in GROUPS]
    assert value(losses.loss(df, "kl_div", reduction="sum")) == pytest.approx(sum(per))
    assert value(losses.loss(df, "kl_div", reduction="mean")) == pytest.approx(sum(per) / 6)
    rows = losses.loss(df, "mse", reduction="none").collect()
    assert len(rows) == 3 and len(rows[0]["loss"]) == 2
    with pytest.raises(ValueError):
        losses.loss(df, "nope")
    with pytest.raises(ValueError):
        losses.loss(df, "mse", reduction="avg")


def test_no_label_variants(spark):
    df = frame(spark, GROUPS)
    exp = np.mean([-lsm(p)[0] for p, _ in GROUPS])
    assert value(losses.loss(df, "lce", label=None)) == pytest.approx(exp)
    # ranknet without labels: only the first pair has target 1
    exp = np.mean([np.logaddexp(0, -(p[0] - p[1])) for p, _ in GROUPS])
    assert value(losses.loss(df, "ranknet", label=None)) == pytest.approx(exp)


def test_weighted_and_log(spark):
    df = frame(spark, GROUPS).selectExpr("*", "'x' AS origin")
    w = losses.weighted_loss(df, [("mse", 1.0), ("kl_div", 0.5)]).collect()[0]
    assert w["loss"] == pytest.approx(EXPECTED["mse"](GROUPS) + 0.5 * EXPECTED["kl_div"](GROUPS))
    lg = losses.loss_log(df, "mse", by=["origin"]).collect()[0]
    assert lg["loss"] == round(EXPECTED["mse"](GROUPS), 4)


def test_distill_ranknet_selects_ordered_pairs(spark):
    G = [([3.0, 1.0, 2.0], [2.0, 0.0, 1.0])]
    pairs = [(0, 1), (0, 2)]  # i < j only (upper triangle), label_i > label_j
    p, l = G[0]
    exp = np.mean([(p[i] - p[j]) + (l[i] - l[j] - 1) * 100 + 300 for i, j in pairs])
    assert value(losses.loss(frame(spark, G), "distill_ranknet")) == pytest.approx(exp)


def test_wrappers(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([([[0.0, 1.0], [1.0, 0.0]], [1.0, 0.0])], "logits array<array<double>>, label array<double>")
    g = df.withColumn("pred", losses.cat_pred("logits"))
    p = [1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(1.0))]
    assert value(losses.loss(g, "mse")) == pytest.approx(np.mean((np.array(p) - [1.0, 0.0]) ** 2))
    v = spark.createDataFrame([([1.0, 2.0], [[1.0, 0.0], [0.0, 1.0]], [0.0, 1.0])],
                              "query_vec array<double>, doc_vecs array<array<double>>, label array<double>")
    assert v.select(losses.dot_pred()).collect()[0][0] == [1.0, 2.0]
    d = spark.createDataFrame([([2.0, 0.0],)], "logits array<double>")
    assert d.select(losses.duo_score()).collect()[0][0] == pytest.approx(sm([2.0, 0.0])[0])
    assert F is not None


@pytest.mark.parametrize("name", ["kl_div", "listnet", "contrastive", "mse"])
def test_long_form_equals_array_form(spark, name):
    G = [([0.1, 0.4, -0.3, 2.0, 0.0], [2.0, 0.1, 0.0, 0.9, 0.5]), ([1.0, -1.0], [0.0, 3.0]), ([0.5], [1.0])]
    long = spark.createDataFrame([(g, i, p[i], l[i]) for g, (p, l) in enumerate(G) for i in range(len(p))],
                                 "g int, i int, s double, t double")
    a = value(losses.loss(frame(spark, G), name))
    b = value(losses.listwise_loss_long(long, name, ["g"]))
    assert b == pytest.approx(a, rel=1e-12)


@pytest.mark.parametrize("name", ["kl_div", "listnet", "contrastive", "mse"])
@pytest.mark.parametrize("labels_in_unit", [True, False])
def test_shared_negatives_equal_explicit_groups(spark, name, labels_in_unit):
    rng = np.random.default_rng(7)
    scale = 1.0 if labels_in_unit else 4.0
    pos = [("q1", "p1", 0.3, 0.9), ("q1", "p2", -1.2, 0.2), ("q2", "p3", 2.0, 0.5)]
    neg = [("q1", f"n{i}", float(rng.normal()), float(rng.uniform(0, 1) * scale)) for i in range(5)] + \
          [("q2", "m1", 0.1, 0.4 * scale)]
    pdf = spark.createDataFrame(pos, "qid string, docno string, s double, t double")
    ndf = spark.createDataFrame(neg, "qid string, docno string, s double, t double")
    groups = []
    for q, _, s, t in pos:
        ns = [(x[2], x[3]) for x in neg if x[0] == q]
        groups.append(([s] + [a for a, _ in ns], [t] + [b for _, b in ns]))
    expected = value(losses.loss(frame(spark, groups), name))
    got = value(losses.shared_negative_loss(pdf, ndf, name))
    assert got == pytest.approx(expected, rel=1e-9)
