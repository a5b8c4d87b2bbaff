"""Distillation losses evaluated over whole score tables.

Input: one row per training group with ``pred`` and ``label`` arrays
(column 0 = positive). Each loss is a native per-row expression producing
the row's loss *elements*; the reduction is a single aggregate over the
table (partial sums per task, no group ever collected):

* ``mean``      sum of elements / number of elements (as torch's mean)
* ``sum``       sum of elements
* ``batchmean`` sum of elements / number of rows
* ``none``      the per-row element array
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from .rank import ordered_positions
from .sampling import DEFAULT_SEED, order_key

REDUCTIONS = ("none", "mean", "sum", "batchmean")


def _pairs(n: Column) -> Column:
    """All index pairs (i, j), 1-based, i < j, of an array of length n."""
    return F.when(n < 2, F.array().cast("array<struct<i:int,j:int>>")).otherwise(
        F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(
            F.sequence(i + 1, n), lambda j: F.struct(i.alias("i"), j.alias("j"))))))


def _target(label: Column | None) -> Column:
    return F.lit(0) if label is None else F.coalesce(V.argmax(label), F.lit(0))


def _mse(p, l, **_):
    return F.zip_with(p, l, lambda a, b: F.pow(a - b, 2))


def _margin_mse(p, l, **_):
    return F.zip_with(V.residual(p), V.residual(l), lambda a, b: F.pow(a - b, 2))


def _hinge(p, l, margin: float = 1.0, **_):
    rp = F.transform(V.residual(F.transform(p, V.sigmoid)), V.relu)
    rl = F.transform(V.residual(F.transform(l, V.sigmoid)), V.sign)
    return F.zip_with(rp, rl, lambda a, s: V.relu(F.lit(margin) - s * a))


def _clear(p, l, margin: float = 1.0, **_):
    return F.zip_with(V.residual(l), V.residual(p), lambda a, b: V.relu(F.lit(margin) - a - b))


def _lce(p, l, **_):
    return F.array(-F.element_at(V.log_softmax(p), _target(l) + 1))


def _contrastive(p, l, temperature: float = 1.0, **_):
    return F.array(-F.element_at(V.log_softmax(p, temperature), _target(l) + 1))


def _kl_div(p, l, temperature: float = 1.0, **_):
    q = V.softmax(l, temperature)
    return F.zip_with(q, V.log_softmax(p, temperature),
                      lambda qi, li: F.when(qi == 0, F.lit(0.0)).otherwise(qi * (F.log(qi) - li)))


def _ranknet(p, l, **_):
    pairs = _pairs(F.size(p))

    def elem(pr):
        x = F.element_at(p, pr["i"]) - F.element_at(p, pr["j"])
        if l is None:
            t = ((pr["i"] == 1) & (pr["j"] == 2)).cast("double")
        else:
            t = (F.element_at(l, pr["i"]) > F.element_at(l, pr["j"])).cast("double")
        return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    return F.transform(pairs, elem)


def _distill_ranknet(p, l, base_margin: float = 300.0, increment_margin: float = 100.0, **_):
    pairs = F.filter(_pairs(F.size(p)),
                     lambda pr: F.element_at(l, pr["i"]) > F.element_at(l, pr["j"]))
    return F.transform(pairs, lambda pr: (F.element_at(p, pr["i"]) - F.element_at(p, pr["j"]))
                       + (F.element_at(l, pr["i"]) - F.element_at(l, pr["j"]) - 1) * increment_margin
                       + base_margin)


def _listnet(p, l, temperature: float = 1.0, labels_in_unit: Column | None = None, **_):
    lab = F.when(labels_in_unit, V.as_double(l)).otherwise(V.softmax(l, temperature))
    return F.array(-V.array_sum(F.zip_with(lab, V.log_softmax(p), lambda a, b: a * b)))


def _poly1(p, l, temperature: float = 1.0, epsilon: float = 1.0, **_):
    total = V.array_sum(l)
    lhat = F.transform(l, lambda x: F.try_divide(x, total))
    ce = -V.array_sum(F.zip_with(lhat, V.log_softmax(p, temperature), lambda a, b: a * b))
    expansion = V.array_sum(F.zip_with(lhat, V.softmax(p, temperature), lambda a, b: a * b))
    return F.array(ce + (1 - expansion) * epsilon)


# name -> (element builder, default reduction, needs labels)
LOSSES: dict[str, tuple[Callable, str, bool]] = {
    "mse": (_mse, "mean", True),
    "margin_mse": (_margin_mse, "mean", True),
    "hinge": (_hinge, "mean", True),
    "clear": (_clear, "mean", True),
    "lce": (_lce, "mean", False),
    "contrastive": (_contrastive, "mean", False),
    "kl_div": (_kl_div, "batchmean", True),
    "ranknet": (_ranknet, "mean", False),
    "distill_ranknet": (_distill_ranknet, "mean", True),
    "listnet": (_listnet, "mean", True),
    "poly1": (_poly1, "mean", True),
}


def loss_elements(df: DataFrame, name: str, pred: str = "pred", label: str | None = "label",
                  **args) -> tuple[DataFrame, Column]:
    """(frame, per-row array of loss elements of ``name``).

    The frame gains a helper column when a loss needs a table-wide value
    (listnet's label-range flag, a scalar subquery evaluated once).
    """
    if name not in LOSSES:
        raise ValueError(f"no loss named {name}")
    fn, _, needs = LOSSES[name]
    if needs and label is None:
        raise ValueError(f"{name} needs labels")
    p = V.as_double(pred)
    l = V.as_double(label) if label is not None else None
    if name == "listnet" and "labels_in_unit" not in args:
        flag = df.select(F.coalesce(F.bool_and(
            F.forall(label, lambda x: (x >= 0) & (x <= 1))), F.lit(True))).scalar()
        df = df.withColumn("_labels_in_unit", flag)
        args["labels_in_unit"] = F.col("_labels_in_unit")
    return df, fn(p, l, **args)


def _reduce(elems: Column, reduction: str) -> list[Column]:
    """Null elements (e.g. poly1 on a zero label sum) are left out of sum and count."""
    kept = F.filter(elems, lambda x: x.isNotNull())
    s = F.sum(V.array_sum(kept))
    if reduction == "sum":
        return [s]
    if reduction == "mean":
        return [s / F.sum(F.size(kept))]
    if reduction == "batchmean":
        return [s / F.count_if(F.size(kept) > 0)]
    raise ValueError(f"reduction {reduction} is not one of {REDUCTIONS}")


def loss(df: DataFrame, name: str, pred: str = "pred", label: str | None = "label",
         reduction: str | None = None, by: Sequence[str] = (), **args) -> DataFrame:
    """L1-L11 + G8: the loss of the whole table (or per ``by`` group, L16)."""
    if name not in LOSSES:
        raise ValueError(f"no loss named {name}")
    reduction = reduction or LOSSES[name][1]
    if reduction not in REDUCTIONS:
        raise ValueError(f"reduction {reduction} is not one of {REDUCTIONS}")
    df, elems = loss_elements(df, name, pred, label, **args)
    if reduction == "none":
        return df.withColumn("loss", elems)
    (agg,) = _reduce(elems, reduction)
    return df.groupBy(*by).agg(agg.alias("loss"))


def weighted_loss(df: DataFrame, parts: Sequence[tuple[str, float]], pred: str = "pred",
                  label: str | None = "label", by: Sequence[str] = (), **args) -> DataFrame:
    """Sum of w_i * loss_i (default reductions) in one aggregate."""
    total = None
    cols = []
    for name, w in parts:
        df, elems = loss_elements(df, name, pred, label, **args)
        (agg,) = _reduce(elems, LOSSES[name][1])
        cols.append(agg.alias(name))
        total = agg * w if total is None else total + agg * w
    return df.groupBy(*by).agg(total.alias("loss"), *cols)


def loss_log(df: DataFrame, name: str, by: Sequence[str], pred: str = "pred",
             label: str | None = "label", **args) -> DataFrame:
    """Unregularised loss per logging window / origin, rounded to 4 digits."""
    return loss(df, name, pred, label, by=by, **args).withColumn("loss", F.round("loss", 4))


def cat_pred(logits: str = "logits") -> Column:
    """Per-doc class-1 probability from 2 logits (``array<array<double>>``)."""
    return F.transform(logits, V.class1_prob)


def dot_pred(query_vec: str = "query_vec", doc_vecs: str = "doc_vecs") -> Column:
    """Per-doc dot product of the query vector with its group's vectors."""
    return V.grouped_dot(query_vec, doc_vecs)


def duo_score(logits: str = "logits") -> Column:
    """First-class softmax probability (duo score) next to the loss on logits."""
    return V.first_class_prob(logits)


def training_order(df: DataFrame, keys: Sequence[str], batch_size: int, accumulation: int = 1, epochs: int = 1,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """The rows of ``df`` once per epoch with ``epoch``, ``micro`` (micro-batch in the epoch) and ``step`` (global optimiser step, from 0).

    An epoch's order is the salted md5 of its number and ``keys``, numbered by range partitions. A step takes ``accumulation`` micro-batches of
    ``batch_size`` rows; an epoch's last ones may be short.
    """
    rows = df.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    rows = rows.withColumn("_key", order_key(seed, "epoch", *keys)).withColumn("_num", F.conv(F.substring("_key", 1, 12), 16, 10).cast("double"))
    rows = cut_lineage(rows, "epochs")
    placed = ordered_positions(rows, ["epoch"], "_num", False, [F.col("_key").asc()], sums=[(None, "_at")])
    n = rows.where("epoch = 0").select(F.count(F.lit(1))).scalar()
    steps = F.ceil(F.ceil(n / F.lit(batch_size)) / F.lit(accumulation)).cast("long")
    micro = F.floor((F.col("_at") - 1) / batch_size)
    return placed.withColumn("micro", micro).withColumn("step", F.col("epoch") * steps + F.floor(F.col("micro") / accumulation)).drop("_key", "_num", "_at")


def step_log(df: DataFrame, name: str, keys: Sequence[str], batch_size: int, accumulation: int = 1, log_every: int = 500, epochs: int = 1,
             seed: int = DEFAULT_SEED, pred: str = "pred", label: str | None = "label", **args) -> DataFrame:
    """``window, n_steps, loss``, the loss log of a training run over ``df``: per ``log_every`` global steps the sum of the
    micro-batch losses (mean reduction) by steps and accumulation, rounded to 4 digits. The last window may be short."""
    rows, elems = loss_elements(training_order(df, keys, batch_size, accumulation, epochs, seed), name, pred, label, **args)
    (mean,) = _reduce(elems, "mean")
    micro = rows.groupBy("epoch", "micro", "step").agg(mean.alias("_loss"))
    window = F.floor(F.col("step") / log_every).alias("window")
    out = micro.groupBy(window).agg(F.sum("_loss").alias("_sum"), (F.max("step") - F.min("step") + 1).alias("n_steps"))
    return out.select("window", "n_steps", F.round(F.col("_sum") / F.col("n_steps") / accumulation, 4).alias("loss"))


# ---------------------------------------------------------------- long-form listwise losses

LONG_FORM = ("kl_div", "listnet", "contrastive", "lce", "mse")


def listwise_loss_long(df: DataFrame, name: str, group: Sequence[str], pos: str = "i",
                       pred: str = "s", label: str | None = "t", temperature: float = 1.0,
                       reduction: str | None = None) -> DataFrame:
    """Listwise losses on a *long* table (one row per group element), so a
    group of any size is never collected into one row or one task.

    The per-group softmax needs only the group's max and sum of exponentials:
    a partial + final aggregate, joined back on the group key. Supported:
    ``kl_div``, ``listnet``, ``contrastive`` / ``lce`` (target = first
    maximum label, position order given by ``pos``), ``mse``. Reductions as in
    :func:`loss`; ``batchmean`` divides by the number of groups.
    """
    if name not in LONG_FORM:
        raise ValueError(f"{name} has no long form")
    reduction = reduction or LOSSES[name][1]
    if reduction not in REDUCTIONS or reduction == "none":
        raise ValueError(f"reduction {reduction} is not one of {REDUCTIONS}")
    T = temperature if name in ("kl_div", "listnet", "contrastive") else 1.0
    s = F.col(pred).cast("double") / (1.0 if name == "listnet" else T)      # listnet scales the labels alone
    t = F.col(label).cast("double") / T if label is not None else None
    aggs = [F.max(s).alias("_ms")]
    if t is not None:
        aggs.append(F.max(t).alias("_mt"))
    g1 = df.groupBy(*group).agg(*aggs)
    j = df.join(g1, list(group))
    aggs2 = [F.sum(F.exp(s - F.col("_ms"))).alias("_zs")]
    if t is not None:
        aggs2.append(F.sum(F.exp(t - F.col("_mt"))).alias("_zt"))
        aggs2.append(F.min_by(F.col(pos), F.struct(-F.col(label).cast("double"), F.col(pos))).alias("_arg"))
    g2 = j.groupBy(*group, *(["_ms"] + (["_mt"] if t is not None else []))).agg(*aggs2)
    k = df.join(g2, list(group))
    lsm = s - F.col("_ms") - F.log(F.col("_zs"))
    if name == "kl_div":
        q = F.exp(t - F.col("_mt") - F.log(F.col("_zt")))
        elem = F.when(q == 0, F.lit(0.0)).otherwise(q * (F.log(q) - lsm))
    elif name == "listnet":
        unit = df.select(F.coalesce(F.bool_and((F.col(label) >= 0) & (F.col(label) <= 1)), F.lit(True))).scalar()
        q = F.exp(t - F.col("_mt") - F.log(F.col("_zt")))
        k = k.withColumn("_unit_all", unit)
        elem = -F.when(F.col("_unit_all"), F.col(label).cast("double")).otherwise(q) * lsm
    elif name in ("contrastive", "lce"):
        target = F.col("_arg") if label is not None else F.lit(0)
        elem = F.when(F.col(pos) == target, -lsm)
    else:  # mse
        elem = F.pow(F.col(pred).cast("double") - F.col(label).cast("double"), 2)
    per_group = k.groupBy(*group).agg(F.sum(elem).alias("_sum"), F.count(elem).alias("_n"))
    if reduction == "sum":
        out = F.sum("_sum")
    elif reduction == "batchmean" or name in ("listnet", "contrastive", "lce"):
        out = F.sum("_sum") / F.count(F.lit(1))
    else:
        out = F.sum("_sum") / F.sum("_n")
    return per_group.agg(out.alias("loss"))


PAIRWISE_LONG = ("ranknet", "distill_ranknet")
TILE = 512                   # elements of a group in one tile


def pairwise_loss_long(df: DataFrame, name: str, group: Sequence[str], order: Sequence[Column], pred: str = "s",
                       label: str | None = "t", base_margin: float = 300.0, increment_margin: float = 100.0,
                       reduction: str | None = None, tile: int = TILE) -> DataFrame:
    """L8 and L9 on a *long* table (one row per group element), for groups of any size.

    Elements are numbered in ``order`` (which must make it total) by range partitions and cut into tiles; two tiles of a group meet under the key (group, tile, tile), so a
    hot group is spread over the square of its tiles and no row or key holds more than ``tile`` elements of a side. The pairs of two
    tiles are summed as they are met. Pairs and reductions as in :func:`loss`: every element with each later one, for L9 those whose first label is larger.
    """
    if name not in PAIRWISE_LONG:
        raise ValueError(f"{name} is not one of {PAIRWISE_LONG}")
    reduction = reduction or LOSSES[name][1]
    if reduction not in REDUCTIONS or reduction == "none":
        raise ValueError(f"reduction {reduction} is not one of {REDUCTIONS}")
    group = list(group)
    if name == "distill_ranknet" and label is None:
        raise ValueError("distill_ranknet needs a label")
    lab = F.lit(0.0) if label is None else F.col(label).cast("double")
    names = [c for c in df.columns if c not in ("_zero", "_p", "_l")]
    rows = cut_lineage(df.select(*names, F.lit(0.0).alias("_zero"), F.col(pred).cast("double").alias("_p"), lab.alias("_l")), "elements")
    at = ordered_positions(rows, group, "_zero", False, order, sums=[(None, "_at")])
    at = cut_lineage(at.select(*group, "_at", "_p", "_l", F.floor((F.col("_at") - 1) / tile).alias("_tile")), "tiles")
    tiles = at.groupBy(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(group)]).agg((F.max("_tile") + 1).alias("_n"))
    same = F.lit(True)
    for k, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    placed = at.join(tiles, same)
    keys = [F.struct(*group).alias("_group")]
    first = placed.select(*keys, F.col("_tile").alias("_a"), F.explode(F.sequence("_tile", F.col("_n") - 1)).alias("_b"), F.col("_at").alias("i"),
                          F.col("_p").alias("pi"), F.col("_l").alias("li"))
    second = placed.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "_tile")).alias("_a"), F.col("_tile").alias("_b"), F.col("_at").alias("j"),
                           F.col("_p").alias("pj"), F.col("_l").alias("lj"))
    null_safe = lambda d: d.withColumn("_group", F.to_json("_group", {"ignoreNullFields": "false"}))
    pairs = null_safe(first).join(null_safe(second), ["_group", "_a", "_b"]).where("i < j")
    x = F.col("pi") - F.col("pj")
    if name == "ranknet":
        t = ((F.col("i") == 1) & (F.col("j") == 2) if label is None else F.col("li") > F.col("lj")).cast("double")
        elem = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    else:
        pairs = pairs.where("li > lj")
        elem = x + (F.col("li") - F.col("lj") - 1) * increment_margin + base_margin
    if reduction == "batchmean":
        # one row per group that has a pair
        return pairs.groupBy("_group").agg(F.sum(elem).alias("_s")).agg((F.sum("_s") / F.count(F.lit(1))).alias("loss"))
    return pairs.agg((F.sum(elem) if reduction == "sum" else F.sum(elem) / F.count(elem)).alias("loss"))


def shared_negative_loss(positives: DataFrame, negatives: DataFrame, name: str, key: str = "qid",
                         pred: str = "s", label: str = "t", temperature: float = 1.0,
                         order: str = "docno") -> DataFrame:
    """Listwise loss where every positive of a query forms a group with *all*
    negatives of that query (F7 groups), without materialising positive x
    negative pairs.

    A group's softmax normaliser is ``exp(x_pos) + sum_neg exp(x_n)``, and the
    group's loss splits into the positive's own term plus sums over the
    query's negatives; those sums are one partial + final aggregate per
    query, joined to the positives. Work is O(#positives + #negatives) and a
    query with a third of all negatives is reduced map-side. Supports
    ``kl_div`` (batchmean over groups), ``listnet`` and ``contrastive`` (mean
    over groups; target = first label maximum, the positive first and the
    negatives in ``order``), ``mse`` (mean over elements).
    """
    if name not in ("kl_div", "listnet", "contrastive", "mse"):
        raise ValueError(f"{name} has no form for shared negatives")
    T = temperature if name != "mse" else 1.0
    P = 1.0 if name == "listnet" else T      # listnet scales the labels alone
    s_n, t_n = F.col(pred).cast("double") / P, F.col(label).cast("double") / T
    mx = negatives.groupBy(key).agg(F.max(s_n).alias("_ms"), F.max(t_n).alias("_mt"))
    agg = negatives.join(mx, key).groupBy(key, "_ms", "_mt").agg(
        F.count(F.lit(1)).alias("_k"),
        F.sum(F.exp(s_n - F.col("_ms"))).alias("_zs"),
        F.sum(F.exp(t_n - F.col("_mt"))).alias("_zt"),
        F.sum(F.exp(t_n - F.col("_mt")) * (t_n - s_n)).alias("_a"),
        F.sum(s_n).alias("_ss"), F.sum(t_n * s_n).alias("_ts"), F.sum(t_n).alias("_tt"),
        F.sum(F.exp(t_n - F.col("_mt")) * s_n).alias("_es"),
        F.sum(F.pow(F.col(pred).cast("double") - F.col(label).cast("double"), 2)).alias("_sq"),
        F.min_by(s_n, F.struct(-t_n, F.col(order))).alias("_s_arg"),
        F.bool_and((F.col(label) >= 0) & (F.col(label) <= 1)).alias("_unit"))
    p = positives.join(agg, key)
    sp, tp = F.col(pred).cast("double") / P, F.col(label).cast("double") / T
    # group normalisers, shifted by the group maximum
    ms = F.greatest(sp, F.col("_ms"))
    mt = F.greatest(tp, F.col("_mt"))
    zs = F.exp(sp - ms) + F.col("_zs") * F.exp(F.col("_ms") - ms)
    zt = F.exp(tp - mt) + F.col("_zt") * F.exp(F.col("_mt") - mt)
    lzs, lzt = ms + F.log(zs), mt + F.log(zt)
    lsm_p = sp - lzs
    if name == "contrastive":
        target = F.when(tp >= F.col("_mt"), sp).otherwise(F.col("_s_arg"))
        per, denom = -(target - lzs), F.count(F.lit(1))
    elif name == "kl_div":
        qp = F.exp(tp - lzt)
        own = F.when(qp == 0, F.lit(0.0)).otherwise(qp * ((tp - lzt) - lsm_p))
        # sum_n q_n (ln q_n - lsm_n) = e^{M_t - lzt} [A + (lzs - lzt) * Z_t]
        neg = F.exp(F.col("_mt") - lzt) * (F.col("_a") + (lzs - lzt) * F.col("_zt"))
        per, denom = own + neg, F.count(F.lit(1))
    elif name == "listnet":
        unit = positives.select(F.bool_and((F.col(label) >= 0) & (F.col(label) <= 1))).scalar()
        p = p.withColumn("_all_unit", F.coalesce(unit, F.lit(True)) & F.coalesce(F.col("_unit"), F.lit(True)))
        all_unit = p.select(F.bool_and("_all_unit")).scalar()
        p = p.withColumn("_u", all_unit)
        raw_lab = F.col(label).cast("double")
        # labels as given: -(l_p lsm_p + sum_n l_n (s_n - lzs))
        as_given = -(raw_lab * lsm_p + F.col("_ts") * T - lzs * F.col("_tt") * T)
        # softmaxed labels q = exp(t - lzt): -(q_p lsm_p + e^{M_t - lzt} (sum_n e^{t_n - M_t} s_n - lzs Z_t))
        soft = -(F.exp(tp - lzt) * lsm_p + F.exp(F.col("_mt") - lzt) * (F.col("_es") - lzs * F.col("_zt")))
        per, denom = F.when(F.col("_u"), as_given).otherwise(soft), F.count(F.lit(1))
    else:  # mse over all elements of all groups
        per = F.pow(F.col(pred).cast("double") - F.col(label).cast("double"), 2) + F.col("_sq")
        denom = F.sum(F.col("_k") + 1)
    return p.agg((F.sum(per) / denom).alias("loss"))
