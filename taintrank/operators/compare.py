"""Clean-vs-contaminated comparisons over score tables.

All statistics are single aggregates (partial + final), so a model type or
query holding a third of the rows is summed map-side first and never
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import pooled_t, t_two_sided_p
from .joins import match_scores

# Probability clip of the reference's KL computation.
KL_CLIP_LOW = 1e-10
KL_CLIP_HIGH = 1.0


def score_summary(scores: DataFrame) -> DataFrame:
    """Number of queries and of distinct documents over all queries."""
    return scores.agg(F.count_distinct("qid").alias("n_queries"),
                      F.count_distinct("docno").alias("n_docs"))


def moments(df: DataFrame, by: Sequence[str] = ("model_type",), value: str = "score") -> DataFrame:
    """Mean, sample variance, skewness (biased) and excess kurtosis (biased)."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"),
                               F.var_samp(v).alias("variance"), F.skewness(v).alias("skewness"),
                               F.kurtosis(v).alias("kurtosis"))


def t_test_table(df: DataFrame, first: str, second: str, by: str = "model_type",
                 value: str = "score", p_value: bool = False) -> DataFrame:
    """G4 (distributed part): pooled two-sample t statistic, ``first - second``.

    One aggregate computes n, mean and variance of both groups; the t value
    is a column expression on that one row. Degrees of freedom are returned
    so the p-value can be evaluated (see :func:`t_test`); ``p_value`` adds it as a column of that one
    row. Two constant groups have t infinite (or null if their means agree) and p 0, as in ``pooled_t``.
    """
    v = F.col(value)
    a, b = F.col(by) == first, F.col(by) == second
    agg = df.agg(
        F.count(F.when(a, v)).alias("n1"), F.avg(F.when(a, v)).alias("m1"),
        F.var_samp(F.when(a, v)).alias("v1"),
        F.count(F.when(b, v)).alias("n2"), F.avg(F.when(b, v)).alias("m2"),
        F.var_samp(F.when(b, v)).alias("v2"))
    dof = F.col("n1") + F.col("n2") - 2
    sp2 = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), dof.cast("double"))
    gap = F.col("m1") - F.col("m2")
    each = F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))
    t = F.coalesce(F.try_divide(gap, F.sqrt(sp2 * each)), F.when((sp2 == 0) & (gap != 0), F.signum(gap) * F.lit(float("inf"))))
    out = agg.select("n1", "n2", "m1", "m2", dof.alias("dof"), t.alias("t"))
    if p_value:
        p = F.udf(lambda t, dof: None if t is None or dof is None or dof <= 0 else t_two_sided_p(t, dof), "double")
        out = out.withColumn("p", p("t", "dof"))       # one row
    return out


def t_test(df: DataFrame, first: str, second: str, by: str = "model_type",
           value: str = "score") -> tuple[float, float]:
    """(t, two-sided p) of ``ttest_ind(first, second)`` with pooled variance."""
    v = F.col(value)
    a, b = F.col(by) == first, F.col(by) == second
    r = df.agg(F.count(F.when(a, v)), F.avg(F.when(a, v)), F.var_samp(F.when(a, v)),
               F.count(F.when(b, v)), F.avg(F.when(b, v)), F.var_samp(F.when(b, v))).first()
    return pooled_t(*[float(x) if x is not None else float("nan") for x in r])


def kl_per_query(student: DataFrame, teacher: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G5/G6 per query: ``qid, n_docs, s_sum, t_sum, kl`` (kl null when skipped).

    Both sides are normalised by their sum over the matched documents, the
    query is skipped if a sum is 0, probabilities are clipped to
    [1e-10, 1], and KL = sum s ln(s/t). The per-query sums are a partial +
    final aggregate joined back on qid (one row per query, so AQE can
    broadcast it), then a second aggregate adds the terms: a query holding
    a third of all pairs is never sorted or buffered in one task.
    """
    m = match_scores(student, teacher, by)
    keys = [*by, "qid"]
    sums = m.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("s").alias("s_sum"),
                                F.sum("t").alias("t_sum"))
    m = m.join(sums, keys)
    ok = (F.col("s_sum") != 0) & (F.col("t_sum") != 0)
    clip = lambda c: F.least(F.greatest(c, F.lit(KL_CLIP_LOW)), F.lit(KL_CLIP_HIGH))
    p = clip(F.try_divide(F.col("s"), F.col("s_sum")))
    q = clip(F.try_divide(F.col("t"), F.col("t_sum")))
    term = F.when(ok, p * F.log(p / q))
    return m.groupBy(*keys, "n_docs", "s_sum", "t_sum").agg(F.sum(term).alias("kl"))


def kl_divergence(student: DataFrame, teacher: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """G5 + G6: ``kl, n_matched, n_skipped`` (per ``by``; kl null -> no matched query)."""
    per = kl_per_query(student, teacher, by)
    skipped = (F.col("s_sum") == 0) | (F.col("t_sum") == 0)
    return per.groupBy(*by).agg(F.avg(F.when(~skipped, F.col("kl"))).alias("kl"),
                   F.count_if(~skipped).alias("n_matched"),
                   F.count_if(skipped).alias("n_skipped"))


def skipped_queries(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """The zero-sum queries the KL mean leaves out."""
    per = kl_per_query(student, teacher)
    return per.where((F.col("s_sum") == 0) | (F.col("t_sum") == 0)).select("qid", "s_sum", "t_sum")
