"""Tables behind the reference's distribution plots.

Drawing is out of scope; each function returns the numbers a plot shows.
Nothing gathers a group's raw values: histograms and KDE use bin counts,
quantiles use a distributed bucket refinement, ECDF a range-partitioned
prefix sum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import broadcast_if_small
from .rank import ecdf_skew_safe

# seaborn's KDE defaults (grid points, cut in bandwidths).
KDE_GRID = 200
KDE_CUT = 3.0


def histogram(df: DataFrame, value: str = "score", by: str = "model_type",
              bins: int | None = None) -> DataFrame:
    """B1: shared equal-width bins over all groups, counts per (bin, group).

    ``bins`` defaults to Sturges' rule ``ceil(log2 n) + 1`` on all rows.
    """
    v = F.col(value)
    st = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"))
    lo, hi, n = (st.select(c).scalar() for c in ("lo", "hi", "n"))
    nb = F.lit(bins) if bins else (F.ceil(F.log2(n)) + 1).cast("long")
    width = (hi - lo) / nb
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((v - lo) / width), nb - 1)).cast("long")
    return (df.where(v.isNotNull()).groupBy(idx.alias("bin"), F.col(by))
            .agg(F.count(F.lit(1)).alias("count"))
            .select("bin", by, (lo + F.col("bin") * width).alias("bin_lo"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_hi"), "count"))


def exact_quantiles(df: DataFrame, value: str = "score", by: Sequence[str] = ("model_type",),
                    probs: Sequence[float] = (0.25, 0.5, 0.75), buckets: int = 1 << 16,
                    last: int = 100_000) -> DataFrame:
    """Exact linear-interpolated quantiles per group, fully distributed.

    Each needed order statistic (ranks floor/ceil of p (n-1)) is a row of a
    small *target* table holding its current value interval. A round joins
    the data to the targets, counts values in ``buckets`` equal-width buckets
    of each interval (one aggregate), and a window over those counts keeps
    the bucket that holds the rank. An interval of one value is the answer, however many
    rows share it. Rounds go on until every other interval holds ``last`` rows at
    most (each round splits its smallest from its largest value); those rows
    are numbered by a window to pick the exact value. No
    group's values are gathered into one task or onto the driver.
    Returns ``by..., p, q``.
    """
    by = list(by)
    v = F.col(value).cast("double")
    base = df.where(F.col(value).isNotNull()).select(*by, v.alias("_v"))
    st = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ps = F.array(*[F.lit(float(p)) for p in probs])
    wanted = st.select(*by, "_n", "_lo", "_hi", F.explode(ps).alias("p")).withColumn(
        "_h", F.col("p") * (F.col("_n") - 1))
    ranks = wanted.select(*by, "_lo", "_hi", F.explode(F.array_distinct(F.array(
        F.floor("_h").cast("long"), F.ceil("_h").cast("long")))).alias("_r")).distinct()
    # The target table is re-read from a written table each round: its file
    # statistics let the planner broadcast it when (and only when) it is small.
    state = cut_lineage(ranks.select(*by, "_r", "_lo", "_hi", F.lit(0).cast("long").alias("_base")),
                        "quantile_targets")
    while True:
        inside = base.join(state, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        width = (F.col("_hi") - F.col("_lo")) / buckets
        bucket = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
            F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).cast("long")
        counts = inside.groupBy(*by, "_r", "_base", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
        w = Window.partitionBy(*by, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("_cum", F.sum("_c").over(w))
        pos = F.col("_r") - F.col("_base")
        state = counts.where((pos < F.col("_cum")) & (pos >= F.col("_cum") - F.col("_c"))).select(
            *by, "_r", F.col("_mn").alias("_lo"), F.col("_mx").alias("_hi"),
            (F.col("_base") + F.col("_cum") - F.col("_c")).alias("_base"), "_c")
        state = cut_lineage(state, "quantile_targets")  # a few rows per group; keeps rounds independent
        wide = state.where((F.col("_lo") != F.col("_hi")) & (F.col("_c") > last))
        if wide.isEmpty():
            break
        state = state.drop("_c")
    # an interval of one value is the answer; in the others at most ``last`` rows are numbered
    closed = state.where(F.col("_lo") == F.col("_hi")).select(*by, "_r", F.col("_lo").alias("_x"))
    inside = base.join(state.where(F.col("_lo") != F.col("_hi")), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    w = Window.partitionBy(*by, "_r").orderBy("_v")
    picked = closed.unionByName(inside.withColumn("_k", F.row_number().over(w) - 1)
                                .where(F.col("_k") == F.col("_r") - F.col("_base")).select(*by, "_r", F.col("_v").alias("_x")))
    lo = picked.select(*by, F.col("_r").alias("_rl"), F.col("_x").alias("_a"))
    hi = picked.select(*by, F.col("_r").alias("_rh"), F.col("_x").alias("_b"))
    out = (wanted.select(*by, "p", "_h", F.floor("_h").cast("long").alias("_rl"), F.ceil("_h").cast("long").alias("_rh"))
           .join(lo, [*by, "_rl"]).join(hi, [*by, "_rh"]))
    return out.select(*by, "p", (F.col("_a") + (F.col("_h") - F.col("_rl")) * (F.col("_b") - F.col("_a"))).alias("q"))


def box_stats(df: DataFrame, value: str = "score", by: str = "model_type",
              whisker: float = 1.5) -> DataFrame:
    """B2: q1, median, q3, whiskers (last value within 1.5 IQR) and outlier count."""
    q = exact_quantiles(df, value, [by], (0.25, 0.5, 0.75))
    wide = q.groupBy(by).pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q")).toDF(by, "q1", "median", "q3")
    v = F.col(value)
    j = df.join(broadcast_if_small(wide), by)  # one row per group
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whisker * iqr, F.col("q3") + whisker * iqr
    return j.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(v >= lo_f, v)).alias("whisker_lo"),
        F.max(F.when(v <= hi_f, v)).alias("whisker_hi"),
        F.count_if((v < lo_f) | (v > hi_f)).alias("n_outliers"))


def kde(df: DataFrame, value: str = "score", by: str = "model_type", grid: int = KDE_GRID,
        bins: int = 1024, cut: float = KDE_CUT) -> DataFrame:
    """Gaussian KDE per group on a fixed grid, each group normalised by itself.

    Bandwidth is Scott's rule ``sd * n^(-1/5)``; the grid runs from
    ``min - cut*bw`` to ``max + cut*bw``. Values are pre-binned into
    ``bins`` equal-width bins per group first, so the kernel sum runs over
    at most ``bins`` centres per grid point, never over raw rows. A value moves by half a bin at most, so a
    density is off by at most ``(hi - lo) / (2 bins) * max|K'| / bw^2 = 0.242 (hi - lo) / (2 bins bw^2)``.
    """
    v = F.col(value).cast("double")
    st = df.groupBy(by).agg(F.count(v).alias("n"), F.stddev_samp(v).alias("sd"),
                            F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide(v - F.col("lo"), width)), F.lit(bins - 1))).cast("long")
    binned = (df.where(F.col(value).isNotNull()).join(broadcast_if_small(st), by)
              .groupBy(by, idx.alias("b"), "n", "sd", "lo", "hi")
              .agg(F.count(F.lit(1)).alias("c"))
              .withColumn("x", F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins))
    per = binned.groupBy(by, "n", "sd", "lo", "hi").agg(
        F.collect_list(F.struct("x", "c")).alias("centres"))  # <= bins entries per group
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    start = F.col("lo") - cut * bw
    step = (F.col("hi") - F.col("lo") + 2 * cut * bw) / (grid - 1)
    norm = F.col("n") * bw * F.lit(math.sqrt(2 * math.pi))
    pts = per.select(by, bw.alias("bw"), start.alias("start"), step.alias("step"), norm.alias("norm"),
                     "centres", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    gx = F.col("start") + F.col("i") * F.col("step")
    # a constant group has no bandwidth: its density is null
    dens = F.try_divide(F.aggregate("centres", F.lit(0.0), lambda acc, c: acc + c["c"] * F.exp(
        F.lit(-0.5) * F.pow(F.try_divide(gx - c["x"], F.col("bw")), 2))), F.col("norm"))
    return pts.select(by, "i", gx.alias("x"), dens.alias("density"))


def ecdf(df: DataFrame, value: str = "score", by: str = "model_type") -> DataFrame:
    """ECDF points per group (distinct values with cumulative share)."""
    return ecdf_skew_safe(df, value, [by])
