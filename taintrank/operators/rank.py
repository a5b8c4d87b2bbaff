"""Ranking windows.

One explicit order is used for every ranking so results never depend on
input order: score descending, then the tie keys (first-stage rank if the
frame has one, else docno ascending).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

DEFAULT_BUDGET = 100


def rank_order(df: DataFrame, score: str = "score", tie_keys: Sequence[str] | None = None) -> list[Column]:
    if tie_keys is None:
        tie_keys = ["first_rank", "docno"] if "first_rank" in df.columns else ["docno"]
    return [F.col(score).desc()] + [F.col(k).asc() for k in tie_keys]


def add_ranks(df: DataFrame, by: Sequence[str] = ("qid",), score: str = "score",
              tie_keys: Sequence[str] | None = None, skew_safe: bool = False) -> DataFrame:
    """0-based rank within ``by`` by score descending.

    The plain form is one window per group, right for runs of bounded depth
    (re-ranked top-k lists). ``skew_safe`` numbers unbounded groups through
    :func:`ordered_positions` so a hot group, or a hot tie, is split over range partitions.
    """
    order = rank_order(df, score, tie_keys)
    if skew_safe:
        pos = ordered_positions(df, by, score, descending=True, tie_order=order[1:], sums=[(None, "_pos")])
        return pos.withColumn("rank", (F.col("_pos") - 1).cast("int")).drop("_pos")
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("int"))


def top_k(df: DataFrame, k: int = DEFAULT_BUDGET, by: Sequence[str] = ("qid",), score: str = "score",
          tie_keys: Sequence[str] | None = None) -> DataFrame:
    """W3 (+W1): keep the best ``k`` per group and number them from 0.

    The filter is on ``row_number() <= k`` *before* the ``-1`` so Catalyst
    plans a ``WindowGroupLimit``: every map task trims its groups to k rows
    before the shuffle, which also caps what a hot query ships.
    """
    w = Window.partitionBy(*by).orderBy(*rank_order(df, score, tie_keys))
    return (df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .withColumn("rank", (F.col("_rn") - 1).cast("int")).drop("_rn"))


def sort_run(df: DataFrame) -> DataFrame:
    """Sink order (lexical qid, rank); use only right before writing."""
    return df.orderBy(F.col("qid").asc(), F.col("rank").asc())


def ideal_positions(qrels: DataFrame) -> DataFrame:
    """Position (1-based) of each judgement in the ideal ranking."""
    pos = ordered_positions(qrels, ["qid"], "relevance", True, [F.col("docno").asc()], sums=[(None, "ipos")])
    return pos.withColumn("ipos", F.col("ipos").cast("int"))


def running_count(flag: Column, order: Window) -> Column:
    """Running count of ``flag`` up to the current row."""
    return F.sum(flag.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def range_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``df`` written once in range partitions over (``by``, ``order``), with their number in ``_part``.

    The bounds come from a sample of the whole sort key, tie keys included, so neither a hot group, an
    outlier nor a value that a whole group shares fills one partition.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by], *order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()), "range_parts")


def ordered_positions(df: DataFrame, by: Sequence[str], value: str, descending: bool,
                      tie_order: Sequence[Column] = (), sums: Sequence[tuple[str | None, str]] = ((None, "pos"),),
                      partitions: int | None = None) -> DataFrame:
    """Running counts / running sums inside ``by`` ordered by a numeric ``value``
    (then ``tie_order``, which must make the order total).

    Equivalent to ``sum(weight)`` over ``partitionBy(by).orderBy(value, *tie_order)``
    with an unbounded-preceding frame (``weight`` None counts rows, i.e.
    ``row_number()``), by one plan for every size: the rows are range-partitioned by the whole sort key
    (:func:`range_parts`), each (group, partition) runs its own window, and a
    table with one row per (group, partition) carries the offsets. Null group keys are a group. ``df`` is read twice (the sample and the
    partitioning), so pass a table, not an expensive plan.
    """
    v = F.col(value).cast("double")
    order = [v.desc() if descending else v.asc(), *tie_order]
    by = list(by)
    weighted = df.withColumns({f"_w{k}": F.lit(1).cast("long") if w is None else F.col(w) for k, (w, _) in enumerate(sums)})
    parts = range_parts(weighted, by, order, partitions)
    local = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = parts.groupBy(*by, "_part").agg(*[F.sum(f"_w{k}").alias(f"_t{k}") for k in range(len(sums))])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_part").alias("_at"), *[
        F.coalesce(F.sum(f"_t{k}").over(before), F.lit(0)).alias(f"_o{k}") for k in range(len(sums))])
    same = F.col("_part") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    running = parts.withColumns({f"_l{k}": F.sum(f"_w{k}").over(local) for k in range(len(sums))})
    res = running.join(offsets, same)
    return res.select(*df.columns, *[(F.col(f"_l{k}") + F.col(f"_o{k}")).alias(o) for k, (_, o) in enumerate(sums)])


def ecdf_skew_safe(df: DataFrame, value: str = "score", by: Sequence[str] = ("model_type",)) -> DataFrame:
    """W4 / B4 without a per-group sort: counts per distinct value (written once), then
    :func:`ordered_positions` for the running count and a group total."""
    by = list(by)
    counts = cut_lineage(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), "ecdf_counts")
    totals = counts.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]).agg(F.sum("n").alias("_tot"))
    run = ordered_positions(counts, by, value, descending=False, sums=[("n", "_cum")])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return run.join(totals, same).select(*by, value, "n", (F.col("_cum") / F.col("_tot")).alias("cdf"))
