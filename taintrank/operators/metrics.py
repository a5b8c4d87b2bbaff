"""Ranking metrics for many runs in one plan.

Rules (fixed, documented in the README):
* evaluation order inside a query is score descending, then docno
  descending (the trec_eval rule; a ``rank`` column is ignored);
* unjudged documents are not relevant, negative grades gain 0;
* the mean runs over the judged queries of the qrels: a judged query a run
  misses counts 0, run queries without judgements are ignored.

Plan shape: run LEFT JOIN qrels (broadcast after a size check), written once ->
positions inside (name, qid) (range partitions by default, see
``rank.ordered_positions``; or one window) -> one aggregate per (name, qid)
-> onto (every run name) x (per-query qrels statistics), so a judged query that a run misses has
its row of zeros -> a tiny aggregate per run.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import broadcast_if_small
from .rank import ordered_positions, running_count

_MEASURE_RE = re.compile(r"^(AP|nDCG|R|P|RR)(?:\(rel=(\d+)\))?(?:@(\d+))?$")
_REL_MEASURES = {"AP", "R", "P", "RR"}


@dataclass(frozen=True)
class Measure:
    name: str
    rel: int = 1
    cutoff: int | None = None

    def __post_init__(self):
        if self.name not in {"AP", "nDCG", "R", "P", "RR"}:
            raise ValueError(f"unknown measure {self.name}")
        if self.cutoff is not None and self.cutoff < 1:
            raise ValueError("cutoff must be >= 1")

    @property
    def label(self) -> str:
        s = self.name
        if self.name in _REL_MEASURES:
            s += f"(rel={self.rel})"
        if self.cutoff is not None:
            s += f"@{self.cutoff}"
        return s

    @property
    def column(self) -> str:
        s = self.name.lower()
        if self.name in _REL_MEASURES and self.rel != 1:
            s += f"_rel{self.rel}"
        if self.cutoff is not None:
            s += f"_at_{self.cutoff}"
        return s


def parse_measure(text: str) -> Measure:
    """M6: ``name[(rel=n)][@k]``; anything else raises ``ValueError``."""
    m = _MEASURE_RE.match(text.strip())
    if not m:
        raise ValueError(f"cannot parse measure {text!r}")
    name, rel, cut = m.group(1), m.group(2), m.group(3)
    if rel is not None and name not in _REL_MEASURES:
        raise ValueError(f"{name} takes no rel parameter")
    return Measure(name, int(rel) if rel is not None else 1, int(cut) if cut is not None else None)


# The reference's default measure list, in its order.
DEFAULT_MEASURES = tuple(parse_measure(s) for s in (
    "AP(rel=1)", "nDCG@10", "nDCG@5", "nDCG@1", "R(rel=1)@100", "R(rel=1)@1000",
    "P(rel=1)@10", "RR(rel=1)", "RR(rel=1)@10"))


def _measures(measures: Iterable) -> list[Measure]:
    out = [parse_measure(m) if isinstance(m, str) else m for m in measures]
    if not out:
        raise ValueError("no measures given")
    return out


def _within(pos: Column, cutoff: int | None) -> Column:
    return F.lit(True) if cutoff is None else (pos <= cutoff)


_BLOCK = 1 << 16


def qrels_stats(qrels: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Per judged query: #relevant per rel level and ideal DCG per cutoff.

    The ideal ranking is known from the number of judgements per grade: a grade takes the positions after those of
    the higher grades. Positions are summed in blocks, so no query's judgements are sorted or listed.
    """
    grade = qrels.groupBy("qid", F.col("relevance").cast("int").alias("relevance")).agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy("qid").orderBy(F.col("relevance").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    grade = grade.withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0).cast("long")))
    cutoffs = [m.cutoff for m in measures if m.name == "nDCG"]
    deepest = F.col("n") if None in cutoffs else F.least("n", F.greatest(F.lit(max(cutoffs, default=0)) - F.col("before"), F.lit(0)))
    last = F.expr(f"cast((greatest(_deep, 1) - 1) div {_BLOCK} as bigint)")
    grade = grade.withColumn("_deep", deepest).withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    gain = F.greatest(F.col("relevance"), F.lit(0)).cast("double")
    aggs = {}
    for m in measures:
        if m.name in _REL_MEASURES:
            aggs[f"_R{m.rel}"] = F.sum(F.when((F.col("relevance") >= m.rel) & (F.col("_b") == 0), F.col("n")).otherwise(0))
        if m.name == "nDCG":
            lo = F.col("before") + F.col("_b") * _BLOCK + 1
            hi = F.least(F.col("before") + F.col("n"), lo + (_BLOCK - 1), *([F.lit(m.cutoff).cast("long")] if m.cutoff else []))
            discount = F.when((hi >= lo) & (gain > 0), F.aggregate(
                F.sequence(lo, F.greatest(hi, lo)), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1))).otherwise(0.0)
            aggs[f"_I{m.cutoff}"] = F.sum(gain * discount)
    aggs.setdefault("_judged", F.sum(F.when(F.col("_b") == 0, F.col("n")).otherwise(0)))
    return grade.groupBy("qid").agg(*[v.alias(k) for k, v in aggs.items()])


def per_query(run: DataFrame, qrels: DataFrame, measures: Iterable = DEFAULT_MEASURES,
              by: Sequence[str] = ("name",), skew_safe: bool = True,
              partitions: int | None = None) -> DataFrame:
    """G7 long-form source: one row per (run, judged query) with a column per measure.

    ``skew_safe`` numbers the ranking with :func:`rank.ordered_positions`
    (range partitioning splits a query holding a large share of the run over
    several tasks) instead of one window per (run, query); the window
    is cheaper when run depth is bounded, as it is after a top-k retriever.
    """
    ms = _measures(measures)
    if "name" in by and "name" not in run.columns:
        run = run.withColumn("name", F.lit("run"))
    keys = list(by) + ["qid"]
    # Judgements are small next to runs: broadcast them after measuring them so
    # the run is not shuffled for the join (beyond the bound: a shuffle join).
    qr = broadcast_if_small(qrels.select("qid", "docno", F.col("relevance").cast("int").alias("relevance")))
    judged = run.select(*keys, "docno", F.col("score").cast("double").alias("score")).join(
        qr, ["qid", "docno"], "left")
    order = [F.col("score").desc(), F.col("docno").desc()]
    rel_levels = sorted({m.rel for m in ms if m.name == "AP"})
    for r in rel_levels:
        judged = judged.withColumn(f"_f{r}", F.coalesce(F.col("relevance") >= r, F.lit(False)).cast("long"))
    # The ranking and the run names both read the judged run: write it
    # once (the run may come from an expensive retriever) and read it back.
    judged = cut_lineage(judged, "judged_run")
    names = judged.agg(F.collect_set(F.struct(*by))).scalar()      # one entry per run
    if skew_safe:
        judged = ordered_positions(judged, keys, "score", descending=True, tie_order=[F.col("docno").desc()],
                                   sums=[(None, "pos")] + [(f"_f{r}", f"_cr{r}") for r in rel_levels],
                                   partitions=partitions)
    else:
        w = Window.partitionBy(*keys).orderBy(*order)
        judged = judged.withColumn("pos", F.row_number().over(w))
        for r in rel_levels:
            judged = judged.withColumn(
                f"_cr{r}", running_count(F.coalesce(F.col("relevance") >= r, F.lit(False)), w))
    pos = F.col("pos")
    grade = F.coalesce(F.col("relevance"), F.lit(0))
    gain = F.greatest(grade, F.lit(0)).cast("double")

    aggs = {}
    for m in ms:
        is_rel = grade >= m.rel
        inside = _within(pos, m.cutoff)
        if m.name == "AP":
            aggs[m.column] = F.sum(F.when(is_rel & inside, F.col(f"_cr{m.rel}") / pos).otherwise(0.0))
        elif m.name == "nDCG":
            aggs[m.column] = F.sum(F.when(inside, gain / F.log2(pos + 1)).otherwise(0.0))
        elif m.name in ("R", "P"):
            aggs[m.column] = F.sum(F.when(is_rel & inside, 1).otherwise(0)).cast("double")
            if m.name == "P" and m.cutoff is None:
                aggs["_retrieved"] = F.count(F.lit(1)).cast("double")
        elif m.name == "RR":
            aggs[m.column] = F.min(F.when(is_rel & inside, pos))
    per = judged.groupBy(*keys).agg(*[v.alias(k) for k, v in aggs.items()])

    judged_in = qrels_stats(qrels, ms).withColumn("_name", F.explode(names))
    judged_in = judged_in.select("*", *[F.col(f"_name.{c}").alias(f"_n_{c}") for c in by]).drop("_name").withColumnRenamed("qid", "_qid")
    same = F.col("qid") == F.col("_qid")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    per = judged_in.join(per, same, "left").drop("qid", *by).withColumnsRenamed({"_qid": "qid", **{f"_n_{c}": c for c in by}})
    out = []
    for m in ms:
        c = F.col(m.column)
        if m.name in ("AP", "R"):
            v = F.coalesce(F.try_divide(c, F.col(f"_R{m.rel}").cast("double")), F.lit(0.0))
        elif m.name == "nDCG":
            v = F.coalesce(F.try_divide(c, F.col(f"_I{m.cutoff}")), F.lit(0.0))
        elif m.name == "P":
            v = F.coalesce(F.try_divide(c, F.lit(float(m.cutoff)) if m.cutoff is not None else F.col("_retrieved")), F.lit(0.0))
        else:
            v = F.coalesce(F.lit(1.0) / c, F.lit(0.0))
        out.append(v.cast("double").alias(m.column))
    return per.select(*keys, *out)


def evaluate(run: DataFrame, qrels: DataFrame, measures: Iterable = DEFAULT_MEASURES,
             by: Sequence[str] = ("name",), skew_safe: bool = True,
             partitions: int | None = None) -> DataFrame:
    """M7: wide table, one row per run, mean of every measure over judged queries."""
    ms = _measures(measures)
    pq = per_query(run, qrels, ms, by, skew_safe, partitions)
    return pq.groupBy(*by).agg(*[F.avg(m.column).alias(m.column) for m in ms])


def to_long(per_query_df: DataFrame, measures: Iterable = DEFAULT_MEASURES,
            by: Sequence[str] = ("name",)) -> DataFrame:
    """``name, query_id, metric, value`` records (measure labels as text)."""
    ms = _measures(measures)
    return per_query_df.unpivot(
        [*by, "qid"], [m.column for m in ms], "metric", "value").select(
        *by, F.col("qid").alias("query_id"),
        F.create_map(*[x for m in ms for x in (F.lit(m.column), F.lit(m.label))])[F.col("metric")].alias("metric"),
        "value")


def with_measure_labels(wide: DataFrame, measures: Iterable = DEFAULT_MEASURES) -> DataFrame:
    """S15 column names (``AP(rel=1)``, ``nDCG@10`` ...) in a fixed order, ``name`` last."""
    ms = _measures(measures)
    return wide.select(*[F.col(m.column).alias(m.label) for m in ms], "name")
