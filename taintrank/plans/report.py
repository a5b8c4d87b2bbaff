"""T5: clean vs contaminated report in one plan per table.

* ranking metrics of every (name, arm) run (M7) plus a ``delta`` row
  (clean - contaminated) per name;
* KL(student || teacher) per arm (G5) and score moments per arm (G3).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, metrics

CLEAN, CONTAMINATED = "clean", "contaminated"


def metric_report(runs: DataFrame, qrels: DataFrame, measures=metrics.DEFAULT_MEASURES) -> DataFrame:
    """``runs[name, arm, qid, docno, score]`` -> wide metrics per (name, arm) + delta rows."""
    ms = [metrics.parse_measure(m) if isinstance(m, str) else m for m in measures]
    wide = metrics.evaluate(runs, qrels, ms, by=("name", "arm"))
    cols = [m.column for m in ms]
    delta = wide.groupBy("name").agg(*[
        (F.max(F.when(F.col("arm") == CLEAN, F.col(c)))
         - F.max(F.when(F.col("arm") == CONTAMINATED, F.col(c)))).alias(c) for c in cols]
    ).withColumn("arm", F.lit("delta"))
    return wide.unionByName(delta)


def kl_report(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """``student/teacher[arm, qid, docno, score]`` -> per arm KL, matched, skipped."""
    return compare.kl_divergence(student, teacher, by=("arm",))


def arm_statistics(runs: DataFrame) -> DataFrame:
    """``runs[name, arm, qid, docno, score]`` -> per arm KL (student against teacher), teacher moments, and the pooled
    t-test of the teacher scores, clean against contaminated (the same ``t`` and ``p`` in both rows)."""
    teacher, student = runs.where("name = 'teacher'"), runs.where("name = 'student'")
    test = compare.t_test_table(teacher, CLEAN, CONTAMINATED, by="arm", p_value=True)
    one = test.select(F.struct("t", "p")).scalar()
    out = kl_report(student, teacher).join(moment_report(teacher), "arm").withColumn("_test", one)
    return out.select("*", "_test.t", "_test.p").drop("_test")


def moment_report(scores: DataFrame) -> DataFrame:
    """``scores[arm, score]`` -> G3 moments per arm."""
    return compare.moments(scores, by=("arm",))
