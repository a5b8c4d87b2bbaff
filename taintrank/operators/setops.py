"""Set operations (U1-U4). U1 (triples + leaked triples) is
``plans.contaminate.contaminate``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_samples(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (score samples of several models)."""
    if not frames:
        raise ValueError("nothing to append")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def merge_lookups(sources: Sequence[DataFrame], key: str = "id", value: str = "text") -> DataFrame:
    """Union of lookups; on an equal key the *last* source wins.

    One aggregate with ``max_by(value, priority)``: partial aggregation
    keeps one row per key per map task, so a repeated key never piles up.
    """
    if not sources:
        raise ValueError("no lookup given")
    tagged = [s.select(key, value, F.lit(i).alias("_prio")) for i, s in enumerate(sources)]
    return append_samples(*tagged).groupBy(key).agg(F.max_by(value, "_prio").alias(value))


def distinct_ids(df: DataFrame, col: str) -> DataFrame:
    """U4."""
    return df.select(col).distinct()
