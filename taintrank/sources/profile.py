"""S17 source preview: counts, columns and a few rows in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, distinct: Sequence[str] = ()) -> DataFrame:
    """One row: ``n_rows`` and ``n_distinct_<col>`` for the given columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  *[F.count_distinct(c).alias(f"n_distinct_{c}") for c in distinct])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows (a bounded preview, the feature itself)."""
    return df.limit(n)
