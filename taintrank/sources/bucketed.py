"""Texts and vectors as bucketed tables (J3, J4, J8): the large side of a join by id is never shuffled.

:func:`write_bucketed` hashes a table by its id into files once; every later join or grouping on that id reads the buckets in place, and
only the other side (pairs, scores) is dealt to them. Two tables with the same number of buckets
meet without any exchange. The number of buckets is the number of tasks of such a join: size it so that a bucket is
a few hundred megabytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BYTES = 256 << 20


def bucket_count(n_bytes: int, at_least: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets of about ``bucket_bytes`` each, at least as many as a shuffle has partitions (fewer would be shuffled after all)."""
    return max(at_least, -(-n_bytes // bucket_bytes), 1)


def write_bucketed(df: DataFrame, name: str, key: str, path: str, buckets: int) -> DataFrame:
    """Write ``df`` as the table ``name`` under ``path``, one sorted file per bucket of ``key``; returns the table.

    Rows keep their copies; a null key is a bucket like any other. The table replaces one of the same name.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    # the same hash deals the rows and numbers the buckets: each task holds one bucket and writes one file
    (df.repartition(buckets, F.col(key)).write.mode("overwrite").format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)
