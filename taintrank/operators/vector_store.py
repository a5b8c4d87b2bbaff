"""Vectors kept by content: a text is encoded once, over all runs (K4, K5, K12 as a store).

A store is a parquet table ``h1, h2, vec`` under a path that the caller names (one per model). A text is known by two 64-bit hashes, not by an
id: a changed text is encoded anew, two texts under one id get two vectors, copies share one.
:meth:`VectorStore.add` encodes only what the store lacks and appends it in waves; Spark's writer commits a
wave as a whole or leaves only files that are never read or hold finished vectors, so a job that was lost goes on where it
stopped. If two writers add the same text at the same time, it is there twice and read once.

Null texts are read as empty. Stored text is never moved again: a run shuffles hashes and what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scoring

SCHEMA = "h1 long, h2 long, vec array<double>"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def size(self) -> int:
        """Stored rows, from the file footers."""
        return self.spark.read.schema(SCHEMA).parquet(self.path).count() if self._exists() else 0

    def vectors(self) -> DataFrame:
        """``h1, h2, vec``, one row per text."""
        if not self._exists():
            return self.spark.createDataFrame([], SCHEMA)
        stored = self.spark.read.schema(SCHEMA).parquet(self.path)
        return stored.groupBy("h1", "h2").agg(F.any_value("vec").alias("vec"))

    def _hashed(self, df: DataFrame, text: str) -> DataFrame:
        t = F.coalesce(F.col(text), F.lit(""))
        return df.withColumns({"h1": F.xxhash64(t), "h2": F.xxhash64(t, F.lit(1))})

    def missing(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``h1, h2, text``: the distinct texts of ``df`` that have no vector yet."""
        wanted = self._hashed(df.select(F.coalesce(F.col(text), F.lit("")).alias("text")), "text").select("h1", "h2", "text")
        known = self.spark.read.schema(SCHEMA).parquet(self.path).select("h1", "h2") if self._exists() else None
        new = wanted if known is None else wanted.join(known, ["h1", "h2"], "left_anti")
        return new.dropDuplicates(["h1", "h2"])

    def add(self, df: DataFrame, factory: Callable, text: str = "text", batch_size: int = scoring.DEFAULT_BATCH, waves: int = 1) -> int:
        """Encode and append what is missing; returns how many texts were encoded.

        ``waves`` jobs take a share of the texts each, by hash: what a lost job loses is one wave.
        """
        if waves < 1:
            raise ValueError("waves must be >= 1")
        before = self.size()
        for k in range(waves):
            part = self._hashed(df.select(F.col(text).alias("text")), "text").where(F.pmod("h2", F.lit(waves)) == k).select("text")
            made = scoring.encode(self.missing(part), factory, "text", "vec", batch_size).select("h1", "h2", "vec")
            made.write.mode("append").parquet(self.path)
        return self.size() - before

    def attach(self, df: DataFrame, text: str = "text", out: str = "vec") -> DataFrame:
        """``df`` with the vector of each row's text; null where :meth:`add` has not seen it."""
        keys = self._hashed(df.select(text), text).columns[-2:]
        clash = [c for c in keys if c in df.columns]
        if clash:
            raise ValueError(f"columns {clash} are taken")
        return self._hashed(df, text).join(self.vectors().withColumnRenamed("vec", out), list(keys), "left").drop(*keys)
