"""TREC runs and metric tables.

A directory of runs is read by *one* scan (``pathGlobFilter``), with the
run name taken from each file's name, so every run shares one plan (M7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import DEFAULT_MEASURES, with_measure_labels

RUN_SCHEMA = "qid string, iter string, docno string, rank int, score double, tag string"


def read_run(spark: SparkSession, path: str, name_from_file: bool = False,
             glob: str | None = "*.trec") -> DataFrame:
    """``qid Q0 docno rank score tag`` lines from the files matching
    ``glob`` (``None`` reads every file, e.g. one run file with another suffix).

    With ``name_from_file`` a ``name`` column holds the file name without the
    ``.trec`` suffix (only the suffix is removed).
    """
    r = spark.read.option("sep", " ").schema(RUN_SCHEMA)
    if glob:
        r = r.option("pathGlobFilter", glob)
    df = r.csv(path)
    if name_from_file:
        df = df.withColumn("name", F.regexp_replace(F.col("_metadata.file_name"), r"\.trec$", ""))
    return df


def format_run(run: DataFrame, tag: str = "taintrank") -> DataFrame:
    """S13 line text: ``qid Q0 docno rank score tag`` (rank as given, 0-based)."""
    return run.select(F.concat_ws(" ", F.col("qid"), F.lit("Q0"), F.col("docno"),
                                  F.col("rank").cast("string"), F.col("score").cast("string"),
                                  F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "taintrank", overwrite: bool = True,
              sort: bool = True) -> None:
    """S13 + S16: write a run; ``overwrite=False`` leaves an existing output alone.

    ``sort`` orders by (qid, rank) with a range-partitioned global sort (W2).
    """
    r = run.orderBy("qid", "rank") if sort else run
    format_run(r, tag).write.mode("overwrite" if overwrite else "ignore").text(path)


def write_runs(runs: DataFrame, path: str, tag: str = "taintrank", overwrite: bool = True) -> None:
    """S13 for many runs at once: one ``name=<run>/`` folder per run (a single
    write job partitioned by ``name``), lines in run format, ordered by (qid, rank).

    Range partitions over (name, qid, rank): a long run is written by several tasks, as files that follow each other.
    """
    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = runs.repartitionByRange(n, "name", "qid", "rank").sortWithinPartitions("name", "qid", "rank")
    lines = ordered.select("name", F.concat_ws(" ", F.col("qid"), F.lit("Q0"), F.col("docno"),
                                               F.col("rank").cast("string"), F.col("score").cast("string"),
                                               F.lit(tag)).alias("value"))
    lines.write.mode("overwrite" if overwrite else "ignore").partitionBy("name").text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """S14 for the ``write_runs`` layout: all runs in one scan, ``name`` from the folder."""
    lines = spark.read.text(path)
    f = F.split("value", " ")
    return lines.select(F.col("name").cast("string").alias("name"), f[0].alias("qid"), f[1].alias("iter"),
                        f[2].alias("docno"), f[3].cast("int").alias("rank"), f[4].cast("double").alias("score"),
                        f[5].alias("tag"))


def write_metrics(wide: DataFrame, path: str, measures=DEFAULT_MEASURES, overwrite: bool = True) -> None:
    """Tab-separated metric table with a header and a fixed column order."""
    (with_measure_labels(wide, measures).coalesce(1).write
     .mode("overwrite" if overwrite else "ignore")
     .option("sep", "\t").option("header", True).csv(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
