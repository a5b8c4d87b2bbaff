"""Score pairs arriving on a stream against static vector tables.

``pairs`` is a streaming frame ``(qid, docno)``; the vector tables are
static. Stream-static inner joins (J8) and the native dot (K7) need no
state, so every micro-batch is independent and a restarted query resumes
from its checkpoint in the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.rerank import vector_scores
from ..session import ensure_checkpoint_dir

PAIRS_SCHEMA = "qid string, docno string"


def read_pairs_stream(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A directory of parquet pair files as a stream (``maxFilesPerTrigger`` bounds a batch)."""
    return spark.readStream.schema(PAIRS_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)


def score_stream(pairs: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    return vector_scores(pairs, query_vecs, doc_vecs)


def write_scores(scores: DataFrame, path: str, name: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows as parquet; checkpoint under ``spark.checkpoint.dir``/``name``."""
    ckpt = os.path.join(ensure_checkpoint_dir(scores.sparkSession), "streams", name)
    w = scores.writeStream.format("parquet").option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(path)
