"""JSON sources and sinks.

Names decide the form. ``.jsonl`` is a folder of JSON lines, written and read in parallel: the form for large tables.
``.json`` is one document in one file: an array of records, ``{id: text}`` or ``{qid: {docno: score}}``. It is read
in splits at any size (:mod:`.jsonobject`), whoever wrote it and however it is indented, and written as one valid document. ``.gz``
behind either compresses; a compressed document is written as many gzip members in one file and read in splits (:mod:`.blockgzip`), other writers' by one task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.reshape import MAP_BUCKETS, SCORE_MAP, collect_score_map
from ..session import cut_lineage
from . import jsonobject

LOOKUP_MAP = T.MapType(T.StringType(), T.StringType())
_EXTS = (".json", ".jsonl", ".json.gz", ".jsonl.gz")


def json_kind(path: str) -> tuple[bool, str | None]:
    """S7/S8 extension rule: (is_lines, compression); other extensions raise."""
    name = os.path.basename(path.rstrip("/"))
    if name.endswith(".jsonl.gz"):
        return True, "gzip"
    if name.endswith(".json.gz"):
        return False, "gzip"
    if name.endswith(".jsonl"):
        return True, None
    if name.endswith(".json"):
        return False, None
    raise ValueError(f"{path}: expected .json or .jsonl, plain or .gz")


def load_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Records of ``.json`` (an array, or top-level objects) or ``.jsonl``; ``.gz`` either way. Without a schema Spark infers one."""
    lines, _ = json_kind(path)
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if lines:
        return r.json(path)
    kind = schema if schema is not None else r.option("multiLine", True).json(path).schema
    return jsonobject.members(spark, path).select(F.from_json("raw", kind).alias("_r")).select("_r.*")


def save_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines under ``path``, or as one array for ``.json`` (gzip for ``.gz`` names)."""
    lines, comp = json_kind(path)
    if not lines:
        rows = df.select(F.concat(F.lit(","), F.to_json(F.struct(*df.columns))))
        return jsonobject.write_document(rows, path, "[", "]", 1, comp is not None, mode)
    w = df.write.mode(mode)
    if comp:
        w = w.option("compression", comp)
    w.json(path)


def read_lookup(spark: SparkSession, path: str, key: str = "id", value: str = "text") -> DataFrame:
    """``{id: text}`` object(s) -> rows ``(id, text)``; one object per file or per line."""
    lines, _ = json_kind(path)
    if not lines:
        raw = jsonobject.members(spark, path, 1).select(F.concat(F.lit("{"), "raw", F.lit("}")).alias("value"))
    else:
        raw = spark.read.text(path)
    return raw.select(F.explode(F.from_json("value", LOOKUP_MAP)).alias(key, value))


def write_lookup(df: DataFrame, path: str, key: str = "id", value: str = "text",
                 rows_per_object: int = 100_000, mode: str = "overwrite") -> None:
    """Rows -> one ``{id: text}`` object (``.json``), or JSON lines of objects of at most ``rows_per_object`` ids."""
    lines, comp = json_kind(path)
    if not lines:
        rows = df.where(F.col(key).isNotNull()).select(F.concat(F.lit(","), jsonobject.entry(F.col(key), F.col(value))))
        return jsonobject.write_document(rows, path, "{", "}", 1, comp is not None, mode)
    nb = df.select(F.ceil(F.count(F.lit(1)) / F.lit(float(rows_per_object)))).scalar()
    obj = (df.withColumn("_b", F.pmod(F.xxhash64(key), F.greatest(nb, F.lit(1))))
           .groupBy("_b").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, value)))).alias("value")))
    w = obj.select("value").write.mode(mode)
    if comp:
        w = w.option("compression", comp)
    w.text(path)


def read_score_map(spark: SparkSession, path: str) -> DataFrame:
    """``{qid: {docno: score}}`` (one object, or one per line) -> (qid, docno, score)."""
    lines, _ = json_kind(path)
    if not lines:
        raw = jsonobject.members(spark, path, 2)
        qid = F.map_keys(F.from_json(F.concat(F.lit("{"), "key", F.lit(":0}")), "map<string,int>"))[0]
        docs = F.from_json(F.concat(F.lit("{"), "raw", F.lit("}")), "map<string,double>")
        return raw.select(qid.alias("qid"), F.explode(docs).alias("docno", "score"))
    raw = spark.read.text(path)
    return (raw.select(F.explode(F.from_json("value", SCORE_MAP)).alias("qid", "docs"))
            .select("qid", F.explode("docs").alias("docno", "score")))


def write_score_map(scores: DataFrame, path: str, seq: str | None = None,
                    buckets: int = MAP_BUCKETS, mode: str = "overwrite") -> None:
    """One ``{qid: {docno: score}}`` object (``.json``), or R4 and then one line per (qid, bucket); ``buckets=1`` writes one line per query."""
    lines, comp = json_kind(path)
    if not lines:
        return _write_score_object(scores, path, seq, comp is not None, mode)
    maps = collect_score_map(scores, seq, buckets)
    out = maps.select(F.to_json(F.create_map(F.col("qid"), F.col("scores"))).alias("value"))
    w = out.write.mode(mode)
    if comp:
        w = w.option("compression", comp)
    w.text(path)


def _write_score_object(scores: DataFrame, path: str, seq: str | None, compress: bool, mode: str) -> None:
    """Rows in (qid, docno) order; the row with a query's least docno opens its object. No query is collected."""
    last = F.max_by("score", seq) if seq else F.max("score")
    rows = cut_lineage(scores.where("qid is not null and docno is not null").groupBy("qid", "docno").agg(last.cast("double").alias("score")), "score_rows")
    least = rows.groupBy("qid").agg(F.min("docno").alias("_least"))
    ordered = rows.join(least, "qid").repartitionByRange("qid", "docno").sortWithinPartitions("qid", "docno")
    pair = jsonobject.entry(F.col("docno"), F.col("score"))
    opens = F.concat(F.lit("},"), jsonobject.label(F.col("qid")), F.lit("{"), pair)
    text = ordered.select(F.when(F.col("docno") == F.col("_least"), opens).otherwise(F.concat(F.lit(","), pair)))
    jsonobject.write_document(text, path, "{", "}}", 2, compress, mode)


def write_score_records(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flat ``{qid, docno, score}`` records."""
    save_json(scores.select("qid", "docno", F.col("score").cast("double")), path, mode)


def read_score_records(spark: SparkSession, path: str) -> DataFrame:
    return load_json(spark, path, "qid string, docno string, score double")
