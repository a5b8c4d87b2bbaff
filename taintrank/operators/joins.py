"""Equi-joins of the reference (J1-J9; J10 lives in metrics, J11/J12 in
plans.contaminate).

Join strategy is left to Catalyst + AQE: small sides (queries, qrels,
query vectors) fall under ``autoBroadcastJoinThreshold`` after AQE measures
them at runtime; large sides (docs, postings) take a shuffle join, and AQE's
skew-join split handles a hot key. A side is broadcast by hand only after
its bytes were measured (:func:`broadcast_if_small`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_text(df: DataFrame, texts: DataFrame, key: str = "docno", text_field: str = "text",
                as_col: str | None = None) -> DataFrame:
    """Lenient attach (unknown id -> null) of ``texts[key, text_field]``."""
    out = as_col or text_field
    t = texts.select(key, F.col(text_field).alias(out))
    return df.join(t, key, "left")


def attach_text_strict(df: DataFrame, texts: DataFrame, key: str = "docno", text_field: str = "text",
                       as_col: str | None = None) -> DataFrame:
    """Like J3 but an unknown id fails the job (checked inline, no extra scan)."""
    out = as_col or text_field
    t = texts.select(key, F.col(text_field).alias(out), F.lit(True).alias("_hit"))
    joined = df.join(t, key, "left")
    check = F.when(F.col("_hit").isNull(),
                   F.raise_error(F.concat(F.lit(f"unknown {key}: "), F.col(key).cast("string"))))
    return joined.withColumn(out, F.coalesce(check.cast(t.schema[out].dataType), F.col(out))).drop("_hit")


def attach_query(df: DataFrame, queries: DataFrame, strict: bool = True) -> DataFrame:
    """Attach ``query`` by ``qid`` (strict by default, as the re-rankers do)."""
    fn = attach_text_strict if strict else attach_text
    return fn(df, queries, key="qid", text_field="query")


def attach_scores(df: DataFrame, scores: DataFrame, keys: Sequence[str] = ("qid", "docno"),
                  score: str = "score", as_col: str = "teacher_score", default: float = 0.0) -> DataFrame:
    """Teacher score by key; a missing score becomes ``default`` (0.0)."""
    s = scores.select(*keys, F.col(score).alias(as_col))
    return df.join(s, list(keys), "left").withColumn(
        as_col, F.coalesce(F.col(as_col), F.lit(float(default))))


def match_scores(student: DataFrame, teacher: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inner join of two score tables on (by..., qid, docno) -> ``s``, ``t``."""
    keys = [*by, "qid", "docno"]
    return student.select(*keys, F.col("score").alias("s")).join(
        teacher.select(*keys, F.col("score").alias("t")), keys, "inner")


def attach_vectors(pairs: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    """``query_vec`` and ``doc_vec`` by id; pairs missing either are dropped."""
    return (pairs.join(query_vecs.select("qid", F.col("vec").alias("query_vec")), "qid", "inner")
            .join(doc_vecs.select("docno", F.col("vec").alias("doc_vec")), "docno", "inner"))


def used_only(table: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """Keep rows of ``table`` whose ``key`` occurs in ``pairs`` (semi-join)."""
    return table.join(pairs.select(key), key, "left_semi")


# A side is broadcast only after its size in bytes is measured; beyond the
# bound it stays an ordinary (shuffle / AQE-managed) join input.
BROADCAST_MAX_BYTES = 64 << 20


PAIRS = 4 << 20              # rows that a task makes of a join by a key that many rows share


def parts_for(left: DataFrame, sizes: DataFrame, key: str, rows: int = PAIRS) -> int:
    """Into how many parts to deal ``left`` so that its join with ``sizes[key, _n]`` rows a key makes about ``rows`` rows in each, however few its own rows are."""
    spark = left.sparkSession
    made = left.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).join(sizes, key).agg(F.sum(F.col("_m") * F.col("_n"))).first()[0] or 0
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(least, -(-int(made) // rows))


def measured_bytes(df: DataFrame) -> int:
    """Bytes of all values of ``df``, by one aggregate: strings and arrays by their length, others 8 each."""
    def size(c):
        kind = df.schema[c].dataType.typeName()
        if kind in ("string", "binary"):
            return F.octet_length(c) + 16
        if kind in ("array", "map"):
            return F.size(c) * 8 + 16
        return F.lit(8)
    row = F.lit(8)
    for c in df.columns:
        row = row + F.coalesce(size(c), F.lit(8))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when a measuring job shows at most ``max_bytes``.

    Used for sides that are small by construction but not provably so
    (query vocabularies, per-query weights, qrels). Costs one job on that
    side; the big side is then joined map-side without being shuffled.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df
