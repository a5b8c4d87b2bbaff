"""Training groups on long rows (R2, R5, R6, R7, R10): one row per group element, at any number of negatives.

The array forms of :mod:`reshape` hold a query's negatives in one row and copy that row to every positive. Here a
negative is a row of its own: ``negatives[query_id, doc_id_b]``. What a group takes is found by number
(:func:`sampling.sample_pairs_ring`), so the work is one sort of the negatives and ``group_size`` lookups a positive, and no
row, group or task grows with a query. Rows are ``gid, qid, pos_idx, docno``; position 0 is the positive.

Repeated (query, positive) and (query, negative) rows count once, null ids belong to no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sampling
from .joins import attach_scores, attach_text_strict

BUCKET = 1024                # positives and negatives of a query that meet under one join key


def _gid() -> Column:
    return F.md5(F.concat_ws(":", "query_id", "doc_id_a"))


def numbered_negatives(negatives: DataFrame, seed: int = sampling.DEFAULT_SEED) -> DataFrame:
    """``qid, idx, docno``: a query's distinct negatives numbered from 1 in salted order, by range partitions."""
    return sampling.ring(negatives, seed)[0].select(F.col("query_id").alias("qid"), F.col("_at").cast("int").alias("idx"), F.col("doc_id_b").alias("docno"))


def pivot_with_negatives(triples: DataFrame, negatives: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """R2: ``qid, idx, docno, pos``: each triple's positive (``idx`` 0, pos 1), then all negatives of its query (pos null).

    ``triples[query_id, doc_id_a]``, each row for itself; ``negatives[qid, idx, docno]`` with ``idx`` from 1 without gaps, as
    :func:`numbered_negatives` makes it. The output is positives times negatives by definition; it is
    formed under keys (query, negative bucket, positive bucket) of at most ``bucket`` negatives, so a hot query is dealt over
    many tasks. A query without negatives fails the job, like the reference's dictionary lookup.
    """
    t = triples.select(F.col("query_id").cast("string").alias("qid"), F.col("doc_id_a").cast("string").alias("doc_id_a"))
    have = negatives.groupBy("qid").agg(F.ceil(F.max("idx") / bucket).cast("int").alias("_nn"))
    sizes = t.groupBy("qid").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("_np")).join(have, "qid", "left")
    sizes = sizes.withColumn("_nn", F.coalesce(F.col("_nn"), F.raise_error(F.concat(F.lit("no negatives for query "), F.col("qid"))).cast("int")))
    dealt = (t.join(sizes, "qid").withColumn("_p", F.pmod(F.xxhash64("doc_id_a"), F.col("_np")).cast("int"))
             .select("qid", "doc_id_a", "_p", F.explode(F.sequence(F.lit(0), F.col("_nn"))).alias("_n")))
    # bucket 0 is the positive itself
    first = F.when(F.col("_n") == 0, F.lit(1))
    n = (negatives.join(sizes, "qid").select(
        "qid", "idx", "docno", (F.floor((F.col("idx") - 1) / bucket) + 1).cast("int").alias("_n"), F.explode(F.sequence(F.lit(0), F.col("_np") - 1)).alias("_p")))
    pos = dealt.where("_n = 0").select("qid", F.lit(0).alias("idx"), F.col("doc_id_a").alias("docno"), first.cast("int").alias("pos"))
    neg = dealt.where("_n > 0").join(n, ["qid", "_n", "_p"]).select("qid", F.col("idx").cast("int").alias("idx"), "docno", F.lit(None).cast("int").alias("pos"))
    return pos.unionByName(neg)


def groups(positives: DataFrame, negatives: DataFrame, group_size: int, seed: int = sampling.DEFAULT_SEED,
           include_positive: bool = True, short: str = "raise") -> DataFrame:
    """``gid, qid, pos_idx, docno``: each positive with ``group_size - 1`` sampled negatives of its query.

    ``positives[query_id, doc_id_a]``, ``negatives[query_id, doc_id_b]``. ``include_positive=False`` is the listwise variant: the
    negatives alone, from position 0. A query with fewer negatives fails the job (``short="raise"``) or
    gives all it has (``"keep"``).
    """
    if group_size < 1:
        raise ValueError("group_size must be >= 1")
    if short not in ("raise", "keep"):
        raise ValueError(f"short must be raise or keep, not {short}")
    p = positives.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id_a").cast("string").alias("doc_id_a")).dropna().distinct()
    n = negatives.select(F.col("query_id").cast("string").alias("query_id"), F.col("doc_id_b").cast("string").alias("doc_id_b")).dropna()
    first = p.select(_gid().alias("gid"), F.col("query_id").alias("qid"), F.lit(0).alias("pos_idx"), F.col("doc_id_a").alias("docno"))
    if group_size == 1:
        return first if include_positive else first.limit(0)
    at = F.col("idx") - F.lit(0 if include_positive else 1)
    picks = sampling.sample_pairs_ring(p, n, group_size - 1, seed)
    out = picks.select(_gid().alias("gid"), F.col("query_id").alias("qid"), at.cast("int").alias("pos_idx"), F.col("doc_id_b").alias("docno"))
    if short == "raise":
        have = n.distinct().groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        few = p.join(have, "query_id", "left").where(F.coalesce("_n", F.lit(0)) < group_size - 1)
        fail = F.raise_error(F.concat(F.lit("Sample larger than population for query "), F.col("query_id"))).cast("string")
        out = out.unionByName(few.select(fail.alias("gid"), fail.alias("qid"), F.lit(0).alias("pos_idx"), fail.alias("docno")))
    return first.unionByName(out) if include_positive else out


def assemble(rows: DataFrame, queries: DataFrame, docs: DataFrame, teacher: DataFrame | None = None) -> DataFrame:
    """R5 (and R8's layout): ``gid, qid, pos_idx, docno, query, text, label``, a row per element.

    Texts are attached strictly (J4), teacher scores with default 0.0 (J6). Nothing is regrouped: the rows of a group are
    found by ``gid``, in the order of ``pos_idx``.
    """
    out = attach_scores(rows, teacher, as_col="label") if teacher is not None else rows.withColumn("label", F.lit(None).cast("double"))
    out = attach_text_strict(out, queries, key="qid", text_field="query")
    return attach_text_strict(out, docs, key="docno").select("gid", "qid", "pos_idx", "docno", "query", "text", "label")


def pos_pairs(rows: DataFrame) -> DataFrame:
    """``gid, qid, idx, positive, negative``: the positive of each group with each of its negatives (none for a group of one)."""
    first = rows.where("pos_idx = 0").select("gid", F.col("docno").alias("positive"))
    rest = rows.where("pos_idx > 0").select("gid", "qid", F.col("pos_idx").alias("idx"), F.col("docno").alias("negative"))
    return rest.join(first, "gid").select("gid", "qid", "idx", "positive", "negative")
