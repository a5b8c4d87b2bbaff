"""Reshape, array and map operators.

Groups (R5-R9) are one row per training group with array columns of
``group_size`` elements. The lists of supplied negatives (R2, R6, R7, R10) are the caller's:
as long as the caller makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import sampling
from .joins import BROADCAST_MAX_BYTES, attach_scores, attach_text_strict, parts_for

SCORE_MAP = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))


def pivot_pairs(triples: DataFrame) -> DataFrame:
    """Each triple -> (qid, docno, pos=1) for doc_id_a and (.., pos=0) for doc_id_b."""
    return triples.select(
        F.col("query_id").cast("string").alias("qid"),
        F.expr("stack(2, CAST(doc_id_a AS STRING), 1, CAST(doc_id_b AS STRING), 0) AS (docno, pos)"))


def pivot_with_negatives(triples: DataFrame, negatives: DataFrame) -> DataFrame:
    """R2: one positive row (pos=1), then one row per supplied negative (pos null).

    ``negatives[qid, docnos array<string>]``; a query without an entry fails
    like the reference's dictionary lookup. ``idx`` keeps the row order.
    """
    t = triples.select(F.col("query_id").cast("string").alias("qid"),
                       F.col("doc_id_a").cast("string").alias("doc_id_a"))
    n = negatives.select("qid", F.col("docnos"), F.lit(True).alias("_hit"))
    sizes = negatives.groupBy("qid").agg(F.sum(F.size("docnos")).alias("_n"), F.sum(
        F.aggregate("docnos", F.lit(16).cast("long"), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0)))).alias("_bytes"))
    if (sizes.agg(F.sum("_bytes")).first()[0] or 0) <= BROADCAST_MAX_BYTES:
        # a triple is small and makes a row per negative: dealt by these, in ranges so that a task has few queries
        t, n = t.repartitionByRange(parts_for(t, sizes, "qid"), "qid", "doc_id_a"), F.broadcast(n)
    j = t.join(n, "qid", "left")
    negs = F.when(F.col("_hit").isNull(),
                  F.raise_error(F.concat(F.lit("no negatives for query "), F.col("qid")))) \
        .cast("array<string>")
    items = F.concat(
        F.array(F.struct(F.col("doc_id_a").alias("docno"), F.lit(1).alias("pos"))),
        F.transform(F.coalesce(negs, F.col("docnos")),
                    lambda d: F.struct(d.alias("docno"), F.lit(None).cast("int").alias("pos"))))
    return j.select("qid", F.posexplode(items).alias("idx", "item")).select(
        "qid", "idx", F.col("item.docno").alias("docno"), F.col("item.pos").alias("pos"))


def explode_score_map(df: DataFrame, col: str = "scores") -> DataFrame:
    """``{qid: {docno: score}}`` column -> long rows (qid, docno, score)."""
    m = F.col(col)
    if df.schema[col].dataType.typeName() == "string":
        m = F.from_json(m, SCORE_MAP)
    return (df.select(F.explode(m).alias("qid", "docs"))
            .select("qid", F.explode("docs").alias("docno", "score")))


MAP_BUCKETS = 16


def collect_score_map(scores: DataFrame, seq: str | None = None, buckets: int = MAP_BUCKETS) -> DataFrame:
    """Long (qid, docno, score) -> rows ``qid, bucket, scores map<docno, score>``.

    A duplicated (qid, docno) keeps the row with the largest ``seq`` (the
    last written), or the largest score when no order is given. One contract for every size: a
    query's documents are hashed into ``buckets`` rows, so a row is keyed by (qid, bucket) and
    holds one bucket alone; ``buckets=1`` gives a single map per query. R3 / S9 merge the rows of a qid.
    """
    if buckets < 1:
        raise ValueError("buckets must be >= 1")
    order = F.col(seq) if seq else F.col("score")
    dedup = scores.groupBy("qid", "docno").agg(F.max_by("score", order).alias("score"))
    return dedup.groupBy("qid", F.pmod(F.xxhash64("docno"), F.lit(buckets)).cast("int").alias("bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct("docno", "score"))).alias("scores"))


def group_rows(triples: DataFrame, group_size: int = 2, seed: int = sampling.DEFAULT_SEED,
               include_positive: bool = True, short: str = "raise") -> DataFrame:
    """Normalise triples to ``gid, qid, docnos array`` of the group size.

    * list negatives, size > 2: sample ``size-1`` of them (A6);
    * list negatives, size 2: choose one (A5);
    * scalar negative, size > 2: ``ValueError`` (as the reference);
    * ``include_positive=False`` is the listwise variant (only the list);
    * fewer negatives than needed: error (``short="raise"``, as the reference) or all there are (``"keep"``).

    ``gid`` is made from the row itself (and its number among equal rows), so a repeated task gives the same.
    """
    if group_size < 1:
        raise ValueError("group_size must be >= 1")
    is_list = triples.schema["doc_id_b"].dataType.typeName() == "array"
    if not is_list and group_size > 2:
        raise ValueError("group_size > 2 needs a list of negatives per row")
    t = triples
    if "gid" not in triples.columns:
        negatives = F.array_join("doc_id_b", ",") if is_list else F.col("doc_id_b").cast("string")
        key = F.md5(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id_a").cast("string"), negatives))
        same = Window.partitionBy(key).orderBy("query_id")
        t = triples.withColumn("gid", F.concat_ws("-", key, F.row_number().over(same).cast("string")))
    salt = F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id_a").cast("string"))
    if group_size == 1:
        negs = F.array().cast("array<string>")  # a group of one holds only the positive
    elif is_list:
        negs = F.transform("doc_id_b", lambda x: x.cast("string"))
        if group_size > 2:
            negs = sampling.sample_array(negs, group_size - 1, seed, salt, short)
        else:
            negs = F.array(sampling.choose_one(negs, seed, salt))
    else:
        negs = F.array(F.col("doc_id_b").cast("string"))
    if include_positive:
        docs = F.concat(F.array(F.col("doc_id_a").cast("string")), negs)
    else:
        docs = negs
    return t.select("gid", F.col("query_id").cast("string").alias("qid"), docs.alias("docnos"))


def assemble_groups(groups: DataFrame, queries: DataFrame, docs: DataFrame,
                    teacher: DataFrame | None = None) -> DataFrame:
    """``gid, qid, query, docnos, texts, labels`` with the positive first.

    Texts are attached strictly (unknown ids fail), teacher scores with
    default 0.0 (J6). Explode -> joins -> regroup by ``gid``; each group
    holds ``group_size`` elements.
    """
    long = groups.select("gid", "qid", F.posexplode("docnos").alias("pos_idx", "docno"))
    long = attach_text_strict(long, docs, key="docno")
    if teacher is not None:
        long = attach_scores(long, teacher, as_col="label")
    else:
        long = long.withColumn("label", F.lit(None).cast("double"))
    g = long.groupBy("gid", "qid").agg(
        F.sort_array(F.collect_list(F.struct("pos_idx", "docno", "text", "label"))).alias("items"))
    g = attach_text_strict(g, queries, key="qid", text_field="query")
    return g.select("gid", "qid", "query",
                    F.col("items.docno").alias("docnos"),
                    F.col("items.text").alias("texts"),
                    F.col("items.label").alias("labels"))


def cross_layout(groups: DataFrame) -> DataFrame:
    """One row per (group, doc): the query repeated, flat labels."""
    return groups.select("gid", "qid", "query",
                         F.posexplode(F.arrays_zip("docnos", "texts", "labels")).alias("pos_idx", "d")) \
        .select("gid", "qid", "query", "pos_idx", F.col("d.docnos").alias("docno"),
                F.col("d.texts").alias("text"), F.col("d.labels").alias("label"))


def bi_layout(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one query row per group, flat docs with labels)."""
    q = groups.select("gid", "qid", "query")
    d = cross_layout(groups).drop("query")
    return q, d


def pos_pairs(a) -> Column:
    """``[p, n1, n2, ..] -> [[p, n1], [p, n2], ..]`` (empty for size 1)."""
    arr = F.col(a) if isinstance(a, str) else a

    def pairs(whole: Column) -> Column:
        rest = F.slice(whole, 2, F.greatest(F.size(whole) - 1, F.lit(0)))
        return F.transform(rest, lambda x: F.array(F.element_at(whole, 1), x))
    # bound as a variable, the list is made once a row and not again for every element
    return F.element_at(F.transform(F.array(arr), pairs), 1)
