"""Deterministic, partition-independent sampling.

Randomness comes from ``md5(seed:key)`` order keys: the same rows are
chosen whatever the partitioning, and DuckDB's ``md5`` reproduces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import BROADCAST_MAX_BYTES, measured_bytes, parts_for
from .rank import ordered_positions

DEFAULT_SEED = 42


def order_key(seed: int, *cols) -> Column:
    """Salted md5 of the key columns (A7: the seed is an argument everywhere)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                  for c in cols]
    return F.md5(F.concat_ws(":", *parts))


_DIGITS, _LAST = 3, 1024


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """A1/A2/A3: exactly ``min(n, count)`` rows, chosen by salted md5 of ``key``.

    The sample are the rows with the smallest md5. Histograms of its leading digits (4096 cells each)
    find the cell in which the n-th row lies; rows before it pass a filter and stay where
    they are, and only the last cell (about ``_LAST`` rows) is ordered. ``df`` is read once for each
    histogram and once for the rows.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    if n == 0:
        return df.limit(0)
    keyed = df.withColumn("_k", order_key(seed, *key))
    prefix, left = "", n
    while True:
        width = len(prefix) + _DIGITS
        cells = (keyed.where(F.col("_k").startswith(prefix)).groupBy(F.substring("_k", 1, width).alias("c"))
                 .agg(F.count(F.lit(1)).alias("n")).collect())
        for cell in sorted(cells):
            if left <= cell["n"]:
                prefix = cell["c"]
                break
            left -= cell["n"]
        else:
            return df                                  # fewer than n rows
        if cell["n"] <= _LAST or width >= 30:
            break
    edge = keyed.where(F.col("_k").startswith(prefix)).orderBy("_k", *key).limit(left)
    return keyed.where(F.substring("_k", 1, len(prefix)) < prefix).unionByName(edge).drop("_k")


def one_per_group(df: DataFrame, group: Sequence[str], value: str,
                  seed: int = DEFAULT_SEED, alias: str | None = None) -> DataFrame:
    """A4: one value per group (md5-smallest), as a partial+final aggregate."""
    k = order_key(seed, *group, value)
    return df.groupBy(*group).agg(F.min_by(F.col(value), k).alias(alias or value))


CHUNK = 512                  # negatives of a query that meet a positive at once


def sample_pairs(positives: DataFrame, negatives: DataFrame, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """A5 (k = 1) and A6 on long rows: ``k`` negatives for each positive, ``query_id, doc_id_a, doc_id_b, idx``.

    ``positives[query_id, doc_id_a]`` and ``negatives[query_id, doc_id_b]`` meet by query; the smallest salted md5 keys stay.
    Every pair has its key, so the work is positives x negatives; no pair is a row. The negatives of a query are dealt into lists of
    about ``CHUNK``, a positive meets these lists in its task, keeps the k smallest keys of each, and the best of these stay.
    Positives are dealt by the number of their pairs. The choice equals :func:`sample_array` with the salt ``query_id:doc_id_a``.
    """
    pos, neg = positives.select("query_id", "doc_id_a"), negatives.select("query_id", "doc_id_b").where(F.col("query_id").isNotNull())
    sizes = cut_lineage(neg.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")), "negative_counts")
    chunk = F.pmod(F.xxhash64("doc_id_b", F.lit(3)), F.ceil(F.col("_n") / CHUNK)).alias("_chunk")
    lists = cut_lineage(neg.join(sizes, "query_id").groupBy("query_id", chunk).agg(F.collect_list(F.struct("doc_id_b")).alias("_list")), "negative_lists")
    parts = parts_for(pos, sizes, "query_id")
    if measured_bytes(neg) <= BROADCAST_MAX_BYTES:
        lists = F.broadcast(lists)
    j = pos.repartition(parts, "query_id", "doc_id_a").distinct().join(lists.drop("_chunk"), "query_id")
    keyed = F.transform("_list", lambda x: F.struct(order_key(seed, "query_id", "doc_id_a", x["doc_id_b"]).alias("_key"), x["doc_id_b"].alias("doc_id_b")))
    least = F.array(F.array_min(keyed)) if k == 1 else F.slice(F.sort_array(keyed), 1, k)
    found = j.select("query_id", "doc_id_a", F.explode(least).alias("_x")).select("query_id", "doc_id_a", "_x.doc_id_b", "_x._key")
    w = Window.partitionBy("query_id", "doc_id_a").orderBy("_key", "doc_id_b")
    return found.withColumn("idx", F.row_number().over(w)).where(F.col("idx") <= k).drop("_key")


def ring(negatives: DataFrame, seed: int = DEFAULT_SEED) -> tuple[DataFrame, DataFrame]:
    """(``query_id, doc_id_b, _at``: a query's distinct negatives numbered from 1 in salted md5 order, by range partitions; the table behind it)."""
    negs = negatives.select("query_id", "doc_id_b").distinct().withColumn("_key", order_key(seed, "query_id", "doc_id_b"))
    negs = cut_lineage(negs.withColumn("_num", F.conv(F.substring("_key", 1, 12), 16, 10).cast("double")), "negatives")
    turns = ordered_positions(negs, ["query_id"], "_num", False, [F.col("_key").asc(), F.col("doc_id_b").asc()], sums=[(None, "_at")])
    return turns, negs


def sample_pairs_ring(positives: DataFrame, negatives: DataFrame, k: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """A5 (k = 1) and A6 without positives x negatives: ``query_id, doc_id_a, doc_id_b, idx``, ``k`` distinct negatives for each positive.

    A query's negatives are permuted once (salted md5 order, numbered by range partitions, so a hot query is split); a
    positive takes ``k`` consecutive ones of that ring from an offset of its own (salted md5). The work is one sort of the negatives and k lookups a
    positive by (query, number). Repeated rows count once; a positive with fewer than ``k`` negatives takes them all. Another choice than :func:`sample_pairs`:
    positives of a query share one permutation.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    turns, negs = ring(negatives, seed)
    size = negs.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.conv(F.substring(order_key(seed, F.lit("offset"), "query_id", "doc_id_a"), 1, 15), 16, 10).cast("long")
    picks = positives.select("query_id", "doc_id_a").distinct().join(size, "query_id").select(
        "query_id", "doc_id_a", "_n", offset.alias("_from"), F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(k).cast("long"), "_n"))).alias("idx"))
    picks = picks.withColumn("_at", (F.col("_from") + F.col("idx") - 1) % F.col("_n") + 1)
    return picks.join(turns.select("query_id", "_at", "doc_id_b"), ["query_id", "_at"]).select("query_id", "doc_id_a", "doc_id_b", "idx")


def _keyed(arr: Column, seed: int, salt: Column | None) -> Column:
    salt = F.lit("") if salt is None else salt.cast("string")
    return F.transform(arr, lambda x: F.struct(
        F.md5(F.concat_ws(":", F.lit(str(seed)), salt, x.cast("string"))).alias("k"), x.alias("v")))


def choose_one(arr, seed: int = DEFAULT_SEED, salt: Column | None = None) -> Column:
    """A5: one element of an array per row (smallest salted md5)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.element_at(F.array_sort(_keyed(a, seed, salt)), 1).getField("v")


def sample_array(arr, k: int, seed: int = DEFAULT_SEED, salt: Column | None = None, short: str = "raise") -> Column:
    """``k`` elements without replacement; ``k > size`` raises like ``random.sample``, or
    with ``short="keep"`` takes all there are."""
    if short not in ("raise", "keep"):
        raise ValueError(f"short must be raise or keep, not {short}")
    a = F.col(arr) if isinstance(arr, str) else arr
    picked = F.transform(F.slice(F.array_sort(_keyed(a, seed, salt)), 1, k), lambda s: s.getField("v"))
    if short == "keep":
        return picked
    return F.when(F.size(a) >= k, picked).otherwise(
        F.raise_error(F.lit("Sample larger than population")))
