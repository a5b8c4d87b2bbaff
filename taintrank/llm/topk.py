"""Exact top-k inner products by columnar branch-and-bound (operator 8).

Vectors are dealt into candidate groups and query groups of bounded size; each pair of
groups meets in one task. There the candidates lie in vertical layout, dimension blocks in order of falling energy. A query adds up its
scores block by block; after each block the mass that is left in query and candidate bounds (by Cauchy-Schwarz) how far a score can still move.
Candidates whose best cannot reach the k-th worst-case score are dropped and the rest compacted. Only each query's
k best of a group leave the task; a last ranking keeps k of them.

All sums are whole numbers: in float64 while every possible sum is below 2**53, else in 64-bit integers, else in Python integers.

Contract for odd rows: vectors that are null, or hold a null or non-finite component, take no part; vectors of
another length than the query's are no candidates for it; vectors of length 0 score 0; rows that repeat an id are candidates
each, never for a query of the same id, and the smallest vector stands for the id as a query; equal scores go to the
smaller id; extra columns are ignored; no query or no candidate gives an empty result. A score beyond a
64-bit integer raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SCALE = 256
CANDIDATES, QUERIES = 1 << 14, 1 << 12      # rows of a group
DIMENSIONS = 16                             # of a block


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x); a float64 holds it exactly."""
    return np.floor(values.astype(np.float64) * SCALE)


def search(cand_ids: np.ndarray, cand: np.ndarray, query_ids: np.ndarray, query: np.ndarray, k: int):
    """(query id, candidate id, score) of each query's k best; ties to the smaller id."""
    d = cand.shape[1]
    peak = max(1.0, d * float(np.abs(cand).max(initial=0)) * float(np.abs(query).max(initial=0)))
    if peak >= 2**53:
        kind = np.int64 if peak < 2**62 else object
        cand = np.array([[int(x) for x in row] for row in cand.tolist()], kind).reshape(cand.shape)
        query = np.array([[int(x) for x in row] for row in query.tolist()], kind).reshape(query.shape)
    order = np.argsort(-(cand.astype(float) ** 2).sum(axis=0), kind="stable")
    blocks = [order[i:i + DIMENSIONS] for i in range(0, d, DIMENSIONS)]
    vertical = [np.ascontiguousarray(cand[:, b].T) for b in blocks]
    mass = lambda x: np.sqrt(np.cumsum([(x[:, b].astype(float) ** 2).sum(axis=1) for b in blocks[::-1]], axis=0)[::-1]) if blocks else None
    cand_mass, query_mass = mass(cand), mass(query)
    out = []
    for lo in range(0, len(query), 64):
        part = query[lo:lo + 64]
        first = part[:, blocks[0]] @ vertical[0] if blocks else np.zeros((len(part), len(cand)))
        for i, q in enumerate(part):
            alive = np.flatnonzero(cand_ids != query_ids[lo + i])
            total = first[i][alive]
            for b in range(1, len(blocks)):
                if len(alive) > k:
                    # a hair more than the bound, for the rounding of the square roots
                    slack = cand_mass[b][alive] * (query_mass[b][lo + i] * (1 + 1e-9)) + 1e-6
                    near = total.astype(float)
                    floor = np.partition(near - slack, len(alive) - k)[len(alive) - k]
                    stay = near + slack >= floor - np.abs(floor) * 1e-12
                    alive, total = alive[stay], total[stay]
                total = total + q[blocks[b]] @ vertical[b][:, alive]
            best = np.lexsort((cand_ids[alive], -total))[:k] if total.dtype != object else np.array(
                sorted(range(len(alive)), key=lambda j: (-total[j], cand_ids[alive[j]]))[:k], int)
            out += [(int(query_ids[lo + i]), int(cand_ids[alive[j]]), int(total[j])) for j in best.tolist()]
    return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    table = table.combine_chunks()
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return ids, whole(values.reshape(len(ids), -1)) if len(values) else np.zeros((len(ids), 0))


def _meet(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = search(*_matrix(left), *_matrix(right), k) if left.num_rows and right.num_rows else []
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, d) of the vectors that take part."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd).withColumn("d", F.size("v"))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for the vectors whose id is divisible by ``every``, against all."""
    rows = usable(vectors)
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    groups, turns = max(1, -(-n["n"] // CANDIDATES)), max(1, -(-n["q"] // QUERIES))

    def deal(df: DataFrame, own: str, parts: int, other: str, times: int) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        return df.withColumn(own, place).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    cand = deal(rows, "g", groups, "t", turns)
    ask = deal(asked, "t", turns, "g", groups)
    met = (cand.groupBy("d", "g", "t").cogroup(ask.groupBy("d", "g", "t"))
           .applyInArrow(_meet(k), "query_id long, vec_id long, score long"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
