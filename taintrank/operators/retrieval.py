"""First-stage retrieval: BM25 over a postings DataFrame (K1) and exact
dense top-k by dot product (K7 as a retriever, V5 re-aimed).

Neither operator materialises query x document pairs that cannot score:
BM25 only joins postings of query terms, and the dense retriever keeps a
per-partition top-k inside numpy so only ``partitions x queries x k``
candidates reach the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import cut_lineage
from .joins import BROADCAST_MAX_BYTES, broadcast_if_small, measured_bytes
from .rank import DEFAULT_BUDGET, top_k

# The reference's BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75
# Contributions are added as exact decimals with this many places: the sum does not depend on
# the order of partitions, so copies of a document tie exactly and nothing is rounded before ranking.
SUM_PLACES = 18
TILE_BYTES = 32 << 20        # of a score matrix (documents x queries) held at once
TASK_BYTES = 24 << 20        # of texts that a task counts the terms of
TASK_POSTINGS = 1 << 21      # postings that a task scores
BATCH_POSTINGS = 1 << 17     # postings held at once
BATCH_GAINS = 1 << 20        # contributions held at once (more only for one document)


def bm25_postings(docs: DataFrame, vocab: DataFrame | None = None, vocab_bytes: int | None = None) -> DataFrame:
    """Postings ``term, docno, tf, dl`` plus one ``term = null`` row per document.

    Each document is tokenised exactly once: the token array is exploded
    with a leading null marker, so the same shuffle output yields the
    postings of the ``vocab`` terms (when given), the document frequencies
    and the collection statistics (N, average length) from the marker rows.
    ``explode_outer`` keeps Catalyst from re-evaluating the tokenizer in an
    inferred ``size(tokens) > 0`` filter. The vocabulary is
    broadcast only after its bytes were measured (``broadcast_if_small``).
    """
    texts = docs.select("docno", "text")
    if vocab_bytes is None or vocab_bytes <= BROADCAST_MAX_BYTES:
        # dealt by document, in parts of bounded size: terms are counted where their document is, and no task counts more than its part
        least = min(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.sparkSession.sparkContext.defaultParallelism)
        texts = texts.repartition(max(least, -(-measured_bytes(texts) // TASK_BYTES)), "docno")
    toks = texts.select("docno", tokens("text").alias("toks"))
    exploded = toks.select("docno", F.size("toks").alias("dl"), F.explode_outer(
        F.concat(F.array(F.lit(None).cast("string")), F.col("toks"))).alias("term"))
    if vocab is not None:
        v = vocab.select("term", F.lit(True).alias("_hit"))
        v = broadcast_if_small(v) if vocab_bytes is None else (
            F.broadcast(v) if vocab_bytes <= BROADCAST_MAX_BYTES else v)
        exploded = (exploded.join(v, "term", "left")
                    .where(F.col("term").isNull() | F.col("_hit").isNotNull()).drop("_hit"))
    # One row per (term, document). Where the texts were not dealt by document, terms are counted before the shuffle too.
    return exploded.groupBy("term", "docno", "dl").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, docs: DataFrame, k1: float = BM25_K1, b: float = BM25_B,
         budget: int | None = DEFAULT_BUDGET) -> DataFrame:
    """K1: ``bm25(queries[qid, query], docs[docno, text]) -> run[qid, docno, score, rank]``.

    score = sum over query terms of qtf * idf * tf (k1+1) / (tf + k1 (1 - b + b dl/avgdl)),
    idf = ln(1 + (N - n + 0.5) / (n + 0.5)). ``budget`` keeps the top k per query
    (``None`` keeps every matching document).

    With a ``budget``, postings are dealt by document and each task adds up its documents' scores as doubles
    (:func:`_preselect`), keeping what can be among the best ``budget`` of a query; the few pairs that stay are then summed as exact
    decimals and ranked. So no (query, document) pair is shuffled or held but in tiles, and the rows are those of the decimals.

    Skew: a term in a third of all postings is counted map-side (partial
    aggregate) for its document frequency and meets the small query-term
    table in the tasks of its documents. Without a ``budget``, or with query terms beyond the broadcast bound, per (qid, docno) sums
    are partial aggregates and the top-k is a ``WindowGroupLimit`` before
    and after the shuffle.
    """
    qterms = (queries.select("qid", F.explode(tokens("query")).alias("term"))
              .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))
    vocab = qterms.select("term").distinct()
    # One measurement bounds both small sides: vocabulary and weights have at most
    # the bytes of the (query, term) pairs.
    n_bytes = measured_bytes(qterms)
    small = n_bytes <= BROADCAST_MAX_BYTES
    # The postings feed four consumers (N, avgdl, df, scores): materialise them
    # once in the shared checkpoint folder instead of re-tokenising per job.
    post_all = cut_lineage(bm25_postings(docs, vocab, n_bytes), "bm25_postings")
    n_docs, avgdl = _statistics(post_all)
    post = post_all.where(F.col("term").isNotNull())
    dfreq = post.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    weights = qterms.join(dfreq, "term").select(
        "qid", "term",
        (F.col("qtf") * F.log(1 + (n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("w"))
    if budget is not None and small:
        weights = cut_lineage(weights, "bm25_weights")
        found = cut_lineage(_preselect(post, weights, budget, avgdl, k1, b), "bm25_candidates")
        return top_k(_exact(post, _near_best(found, budget), weights, avgdl, k1, b), budget)
    contrib = post.join(F.broadcast(weights) if small else weights, "term")
    scored = contrib.groupBy("qid", "docno").agg(_exact_sum(avgdl, k1, b).cast("double").alias("score"))
    if budget is None:
        return scored
    return top_k(scored, budget)


def _statistics(post_all: DataFrame) -> tuple:
    """(N, average length) from the marker rows."""
    return tuple(post_all.where(F.col("term").isNull()).agg(F.count(F.lit(1)).cast("double"), F.avg("dl")).first())


def _exact_sum(avgdl: float | None, k1: float, b: float):
    """Contributions of postings with their weight ``w``, added as exact decimals."""
    gain = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    return F.sum(gain.cast(f"decimal(38,{SUM_PLACES})"))


def _exact(post: DataFrame, pairs: DataFrame, weights: DataFrame, avgdl: float | None, k1: float, b: float) -> DataFrame:
    """``qid, docno, score`` of given pairs as exact sums: their documents' postings alone meet the weights of their query. Null ids are ids."""
    pairs = cut_lineage(pairs.select("qid", "docno"), "bm25_pairs")
    asked = broadcast_if_small(pairs.select(F.col("docno").alias("_d")).distinct())
    near = post.join(asked, F.col("docno").eqNullSafe(F.col("_d")), "left_semi")
    w = F.broadcast(weights.select(F.col("qid").alias("_q"), F.col("term").alias("_t"), "w"))
    keys = pairs.select("qid", F.col("docno").alias("_d")).join(w, F.col("qid").eqNullSafe(F.col("_q")))
    met = near.join(keys, (F.col("term") == F.col("_t")) & F.col("docno").eqNullSafe(F.col("_d")))
    return met.groupBy("qid", "docno").agg(_exact_sum(avgdl, k1, b).cast("double").alias("score"))


# sums of doubles differ from the exact ones by far less than this share
_HAIR = 1e-9


def _at_least(floor):
    return floor * (1 - _HAIR) - 1e-12


def _near_best(found: DataFrame, budget: int) -> DataFrame:
    """Pairs whose rough score may be among the best ``budget`` of the query."""
    least = top_k(found, budget).groupBy(F.col("qid").alias("_q")).agg(F.min("score").alias("_least"))
    return found.join(broadcast_if_small(least), F.col("qid").eqNullSafe(F.col("_q"))).where(F.col("score") >= _at_least(F.col("_least")))


class _Tiles:
    """Rough scores of a task's documents, in tiles of documents x queries; what may be among a query's best ``k`` is held."""

    def __init__(self, qids: list, terms: pa.Array, head: tuple, tail: tuple, least: np.ndarray, left: np.ndarray, k: int, tile_bytes: int):
        self.qids, self.terms, self.head, self.tail, self.left, self.k = qids, terms, head, tail, left, k
        self.floor = least.copy()                      # of each query: rises to the k-th best held
        self.wide = max(1, tile_bytes // (8 * max(1, len(qids))))
        self.q, self.s, self.d = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.looked, self.limit = 0, max(4 * k * len(qids), 1 << 16)

    @staticmethod
    def _gains(of: tuple, term: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posting, query, contribution) for every weight of every posting's term."""
        start, query, weight = of
        n = start[term + 1] - start[term]
        row = np.repeat(np.arange(len(term)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[term], n)
        return row, query[at], weight[at] * gain[row]

    def add(self, docno: pa.Array, term: pa.Array, gain: np.ndarray) -> None:
        """Postings of whole documents, in the order of documents."""
        named = docno.dictionary_encode("encode")
        doc = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = np.array(named.dictionary.to_pylist(), dtype=object)
        term = pc.index_in(term, self.terms).to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.searchsorted(doc, np.arange(len(names) + 1))
        n = sum((x[0][term + 1] - x[0][term] for x in (self.head, self.tail)), np.zeros(len(term), np.int64))
        work = np.concatenate([[0], np.cumsum(n)])[start]
        lo = 0
        while lo < len(names):
            hi = min(len(names), lo + self.wide, max(lo + 1, int(np.searchsorted(work, work[lo] + BATCH_GAINS, "right")) - 1))
            part = slice(start[lo], start[hi])
            self._tile(doc[part] - lo, term[part], gain[part], names[lo:hi])
            lo = hi

    def _tile(self, doc: np.ndarray, term: np.ndarray, gain: np.ndarray, names: np.ndarray) -> None:
        shape = len(names), len(self.qids)
        row, q, c = self._gains(self.head, term, gain)
        sums = np.bincount(doc[row] * shape[1] + q, c, shape[0] * shape[1]).reshape(shape)
        kept = (sums > 0) & (sums + self.left >= _at_least(self.floor))
        if len(self.tail[1]):
            some = kept.any(axis=1)[doc]
            near, term, gain = doc[some], term[some], gain[some]
            row, q, c = self._gains(self.tail, term, gain)
            asked = kept[near[row], q]
            self.looked += int(asked.sum())
            sums += np.bincount((near[row] * shape[1] + q)[asked], c[asked], shape[0] * shape[1]).reshape(shape)
            kept &= sums >= _at_least(self.floor)
        if shape[0] > self.k:
            sums[~kept] = 0
            kept &= sums >= _at_least(np.partition(sums, shape[0] - self.k, axis=0)[shape[0] - self.k])
        d, q = np.nonzero(kept)
        self.q, self.s, self.d = np.concatenate([self.q, q]), np.concatenate([self.s, sums[d, q]]), np.concatenate([self.d, names[d]])
        if len(self.q) > self.limit:
            self.cut()
            self.limit = max(self.limit, 2 * len(self.q))

    def cut(self) -> None:
        order = np.lexsort((-self.s, self.q))
        q, s = self.q[order], self.s[order]
        first = np.searchsorted(q, np.arange(len(self.qids) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        self.floor[full] = np.maximum(self.floor[full], s[first[full] + self.k - 1])
        stay = s >= _at_least(self.floor)[q]
        self.q, self.s, self.d = q[stay], s[stay], self.d[order][stay]


def _preselect(post: DataFrame, weights: DataFrame, k: int, avgdl: float | None, k1: float, b: float,
               floors: DataFrame | None = None, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``qid, docno, score, looked``: pairs that may be among a query's best ``k``, by sums of doubles, at least a task's own best ``k``.

    ``weights[qid, term, w]`` are small (measured by the caller) and sent to every task; postings are dealt and sorted by document, and streamed.
    With ``floors[qid, floor, left]`` and ``tail`` in ``weights``, terms of the tail are summed only where the others and ``left``, the
    most that the tail can add, reach ``floor``; ``looked`` counts these sums (in one row a task).
    """
    spark = post.sparkSession
    w = weights.select("qid", "term", "w", F.col("tail") if "tail" in weights.columns else F.lit(False).alias("tail")).collect()
    qids = list(dict.fromkeys(r.qid for r in w))
    number, words = {q: i for i, q in enumerate(qids)}, {t: i for i, t in enumerate(dict.fromkeys(r.term for r in w))}
    least, left = np.zeros(len(qids)), np.zeros(len(qids))
    for r in floors.select("qid", "floor", "left").collect() if floors is not None else ():
        least[number[r.qid]], left[number[r.qid]] = r.floor, r.left

    def by_term(tail: bool) -> tuple:
        rows = sorted((words[r.term], number[r.qid], r.w) for r in w if r.tail == tail)
        t, q, v = (np.array([r[i] for r in rows], dtype=(np.int64, np.int64, np.float64)[i]) for i in range(3))
        return np.searchsorted(t, np.arange(len(words) + 1)), q, v

    shared = spark.sparkContext.broadcast((qids, list(words), by_term(False), by_term(True), least, left))
    n = max(1, -(-post.count() // TASK_POSTINGS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    dealt = post.select("docno", "term", "tf", "dl").repartition(n, "docno").sortWithinPartitions("docno")
    kind = {c: f.schema[c].dataType.simpleString() for f, c in ((weights, "qid"), (post, "docno"))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = schema = None
        held: list[pa.RecordBatch] = []

        def score(table: pa.Table) -> None:
            tf, dl = (table.column(c).to_numpy().astype(np.float64) for c in ("tf", "dl"))
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
            tiles.add(table.column("docno").combine_chunks(), table.column("term").combine_chunks(), gain)

        for batch in batches:
            if tiles is None:
                ids, terms, head, tail, at_least, more = shared.value
                schema = batch.schema
                tiles = _Tiles(ids, pa.array(terms, schema.field("term").type), head, tail, at_least, more, k, tile_bytes)
            held.append(batch)
            if sum(x.num_rows for x in held) >= BATCH_POSTINGS:
                table = pa.Table.from_batches(held)
                docno = table.column("docno").combine_chunks()
                last = pc.equal(docno, docno[-1]).to_numpy(zero_copy_only=False) if docno[-1].is_valid else docno.is_null().to_numpy(zero_copy_only=False)
                whole = len(docno) - int(last.astype(bool).sum())     # the last document may go on
                if whole:
                    score(table.slice(0, whole))
                held = table.slice(whole).combine_chunks().to_batches()
        if tiles is not None:
            if held:
                score(pa.Table.from_batches(held))
            tiles.cut()
            looked = np.zeros(len(tiles.q), np.int64)
            looked[:1] = tiles.looked
            yield pa.RecordBatch.from_arrays([pa.array([tiles.qids[i] for i in tiles.q], qid_type(schema)), pa.array(tiles.d.tolist(), schema.field("docno").type),
                                              pa.array(tiles.s), pa.array(looked)], names=["qid", "docno", "score", "looked"])

    def qid_type(schema: pa.Schema) -> pa.DataType | None:
        return schema.field("docno").type if kind["qid"] == kind["docno"] else None

    return dealt.mapInArrow(run, f"qid {kind['qid']}, docno {kind['docno']}, score double, looked long")


def bm25_pairs(pairs: DataFrame, queries: DataFrame, docs: DataFrame, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """K1 for given pairs: ``qid, docno, score`` of each distinct (qid, docno) of ``pairs``, equal to :func:`bm25`, 0 where no term is shared.

    Statistics are those of all ``docs``; only postings of the asked documents meet the asked (docno, term), so the work is pairs
    times the terms of their query, whatever else the terms occur in. No other pair is scored and nothing is ranked.
    """
    wanted = cut_lineage(pairs.select("qid", "docno").distinct(), "bm25_pairs")
    asked = queries.join(wanted.select("qid"), "qid", "left_semi")
    qterms = cut_lineage(asked.select("qid", F.explode(tokens("query")).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "query_terms")
    n_bytes = measured_bytes(qterms)
    post_all = cut_lineage(bm25_postings(docs, qterms.select("term").distinct(), n_bytes), "bm25_postings")
    n_docs, avgdl = post_all.where(F.col("term").isNull()).agg(F.count(F.lit(1)).cast("double"), F.avg("dl")).first()
    post = post_all.where(F.col("term").isNotNull())
    dfreq = post.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("qtf") * F.log(1 + (F.lit(n_docs) - F.col("n") + 0.5) / (F.col("n") + 0.5))).alias("w")
    weights = qterms.join(dfreq, "term").select("qid", "term", w)
    keys = wanted.join(F.broadcast(weights) if n_bytes <= BROADCAST_MAX_BYTES else weights, "qid")
    near = post.join(wanted.select("docno"), "docno", "left_semi")
    gain = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    sums = keys.join(near, ["docno", "term"]).groupBy("qid", "docno").agg(F.sum(gain.cast(f"decimal(38,{SUM_PLACES})")).cast("double").alias("score"))
    return wanted.join(sums, ["qid", "docno"], "left").fillna(0.0, ["score"])


RARE = 8                     # postings of rare terms that set the threshold, per result
TAIL = 0.3                   # share of the threshold that the terms left for the second pass may add


class MaxScore:
    """K1 with pruning: the top ``budget`` of :func:`bm25`, to the last digit, from fewer contributions.

    Contributions do not depend on the query but for a weight, so a term's largest one bounds what it can add.

    1. Threshold: the rarest terms of each query name documents; these are scored in full, and the score of the
       ``budget``-th best is a floor that the results cannot fall below (0 where there are fewer).
    2. Terms are sorted by bound. The weakest, whose bounds add up to at most ``TAIL`` of the floor, are left out
       (these are the common words, with most of the postings); only the others are summed per document, and a document stays
       if its sum and the bounds left out reach the floor.
    3. The few documents that stay get what the left-out terms add, by (docno, term) lookups.

    Both passes add doubles document by document in tasks (:func:`_preselect`; the lookups are in the tile at hand), and the pairs that
    may be results are summed as exact decimals. Query terms beyond the broadcast bound are joined and summed as decimals throughout.

    It pays where postings are long and queries short; on whole texts as queries the floor is a small share of all bounds, and
    :func:`bm25` is the better plan. ``work`` counts the contributions summed, against those of :func:`bm25`.
    """

    def __init__(self, queries: DataFrame, docs: DataFrame, k1: float = BM25_K1, b: float = BM25_B, budget: int = DEFAULT_BUDGET):
        qterms = cut_lineage(queries.select("qid", F.explode(tokens("query")).alias("term"))
                             .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")), "query_terms")
        n_bytes = measured_bytes(qterms)
        self.budget, self._small = budget, n_bytes <= BROADCAST_MAX_BYTES
        self._k1, self._b = k1, b
        post_all = cut_lineage(bm25_postings(docs, qterms.select("term").distinct(), n_bytes), "bm25_postings")
        n_docs, avgdl = _statistics(post_all)
        self._avgdl = avgdl
        # the query's weight comes first in bm25(), so both factors of a contribution are kept apart
        length = F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl)
        self._gain = lambda w: w * F.col("tf") * (k1 + 1) / length
        self._post = post_all.where(F.col("term").isNotNull())
        stats = self._post.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("tf") * (k1 + 1) / length).alias("most"))
        weighted = qterms.join(stats, "term").withColumn("w", F.col("qtf") * F.log(1 + (n_docs - F.col("n") + 0.5) / (F.col("n") + 0.5)))
        # a query's terms are one window: bounded by the length of its text
        by_rare, by_bound = Window.partitionBy("qid").orderBy("n", "term"), Window.partitionBy("qid").orderBy("bound", "term")
        bound = (F.col("w") * F.col("most") * (1 + 1e-9)).alias("bound")
        weighted = weighted.select("qid", "term", "n", "w", bound)
        upto = Window.unboundedPreceding
        self._terms = cut_lineage(weighted.withColumn("before", F.coalesce(F.sum("n").over(by_rare.rowsBetween(upto, -1)), F.lit(0)))
                                  .withColumn("below", F.sum("bound").over(by_bound.rowsBetween(upto, 0))), "bm25_terms")
        self._plan()

    def _hint(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self._small else df

    def _sums(self, contributions: DataFrame) -> DataFrame:
        return contributions.groupBy("qid", "docno").agg(F.sum(self._gain(F.col("w")).cast(f"decimal(38,{SUM_PLACES})")).alias("sum"))

    def _of_terms(self, terms: DataFrame) -> DataFrame:
        return self._sums(self._post.join(self._hint(terms.select("qid", "term", "w")), "term"))

    def _lookups(self, pairs: DataFrame, terms: DataFrame) -> DataFrame:
        """What ``terms`` add to (qid, docno) pairs."""
        asked = pairs.select("qid", "docno").join(self._hint(terms.select("qid", "term", "w")), "qid")
        return self._sums(asked.join(self._post, ["docno", "term"]))

    def _plan(self) -> None:
        rare = self._terms.where(F.col("before") < RARE * self.budget)
        if self._small:
            near = self._post.join(F.broadcast(rare.select("term").distinct()), "term", "left_semi")
            named = top_k(_preselect(near, rare, self.budget, self._avgdl, self._k1, self._b), self.budget)
            full = _exact(self._post, named, self._terms, self._avgdl, self._k1, self._b)
        else:
            named = top_k(self._of_terms(rare).select("qid", "docno", F.col("sum").alias("score")), self.budget)
            full = self._lookups(named, self._terms).withColumn("score", F.col("sum").cast("double"))
        floor = full.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("floor")).where(F.col("_n") >= self.budget)
        # a hair below, for the bounds are doubles
        floor = floor.select("qid", (F.col("floor") * (1 - 1e-9)).alias("floor"))
        floor = floor.withColumnRenamed("qid", "_q")
        self.terms = cut_lineage(self._terms.join(floor, F.col("qid").eqNullSafe(F.col("_q")), "left").drop("_q").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
                                 .withColumn("tail", F.col("below") <= F.col("floor") * TAIL), "bm25_split")

    def run(self) -> DataFrame:
        """qid, docno, score, rank."""
        head, tail = self.terms.where(~F.col("tail")), self.terms.where("tail")
        left = self.terms.groupBy("qid").agg(F.max("floor").alias("floor"), F.coalesce(F.sum(F.when(F.col("tail"), F.col("bound"))), F.lit(0.0)).alias("left"))
        if self._small:
            self.kept = cut_lineage(_preselect(self._post, self.terms, self.budget, self._avgdl, self._k1, self._b, left), "bm25_kept")
            found = _near_best(self.kept, self.budget)
            return top_k(_exact(self._post, found, self.terms, self._avgdl, self._k1, self._b), self.budget)
        kept = self._of_terms(head).join(self._hint(left), "qid").where(F.col("sum").cast("double") + F.col("left") >= F.col("floor"))
        self.kept = cut_lineage(kept.select("qid", "docno", "sum"), "bm25_kept")
        more = self._lookups(self.kept, tail).withColumnRenamed("sum", "_more")
        both = self.kept.join(more, ["qid", "docno"], "left")
        zero = F.lit(0).cast(f"decimal(38,{SUM_PLACES})")
        score = (F.col("sum") + F.coalesce("_more", zero)).cast(f"decimal(38,{SUM_PLACES})").cast("double")
        return top_k(both.select("qid", "docno", score.alias("score")), self.budget)

    def work(self) -> dict[str, int]:
        """Contributions summed by both passes and (after :meth:`run`) looked up, and those that :func:`bm25` would sum."""
        t = self.terms.agg(F.sum("n"), F.sum(F.when(~F.col("tail"), F.col("n"))), F.sum(F.when(F.col("before") < RARE * self.budget, F.col("n")))).first()
        if self._small:
            looked = self.kept.agg(F.sum("looked")).first()[0] or 0
            return {"all": t[0] or 0, "summed": (t[1] or 0) + (t[2] or 0) + looked}
        looked = self.kept.join(self._hint(self.terms.where("tail").select("qid", "term")), "qid").join(self._post, ["docno", "term"]).count()
        return {"all": t[0] or 0, "summed": (t[1] or 0) + (t[2] or 0) + looked}


def bm25_maxscore(queries: DataFrame, docs: DataFrame, k1: float = BM25_K1, b: float = BM25_B, budget: int = DEFAULT_BUDGET) -> DataFrame:
    """K1 by :class:`MaxScore`."""
    return MaxScore(queries, docs, k1, b, budget).run()


# ---------------------------------------------------------------- dense top-k

def _merge_topk(qidx: np.ndarray, docno: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    pdf = pd.DataFrame({"q": qidx, "docno": docno, "score": score})
    pdf = pdf.sort_values(["q", "score", "docno"], ascending=[True, False, True], kind="mergesort")
    return pdf.groupby("q", sort=False).head(k)


def _exact_dots(dmat: np.ndarray, qmat: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Dot products of chosen pairs, added dimension by dimension: the same bits whatever the batch or partition."""
    out = np.zeros(len(rows))
    for j in range(dmat.shape[1]):
        out += dmat[rows, j] * qmat[cols, j]
    return out


def _topk_batches(batches, qids: np.ndarray, qmat: np.ndarray, k: int, tile_bytes: int = TILE_BYTES):
    """Per partition: exact top-k per query (ties by docno) over all batches.

    Batches are scored in tiles of at most ``tile_bytes``. A matrix product only
    preselects, with a margin for its rounding; the order is decided on :func:`_exact_dots`.
    """
    buf: list[pd.DataFrame] = []
    held = 0
    limit = max(4 * k * len(qids), 1 << 16)
    margin = 8 * qmat.shape[1] * np.finfo(float).eps
    qsize = np.linalg.norm(qmat, axis=1)

    def merged() -> pd.DataFrame:
        return _merge_topk(*(np.concatenate([b[c].to_numpy() for b in buf]) for c in ("q", "docno", "score")), k)

    for whole in batches:
        step = max(1, min(len(whole), 4096))
        for at in range(0, len(whole), step):
            pdf = whole.iloc[at:at + step]
            dmat = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            if dmat.shape[1] != qmat.shape[1]:
                raise ValueError("query and document vectors differ in length")
            slack = margin * np.linalg.norm(dmat, axis=1).max(initial=0)
            kk = min(k, len(dmat))
            wide = max(1, tile_bytes // (8 * len(dmat)))
            for lo in range(0, len(qids), wide):
                scores = dmat @ qmat[lo:lo + wide].T        # (docs in batch) x (queries in tile)
                least = np.partition(scores, len(dmat) - kk, axis=0)[len(dmat) - kk] - 2 * slack * qsize[lo:lo + wide]
                rows, cols = np.nonzero(scores >= least)     # top kk per query, ties included
                cols += lo
                part = _merge_topk(cols, pdf["docno"].to_numpy()[rows], _exact_dots(dmat, qmat, rows, cols), k)
                buf.append(part)
                held += len(part)
            if held > limit:
                buf = [merged()]
                held = len(buf[0])
    if buf:
        best = merged()
        yield pd.DataFrame({"qid": qids[best["q"].to_numpy()], "docno": best["docno"].to_numpy(),
                            "score": best["score"].to_numpy()})


def _empty_run() -> pd.DataFrame:
    return pd.DataFrame({"qid": pd.Series([], dtype=object), "docno": pd.Series([], dtype=object),
                         "score": pd.Series([], dtype=np.float64)})


def _block_topk(k: int):
    def fn(key, qpdf: pd.DataFrame, dpdf: pd.DataFrame) -> pd.DataFrame:
        if qpdf.empty or dpdf.empty:
            return _empty_run()
        qmat = np.stack(qpdf["vec"].to_numpy()).astype(np.float64)
        out = list(_topk_batches([dpdf[["docno", "vec"]]], qpdf["qid"].to_numpy(), qmat, k))
        return out[0] if out else _empty_run()
    return fn


RUN_SCHEMA = "qid string, docno string, score double"


def dense_retrieve(query_vecs: DataFrame, doc_vecs: DataFrame, k: int = DEFAULT_BUDGET,
                   broadcast_bytes: int = 64 << 20, doc_blocks: int | None = None) -> DataFrame:
    """Exact top-k documents per query by dot product; ``rank`` 0-based.

    Inputs: ``query_vecs[qid, vec]`` and ``doc_vecs[docno, vec]``. The query
    side is measured first (one small aggregate). If its matrix fits
    ``broadcast_bytes`` it is broadcast and every document partition scores
    its batches in tiles of ``TILE_BYTES``, keeping a per-partition top-k.
    Otherwise queries are hashed into blocks that each fit the budget, docs
    into ``doc_blocks`` blocks, and a cogroup on (query block, doc block)
    does the same per block pair; no side passes through the driver.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = doc_vecs.sparkSession
    n, dim = query_vecs.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not n:
        return spark.createDataFrame([], RUN_SCHEMA + ", rank int")
    need = int(n) * int(dim) * 8
    if need <= broadcast_bytes:
        rows = query_vecs.select("qid", "vec").collect()  # bounded by the check above
        qids = np.array([r["qid"] for r in rows], dtype=object)
        qmat = np.array([r["vec"] for r in rows], dtype=np.float64)
        bc = spark.sparkContext.broadcast((qids, qmat))

        def score_partition(batches):
            q, m = bc.value
            yield from _topk_batches(batches, q, m, k)

        cand = doc_vecs.select("docno", "vec").mapInPandas(score_partition, RUN_SCHEMA)
    else:
        qb = math.ceil(need / broadcast_bytes)
        db = doc_blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
        q = query_vecs.select("qid", "vec",
                              F.pmod(F.xxhash64("qid"), F.lit(qb)).alias("qb"),
                              F.explode(F.sequence(F.lit(0), F.lit(db - 1))).alias("db"))
        d = doc_vecs.select("docno", "vec",
                            F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"),
                            F.pmod(F.xxhash64("docno"), F.lit(db)).alias("db"))
        cand = q.groupBy("qb", "db").cogroup(d.groupBy("qb", "db")).applyInPandas(
            _block_topk(k), RUN_SCHEMA)
    return top_k(cand, k)
