"""Pluggable pair scoring and encoding.

This is the only module that runs Python on executors. A *scorer factory*
is a picklable zero-argument callable returning the model; it is called
once per partition (the model is loaded once, as the reference loads it
once per transformer), and the model sees Arrow batches sliced to
``batch_size`` rows (R12). Everything around the model call - attaching
texts, deduplicating queries, the dot product, ranking - is native.

Model protocol:
* cross scorer: ``model(queries: list[str], texts: list[str]) -> np.ndarray``
  of shape (n,) (one score) or (n, c) (logits, duo scorers);
* encoder: ``model(texts: list[str]) -> np.ndarray`` of shape (n, dim).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain as _chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import joins
from .rank import add_ranks

DEFAULT_BATCH = 64
QUERY_BYTES = 16 << 20       # query texts that a task holds at once
MEMBERS = 4096               # queries that go with one copy of a document's text
ROWS = 8192                  # scored pairs held at once


def _batches(pdf: pd.DataFrame, size: int) -> Iterator[pd.DataFrame]:
    for start in range(0, len(pdf), size):
        yield pdf.iloc[start:start + size]


def score_pairs(df: DataFrame, factory: Callable, query: str = "query", text: str = "text",
                out: str = "score", batch_size: int = DEFAULT_BATCH, logits: bool = False,
                keep: Sequence[str] | None = None) -> DataFrame:
    """K2/K3: score every (query, text) row with a cross scorer.

    Pass only the columns you need: ``mapInPandas`` hides them from column
    pruning. ``keep`` names the columns that come back with the score (default all): leave
    the texts out. ``logits=True`` keeps the model's full output as
    ``array<double>`` (pair / duo scorers, P10).
    """
    out_type = "array<double>" if logits else "double"
    keep = list(df.columns if keep is None else keep)
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{out}` {out_type}"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in it:
            if pdf.empty:
                continue
            if model is None:
                model = factory()
            parts = []
            for b in _batches(pdf, batch_size):
                s = np.asarray(model(b[query].fillna("").tolist(), b[text].fillna("").tolist()),
                               dtype=np.float64)
                b = b[keep].copy()
                b[out] = list(s) if logits else s.reshape(-1)
                parts.append(b)
            yield pd.concat(parts)

    return df.mapInPandas(run, schema)


def _scored(docs: Iterator[tuple[str, str, dict[str, list]]], factory: Callable, query_of: Callable[[str], str], columns: list[str],
            out: str, logits: bool, batch_size: int, model: list) -> Iterator[pd.DataFrame]:
    """Pairs of (docno, text, lists of pair columns), in batches over document borders; ``model`` keeps what the factory made."""
    held: dict[str, list] = {c: [] for c in ["docno", *columns]}
    queries: list[str] = []
    texts: list[str] = []

    def flush() -> pd.DataFrame:
        if not model:
            model.append(factory())
        parts = [np.asarray(model[0](queries[i:i + batch_size], texts[i:i + batch_size]), dtype=np.float64) for i in range(0, len(texts), batch_size)]
        held[out] = list(_chain.from_iterable(parts)) if logits else np.concatenate([x.reshape(-1) for x in parts])
        return pd.DataFrame(held)

    for docno, text, lists in docs:
        n = len(lists["qid"])
        held["docno"] += [docno] * n
        for c in columns:
            held[c] += list(lists[c])
        queries += [query_of(q) or "" for q in lists["qid"]]
        texts += [text or ""] * n
        if len(texts) >= ROWS:
            yield flush()
            held, queries, texts = {c: [] for c in ["docno", *columns]}, [], []
    if texts:
        yield flush()


def score_by_document(pairs: DataFrame, queries: DataFrame, docs: DataFrame, factory: Callable, out: str = "score",
                      batch_size: int = DEFAULT_BATCH, logits: bool = False, strict: bool = True, text_field: str = "text",
                      query_bytes: int = QUERY_BYTES, members: int = MEMBERS) -> DataFrame:
    """K2/K3 with texts by id: ``pairs[qid, docno, ...]`` scored on ``queries[qid, query]`` and ``docs[docno, text]``.

    Pairs are grouped by document before a text is attached, so a text is shuffled and sent to Python once, however many
    queries ask for it (once per ``members`` of them: a hot document is split). Query texts are measured: within ``query_bytes``
    every task holds them all; beyond that they are dealt into blocks of that size, a text is sent once per block, and a task
    reads a block's queries and then streams its documents. ``strict`` fails on unknown ids (J4), else their text is empty (J3). Ids are
    unique in ``queries`` and ``docs``; the columns of ``pairs`` come back with the score.
    """
    spark = pairs.sparkSession
    columns = [c for c in pairs.columns if c != "docno"]
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("query") + F.octet_length("qid") + 64), F.lit(0))).first()
    blocks = max(1, -(-size // query_bytes))
    keyed = pairs.withColumn("_qb", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("_part", F.lit(0).cast("long"))
    if n > members:
        many = pairs.groupBy("docno").agg(F.ceil(F.count("*") / members).alias("_n")).where("_n > 1")
        keyed = keyed.join(joins.broadcast_if_small(many), "docno", "left").withColumn(
            "_part", F.pmod(F.xxhash64("qid", F.lit(5)), F.coalesce("_n", F.lit(1)))).drop("_n")
    grouped = keyed.groupBy("docno", "_qb", "_part").agg(*[F.collect_list(F.struct(F.col(c).alias("v"))).alias(c) for c in columns])
    grouped = grouped.select("docno", "_qb", *[F.col(f"{c}.v").alias(c) for c in columns])
    attach = joins.attach_text_strict if strict else joins.attach_text
    rows = attach(grouped, docs, key="docno", text_field=text_field, as_col="_text")
    kind = "array<double>" if logits else "double"
    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in ["docno", *columns]] + [f"`{out}` {kind}"])

    def looked_up(known: dict[str, str]) -> Callable[[str], str]:
        def get(qid):
            if strict and qid not in known:
                raise ValueError(f"unknown qid: {qid}")
            return known.get(qid)
        return get

    def rows_of(pdf: pd.DataFrame) -> Iterator[tuple[str, str, dict[str, list]]]:
        for r in zip(pdf["docno"], pdf["_text"], *(pdf[c] for c in columns)):
            yield r[0], r[1], dict(zip(columns, r[2:]))

    if blocks == 1:
        shared = spark.sparkContext.broadcast({r.qid: r.query for r in queries.select("qid", "query").collect()})   # at most query_bytes

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model: list = []
            get = looked_up(shared.value)
            yield from _scored(_chain.from_iterable(map(rows_of, it)), factory, get, columns, out, logits, batch_size, model)

        return rows.select("docno", "_text", *columns).mapInPandas(run, schema).select(*pairs.columns, out)

    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("docno"), F.lit(deals)).cast("int")).withColumn("_is", F.lit(1))
    asked = queries.select(F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int").alias("_qb"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("_at"),
                           F.lit(0).alias("_is"), F.col("qid").alias("docno"), F.col("query").alias("_text"))
    dealt = (rows.unionByName(asked, allowMissingColumns=True).repartition("_qb", "_at").sortWithinPartitions("_qb", "_at", "_is")
             .select("_qb", "_at", "_is", "docno", "_text", *columns))

    def run_blocks(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: list = []
        known: dict[str, str] = {}
        at = None
        for pdf in it:
            for (qb, deal, what), g in pdf.groupby(["_qb", "_at", "_is"], sort=False):
                if at != (qb, deal):
                    at, known = (qb, deal), {}
                if what == 0:
                    known.update(zip(g["docno"], g["_text"]))
                else:
                    yield from _scored(rows_of(g), factory, looked_up(known), columns, out, logits, batch_size, model)

    return dealt.mapInPandas(run_blocks, schema).select(*pairs.columns, out)


def encode(df: DataFrame, factory: Callable, text: str, out: str,
           batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """K6: batch-encode ``text`` into ``out array<double>``; empty in -> empty out."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
                       + [f"`{out}` array<double>"])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for pdf in it:
            if pdf.empty:
                continue
            if model is None:
                model = factory()
            parts = []
            for b in _batches(pdf, batch_size):
                vecs = np.asarray(model(b[text].fillna("").tolist()), dtype=np.float64)
                b = b.copy()
                b[out] = list(vecs)
                parts.append(b)
            yield pd.concat(parts)

    return df.mapInPandas(run, schema)


def encode_queries(df: DataFrame, factory: Callable, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """K4: encode each *distinct* query text once, join ``query_vec`` back."""
    qv = encode(df.select("query").distinct(), factory, "query", "query_vec", batch_size)
    return df.join(qv, "query", "left")


def encode_docs(df: DataFrame, factory: Callable, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """K5: encode each distinct text once, join ``doc_vec`` back. No ``docno`` is asked for, and two texts under one id get two vectors.

    Texts meet their vectors by two 64-bit hashes, so that no text is a join key.
    """
    h = [F.xxhash64("text").alias("_h1"), F.xxhash64("text", F.lit(1)).alias("_h2")]
    dv = encode(df.select("text", *h).dropDuplicates(["_h1", "_h2"]), factory, "text", "doc_vec", batch_size).drop("text")
    return df.withColumns({"_h1": h[0], "_h2": h[1]}).join(dv, ["_h1", "_h2"], "left").drop("_h1", "_h2")


# The reference's bi-encoder input modes, in dispatch order.
BI_MODES = (("qid", "query", "text"), ("qid", "query_vec", "text"), ("qid", "query", "doc_vec"),
            ("qid", "query_vec", "doc_vec"), ("query",), ("text",))


def bi_transform(df: DataFrame, query_factory: Callable | None = None,
                 doc_factory: Callable | None = None, batch_size: int = DEFAULT_BATCH) -> DataFrame:
    """P9 + K7: dispatch on the columns present (first match wins).

    Pair modes encode whichever side is missing, then score with a native
    dot product and rank (W1). ``(query)`` / ``(text)`` only encode.
    """
    cols = set(df.columns)
    doc_factory = doc_factory or query_factory  # tied encoders share one model
    for mode in BI_MODES:
        if set(mode) <= cols:
            break
    else:
        raise RuntimeError(f"Unknown input columns {sorted(cols)}; supported modes are {BI_MODES}")
    if mode == ("query",):
        return encode_queries(df, query_factory, batch_size)
    if mode == ("text",):
        return encode_docs(df, doc_factory, batch_size)
    if "query_vec" not in mode:
        df = encode_queries(df, query_factory, batch_size)
    if "doc_vec" not in mode:
        df = encode_docs(df, doc_factory, batch_size)
    return add_ranks(df.withColumn("score", V.dot("query_vec", "doc_vec")))


def in_batch_scores(batches: DataFrame, query_vecs: DataFrame, doc_vecs: DataFrame) -> DataFrame:
    """V6, two-dimensional form: ``batch, qid, docno, score`` of every query of a batch against every document of it.

    ``batches[batch, qid, docnos]``: the groups of each batch. A batch is a join key, so the output is bounded by the size
    of a batch squared times the group size. Each distinct query and document of a batch counts once; ids without a vector are dropped (J8).
    """
    q = batches.select("batch", "qid").distinct().join(query_vecs.select("qid", F.col("vec").alias("_q")), "qid")
    d = batches.select("batch", F.explode("docnos").alias("docno")).distinct().join(doc_vecs.select("docno", F.col("vec").alias("_d")), "docno")
    return q.join(d, "batch").select("batch", "qid", "docno", V.dot("_q", "_d").alias("score"))


def chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """``a >> b`` as one function for ``DataFrame.transform``."""
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df
    return run


# ---------------------------------------------------------------- built-in test models

def _word_tokens(text: str) -> list[str]:
    import regex
    return [t for t in regex.split(r"[^\p{L}\p{N}_]+", text.lower()) if t]


class TokenOverlapScorer:
    """Cross scorer: number of distinct query tokens present in the text."""

    KEPT = 4 << 20           # characters of texts whose tokens are kept between batches

    def __init__(self):
        self._seen: dict[str, frozenset] = {}
        self._chars = 0

    def _tokens(self, text: str) -> frozenset:
        found = self._seen.get(text)
        if found is None:
            if self._chars > self.KEPT:
                self._seen, self._chars = {}, 0
            found = self._seen[text] = frozenset(_word_tokens(text))
            self._chars += len(text)
        return found

    def __call__(self, queries: Sequence[str], texts: Sequence[str]) -> np.ndarray:
        return np.array([len(self._tokens(q) & self._tokens(t)) for q, t in zip(queries, texts)], dtype=np.float64)


class OverlapLogitsScorer(TokenOverlapScorer):
    """Pair scorer returning two logits ``[-overlap, overlap]`` (duo / P10 tests)."""

    def __call__(self, queries: Sequence[str], texts: Sequence[str]) -> np.ndarray:
        s = super().__call__(queries, texts)
        return np.stack([-s, s], axis=1)


def token_bucket(token: str, dim: int) -> int:
    """Stable bucket of a token: first 15 hex digits of its md5, modulo ``dim``."""
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:15], 16) % dim


class HashedBowEncoder:
    """Encoder: hashed bag-of-words counts (``dim`` buckets, md5 bucket rule)."""

    def __init__(self, dim: int = 1024):
        self.dim = dim
        self._buckets: dict[str, int] = {}  # per-task memo of token -> bucket

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        memo = self._buckets
        for i, t in enumerate(texts):
            for tok in _word_tokens(t):
                b = memo.get(tok)
                if b is None:
                    b = memo[tok] = token_bucket(tok, self.dim)
                out[i, b] += 1.0
        return out


def teacher_scores(factory: Callable, corpus: DataFrame | None = None,
                   pairs: DataFrame | None = None, queries: DataFrame | None = None,
                   docs: DataFrame | None = None, subset: int | None = None,
                   seed: int = 42, batch_size: int = DEFAULT_BATCH, negatives: DataFrame | None = None) -> DataFrame:
    """Score a corpus ``(qid, docno, query, text)``, or build it from
    ``pairs`` + ``queries`` + ``docs`` (lenient text attach, J3); neither -> error.
    A pair that comes many times is scored once and its row repeated.
    ``pairs`` may be triples (``query_id, doc_id_a, ...``), pivoted here; ``negatives`` (``qid, docnos``) then replaces
    their negatives (R2). ``subset`` samples that many pairs first (A2), before any text is attached."""
    from .joins import attach_text
    from .reshape import pivot_pairs, pivot_with_negatives
    from .sampling import sample_n
    if corpus is None and pairs is None:
        raise ValueError("give a corpus, or pairs with queries and docs")
    if corpus is not None:
        for c in ("query", "text"):
            if c not in corpus.columns:
                raise ValueError(f"{c} not found in corpus")
    else:
        if queries is None or docs is None:
            raise ValueError("pairs need queries and docs")
        if "doc_id_a" in pairs.columns:
            pairs = pivot_with_negatives(pairs, negatives) if negatives is not None else pivot_pairs(pairs)
        pairs = pairs.select("qid", "docno")
        if subset:
            pairs = sample_n(pairs, subset, ["qid", "docno"], seed)
        pairs = pairs.groupBy("qid", "docno").agg(F.count(F.lit(1)).alias("_times"))
        corpus = attach_text(attach_text(pairs, queries, "qid", "query"), docs, "docno", "text").select("docno", "qid", "query", "text", "_times")
        scored = score_pairs(corpus, factory, batch_size=batch_size)
        return scored.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times", "_time")
    return score_pairs(corpus, factory, batch_size=batch_size)
