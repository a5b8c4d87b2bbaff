"""Quality rules: plain base rules, then robust multivariate outliers (operator 2).

Every whole text gives a row of counts. Each count becomes a share, smoothed towards the share of its
group (``PSEUDO`` words), so a short text is not an outlier by chance alone. A group is one
(language, source); groups under ``MIN_GROUP`` texts pool by language, then all together.

Per group the minimum covariance determinant is found by concentration steps from two starts
(median / MAD distances, and spatial distances from the median): the texts with the smallest distances, at least 75 %, give a new mean
and covariance until ``STEPS`` are done; the start with the smaller determinant stays. Each step is
two aggregates over the narrow count table - a histogram of log distances whose
running sum gives the cut, and the moments below it - so no group is ever gathered in one task.
A text is rejected when its squared Mahalanobis distance exceeds the chi-square quantile of ``TAIL``.

Contract for odd rows: null text has no words and fails the base rules; null language or source
is a group of its own; groups under ``MIN_GROUP`` texts even after pooling reject nothing; constant statistics get the
variance floor; repeated rows are judged each, with equal results; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from taintrank.llm import _text
from taintrank.session import Scratch

WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20
PSEUDO = 60.0
MIN_GROUP = 50
SHARE = 0.75
STEPS = 4
TAIL = 1e-7
FLOOR = 0.02                 # least standard deviation of a statistic
BINS = 32                    # histogram bins per e-fold of squared distance
BROADCAST_GROUPS, BROADCAST_IDS = 100_000, 500_000

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_cells"]
STATS = ["length", "symbols", "upper", "marks", "repeats"]
P = len(STATS)

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1
_MARK = np.zeros(256, np.int64)
_MARK[list(b"!?;:=_~^\\/{}[]@")] = 1
_CELL = np.zeros(256, np.int64)
_CELL[list(b"|")] = 1


def _per_doc(weights: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(weights) + 1, np.int64)
    np.cumsum(weights, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(windows: np.ndarray) -> int:
    """Words covered by windows that stand twice or more in one text."""
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(windows) + WINDOW, np.int64)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def block_counts(block: _text.Block) -> dict[str, np.ndarray]:
    w = _text.words(block)
    h = _text.word_hashes(block, w)
    win = _text.window_hashes(h, WINDOW)
    data, offsets = block.data, block.offsets
    chars = ((data & 0xC0) != 0x80) & ~_text._SPACE[data]
    repeats = [repeat_words(win[a:b - WINDOW + 1]) if b - a >= 2 * 1 + WINDOW - 1 else 0
               for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist())]
    lines = [dup_lines(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return {"n_words": w.counts(), "word_chars": _per_doc(chars, offsets), "n_symbols": _per_doc(_SYMBOL[data], offsets),
            "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": np.array(repeats, np.int64),
            "n_upper": _per_doc(_UPPER[data], offsets), "n_letters": _per_doc(_LETTER[data], offsets),
            "n_marks": _per_doc(_MARK[data], offsets), "n_cells": _per_doc(_CELL[data], offsets)}


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _text.blocks(batch.column(3)):
            part = batch.slice(block.lo, block.hi - block.lo)
            yield _text.replace_columns(part, ["doc_id", "lang", "source"],
                                        {k: pa.array(v, pa.int64()) for k, v in block_counts(block).items()})


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every whole text."""
    picked = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    schema = f"doc_id {picked.dtypes[0][1]}, lang string, source string, " + ", ".join(f"{k} long" for k in COUNTS)
    return picked.mapInArrow(_measure, schema)


def chi2_cdf(x: float, df: int) -> float:
    """Regularised lower incomplete gamma by its series."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(q: float, df: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, df) < q else (lo, mid)
    return hi


def consistency(share: float = SHARE, df: int = P) -> float:
    """Factor that makes the covariance of the central ``share`` consistent for a normal group."""
    return share / chi2_cdf(chi2_quantile(share, df), df + 2)


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Moments of each (group, start) to mean, inverse covariance and log determinant."""
    scale = consistency()
    for batch in batches:
        means, inverses, dets = [], [], []
        for n, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("n", "s1", "s2"))):
            mean = np.array(s1, float) / n
            cov = np.zeros((P, P))
            cov[np.triu_indices(P)] = s2
            cov = cov + np.triu(cov, 1).T
            cov = (cov / n - np.outer(mean, mean)) * scale + np.eye(P) * FLOOR ** 2
            means.append(np.round(mean, 12).tolist())
            inverses.append(np.round(np.linalg.inv(cov), 9).ravel().tolist())
            dets.append(float(np.linalg.slogdet(cov)[1]))
        numbers = pa.list_(pa.float64())
        yield _text.replace_columns(batch, ["g", "start"], {"mean": pa.array(means, numbers), "inv": pa.array(inverses, numbers),
                                                            "logdet": pa.array(dets, pa.float64())})


_PARAMS = "g long, start int, mean array<double>, inv array<double>, logdet double"


def _distance(x: str = "x", mean: str = "mean", inv: str = "inv") -> F.Column:
    d = [F.col(x)[i] - F.col(mean)[i] for i in range(P)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + d[i] * d[j] * F.col(inv)[i * P + j] * (1.0 if i == j else 2.0)
    return total


def _cut(rows: DataFrame, tmp: Scratch) -> DataFrame:
    """Per (g, start): the bin of log distance at which SHARE of the texts is reached."""
    count = rows.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
    by = W.partitionBy("g", "start")
    run = count.withColumn("run", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return run.where(F.col("run") >= SHARE * F.col("all")).groupBy("g", "start").agg(F.min("bin").alias("cut"))


def _binned(rows: DataFrame, d2: F.Column) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.log(F.greatest(d2, F.lit(1e-9))) * BINS).cast("long"))


def _moments(rows: DataFrame) -> DataFrame:
    s1 = F.array(*[F.sum(F.col("x")[i]) for i in range(P)])
    s2 = F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(P) for j in range(i, P)])
    return rows.groupBy("g", "start").agg(F.count("*").alias("n"), s1.alias("s1"), s2.alias("s2"))


def _small(df: DataFrame, most: int = BROADCAST_GROUPS) -> DataFrame:
    """Broadcast a table only when it was counted to be small."""
    return F.broadcast(df) if df.count() <= most else df


def robust_distances(tmp: Scratch, rows: DataFrame) -> DataFrame:
    """``rows`` (g, x array<double>, ...) with d2, the squared robust distance inside g."""
    keys = [c for c in rows.columns if c not in ("x",)]
    bins = rows.select("g", F.posexplode("x").alias("k", "v"))
    step = 0.0005

    def median(df: DataFrame, out: str) -> DataFrame:
        c = df.withColumn("b", F.floor(F.col("v") / step)).groupBy("g", "k", "b").agg(F.count("*").alias("n"))
        by = W.partitionBy("g", "k")
        c = c.withColumn("run", F.sum("n").over(by.orderBy("b"))).withColumn("all", F.sum("n").over(by))
        return c.where("2 * run >= all").groupBy("g", "k").agg(((F.min("b") + 0.5) * step).alias(out))

    med = tmp.table(median(bins, "m"), "median")
    mad = median(bins.join(_small(med), ["g", "k"]).select("g", "k", F.abs(F.col("v") - F.col("m")).alias("v")), "a")
    centre = tmp.table(med.join(mad, ["g", "k"]).groupBy("g").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("m"),
        F.transform(F.array_sort(F.collect_list(F.struct("k", "a"))), lambda s: s["a"] * 1.4826).alias("a")), "centre")
    start = rows.select("g", "x").join(_small(centre), "g")
    plain = sum(((F.col("x")[i] - F.col("m")[i]) / F.greatest(F.col("a")[i], F.lit(FLOOR))) ** 2 for i in range(P))
    space = sum((F.col("x")[i] - F.col("m")[i]) ** 2 for i in range(P))
    first = start.select("g", "x", F.explode(F.array(F.struct(F.lit(0).alias("start"), plain.alias("d2")),
                                                     F.struct(F.lit(1).alias("start"), space.alias("d2")))).alias("s"))
    current = _binned(first.select("g", "x", "s.start", "s.d2"), F.col("d2"))
    params = None
    both = rows.select("g", "x", F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    for _ in range(STEPS):
        cut = tmp.table(_cut(current, tmp), "cut")
        inner = current.join(_small(cut), ["g", "start"]).where("bin <= cut")
        last, params = params, tmp.table(_moments(inner).mapInArrow(_invert, _PARAMS), "params")
        current = _binned(both.join(_small(params), ["g", "start"]), _distance())
        tmp.drop(cut, *([last] if last is not None else []))
    best = params.groupBy("g").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "start")).alias("p"))
    out = rows.join(_small(tmp.table(best.select("g", "p.mean", "p.inv"), "best")), "g")
    return out.select(*keys, F.greatest(_distance(), F.lit(0.0)).alias("d2"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2 per row."""
    tmp = Scratch(docs.sparkSession, "rules")
    counts = tmp.table(measure(docs), "counts")
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    # groups: (lang, source), pooled by language and then overall while they are small
    total = counts.groupBy("lang", "source").agg(*[F.sum(c).alias(f"t_{c}") for c in COUNTS], F.count("*").alias("n1"))
    total = total.withColumn("n2", F.sum(F.when(F.col("n1") < MIN_GROUP, F.col("n1"))).over(W.partitionBy("lang")))
    level = F.when(F.col("n1") >= MIN_GROUP, 0).when(F.col("n2") >= MIN_GROUP, 1).otherwise(2)
    total = total.withColumn("level", level).withColumn("g", F.xxhash64(
        "level", F.when(F.col("level") < 2, F.col("lang")), F.when(F.col("level") < 1, F.col("source")),
        F.when(F.col("level") < 2, F.col("lang").isNull()), F.when(F.col("level") < 1, F.col("source").isNull())))
    by = total.groupBy("g").agg(F.sum("n1").alias("size"), *[F.sum(f"t_{c}").alias(f"t_{c}") for c in COUNTS])
    groups = tmp.table(total.select("lang", "source", "g").join(by, "g"), "groups")

    def share(top: str, under: str, weight: float = 1.0) -> F.Column:
        centre = F.coalesce(F.try_divide(F.col(f"t_{top}"), F.col(f"t_{under}")), F.lit(0.0))
        return (F.col(top) + PSEUDO * weight * centre) / (F.col(under) + PSEUDO * weight)

    x = F.array(F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))), F.log1p(share("n_symbols", "n_words")),
                share("n_upper", "n_letters", 5.0), F.log1p(share("n_marks", "n_words")), share("n_repeat_words", "n_words"))
    known = counts.alias("c").join(_small(groups).alias("k"), F.col("c.lang").eqNullSafe(F.col("k.lang"))
                                   & F.col("c.source").eqNullSafe(F.col("k.source")))
    rows = tmp.table(known.select("doc_id", *COUNTS[:5], base.alias("base_failed"), "g", "size", x.alias("x")), "vectors")
    out = robust_distances(tmp, rows)
    limit = chi2_quantile(1 - TAIL, P)
    far = (F.col("size") >= MIN_GROUP) & (F.col("d2") > limit)
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.round("d2", 6).alias("d2"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep; all columns stay. Rows that repeat a doc_id go only if all of them fail."""
    found = judge(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("_kept")).where(~F.col("_kept")).select("_id")
    found = Scratch(docs.sparkSession, "rules-lost").table(found, "lost")
    return docs.join(_small(found, BROADCAST_IDS), docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")
