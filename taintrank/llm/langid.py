"""Language identification: multinomial naive Bayes over hashed character n-grams (operator 5).

Training counts n-grams of every labelled text inside the tasks (one count array per
language), sums them by (language, bucket) and turns them into one matrix of log probabilities.
The matrix is broadcast; its size is fixed by ``MATRIX_BYTES``: with more languages the number of buckets
is halved until it fits. Scoring gathers the matrix rows of a text's n-grams and adds them up per text in numpy.

Text is lower-cased; every run of non-letters becomes one space; n-grams of 1 to 3 characters
over the whole text count, those across two texts do not.

Contract for odd rows: null text or text without a letter gives ``und`` with score 0; so does every text when no
language was learned; equal scores go to the smaller language name; rows with null language are scored
but never learned from; repeated rows are scored each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _text

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
MATRIX_BYTES = 64 << 20      # bound of the broadcast matrix
SMOOTHING = 0.5
UNKNOWN = "und"

_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def normalised(block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
    """(code points, document of each) of the lower-cased, space-folded texts; document -1 marks the gaps between texts."""
    parts = [block.text(i).replace("\x00", " ") for i in range(block.hi - block.lo)]
    code = np.frombuffer(("\x00" + "\x00".join(parts) + "\x00").lower().encode("utf-32-le"), np.uint32)
    gap = code == 0
    letter = _letters()[code]
    doc = np.cumsum(gap) - 1
    code = np.where(letter | gap, code, np.uint32(32))
    space = code == 32
    keep = np.ones(len(code), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    doc = np.where(gap, -1, doc)
    return code[keep], doc[keep]


def ngrams(code: np.ndarray, doc: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, document) of the n-grams of every order."""
    wide = code.astype(np.uint64)
    for n in ORDERS:
        m = len(wide) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        inside = np.ones(m, bool)
        for j in range(n):
            h += (wide[j:j + m] + np.uint64(1)) * _K[j]
            inside &= doc[j:j + m] >= 0
        if n == 1:
            inside &= code != 32
        yield (_text.mix(h[inside]) & np.uint64(buckets - 1)).astype(np.int64), doc[:m][inside]


def _count(buckets: int):
    def flush(found: dict[str, np.ndarray], docs: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()),
                 pa.array(np.append(counts[at], docs[lang]), pa.int64())], names=["lang", "bucket", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for block in _text.blocks(batch.column(0)):
                own = langs[block.lo:block.hi]
                code, doc = normalised(block)
                grams = [np.concatenate(x) for x in zip(*ngrams(code, doc, buckets))] or [np.zeros(0, np.int64)] * 2
                names, index = np.unique(own.astype(str), return_inverse=True)
                for k, lang in enumerate(names.tolist()):
                    docs[lang] = docs.get(lang, 0) + int((index == k).sum())
                    got = np.bincount(grams[0][index[grams[1]] == k], minlength=buckets)
                    found[lang] = found[lang] + got if lang in found else got
            if len(found) > 128:
                yield from flush(found, docs)
                found, docs = {}, {}
        yield from flush(found, docs)
    return run


def train(rows: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities [buckets, languages], log priors) from all ``rows`` (text, lang)."""
    rows = rows.where("lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    n_lang = rows.select("lang").distinct().count()
    buckets = BUCKETS
    while buckets > 256 and buckets * n_lang * 4 > MATRIX_BYTES:
        buckets //= 2
    counts = (rows.mapInArrow(_count(buckets), "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    langs = sorted(set(counts.column("lang").to_pylist()))
    where = {x: k for k, x in enumerate(langs)}
    lang = np.array([where[x] for x in counts.column("lang").to_pylist()], np.int64)
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    table = np.full((buckets, len(langs)), SMOOTHING)
    gram = bucket >= 0
    table[bucket[gram], lang[gram]] += n[gram]
    prior = np.zeros(len(langs))
    prior[lang[~gram]] = n[~gram]
    with np.errstate(divide="ignore"):
        return langs, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / max(prior.sum(), 1))


def score_block(block: _text.Block, langs: list[str], logp: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    size = block.hi - block.lo
    code, doc = normalised(block)
    total = np.zeros((size, len(langs)))
    lettered = np.zeros(size, bool)
    lettered[doc[(doc >= 0) & (code != 32)]] = True
    if not langs:
        return [UNKNOWN] * size, np.zeros(size)
    for bucket, owner in ngrams(code, doc, len(logp)):
        for k in range(len(langs)):
            total[:, k] += np.bincount(owner, weights=logp[bucket, k], minlength=size)
    total += prior
    best = total.argmax(axis=1)
    share = np.exp(total - total.max(axis=1, keepdims=True))
    sure = 1.0 / share.sum(axis=1)
    return ([langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, sure, 0.0))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keys: list[str]) -> DataFrame:
    """``keys`` columns, lang_pred and score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp, prior = shared.value
        for batch in batches:
            names: list[str] = []
            scores: list[np.ndarray] = []
            for block in _text.blocks(batch.column(len(keys))):
                a, b = score_block(block, langs, logp, prior)
                names += a
                scores.append(b)
            yield _text.replace_columns(batch, keys, {
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())})

    picked = docs.select(*keys, "text")
    schema = ", ".join(f"`{k}` {t}" for k, t in picked.dtypes[:-1]) + ", lang_pred string, score double"
    return picked.mapInArrow(run, schema)


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows outside ``fold`` by crc32 of the id."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = train(rows.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"))
    return predict(rows, model, ["doc_id", "held_out"])
