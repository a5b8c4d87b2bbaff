"""Quality classifier: nearest-neighbour voting over latent-semantic vectors (operator 1).

A text becomes counts of hashed terms: word shapes (runs of letter case, digits and marks), pairs of neighbouring shapes, a
repetition term for words equal to one of the four before, and the words themselves. Shares of these counts, weighted by the terms' rarity
among the labelled texts, are projected to ``RANK`` dimensions by a truncated singular value decomposition of the labelled texts and
normalised. The labelled vectors - at most ``SAMPLE``, drawn by hash of the id - are broadcast; every document's cosine
with all of them is one blocked matrix product, and its ``NEAREST`` neighbours vote with weights that grow with similarity.

Contract for odd rows: null and empty texts, and every text when nothing is labelled, get the
mean label (0.5 without labels); labels that are null, or whose id has no text, are not
learned from; cosines count to ``PLACES`` decimals, ties go to the first labelled row in hash order, so a score does not depend on
the partitions; repeated rows are scored each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _text

SAMPLE = 4096                # bound of the labelled sample, and of the broadcast vectors
SHAPES, PAIRS, CONTENT = 1024, 512, 511
TERMS = SHAPES + PAIRS + CONTENT + 1
RANK = 48
NEAREST = 31
SHARPNESS = 8
CUT = 0.3
PLACES = 6                   # decimals of a cosine; sums in another order differ far behind them
PIECE = 512                  # documents per matrix product

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48
_CLASS[128:] = 97
_CLASS[[9, 10, 11, 12, 13, 32]] = 32


def _shapes(block: _text.Block) -> np.ndarray:
    """One hash per word of its collapsed character classes."""
    kind = _CLASS[block.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    starts = block.offsets[:-1]
    keep[starts[starts < len(kind)]] = True
    place = np.concatenate(([0], np.cumsum(keep)))
    small = _text.Block(block.lo, block.hi, kind[keep], place[block.offsets])
    return _text.word_hashes(small, _text.words(small))


def terms(block: _text.Block) -> tuple[np.ndarray, np.ndarray]:
    """(documents x TERMS share matrix, words per document)."""
    w = _text.words(block)
    h, shape = _text.word_hashes(block, w), _shapes(block)
    count = w.counts()
    doc = np.repeat(np.arange(len(count)), count)
    n = len(count)
    pair = _text.mix(shape[:-1] * np.uint64(3) + shape[1:]) if len(shape) else shape
    same = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    again = np.zeros(len(h), bool)
    for back in range(1, 5):
        if len(h) > back:
            again[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    slot = np.concatenate([
        doc * TERMS + (shape % np.uint64(SHAPES)).astype(np.int64),
        doc[1:][same] * TERMS + SHAPES + (pair[same] % np.uint64(PAIRS)).astype(np.int64),
        doc * TERMS + SHAPES + PAIRS + (h % np.uint64(CONTENT)).astype(np.int64),
        doc[again] * TERMS + TERMS - 1])
    table = np.bincount(slot, minlength=n * TERMS).reshape(n, TERMS)
    return np.sqrt(table / np.maximum(count, 1)[:, None]), count


def _pieces(block: _text.Block) -> Iterator[_text.Block]:
    for a in range(0, block.hi - block.lo, PIECE):
        b = min(a + PIECE, block.hi - block.lo)
        lo, hi = block.offsets[a], block.offsets[b]
        yield _text.Block(block.lo + a, block.lo + b, block.data[lo:hi], block.offsets[a:b + 1] - lo)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row, ascending; the first of equal values."""
    last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
    above, equal = cosine > last, cosine == last
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1) <= room)))[1].reshape(len(cosine), k)


@dataclass
class Model:
    rarity: np.ndarray
    basis: np.ndarray        # TERMS x RANK
    vectors: np.ndarray      # labelled x RANK, unit length
    label: np.ndarray
    mean: float

    def embed(self, shares: np.ndarray) -> np.ndarray:
        v = (shares * self.rarity) @ self.basis
        size = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(size > 1e-12, size, 1)

    def score(self, shares: np.ndarray, words: np.ndarray) -> np.ndarray:
        if not len(self.label):
            return np.full(len(words), self.mean)
        cosine = np.round(self.embed(shares) @ self.vectors.T, PLACES)
        near = nearest(cosine, min(NEAREST, len(self.label)))
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS
        total = weight.sum(axis=1)
        vote = (weight * self.label[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where((words > 0) & (total > 0), np.clip(vote, 0, 1), self.mean)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _text.blocks(batch.column(2)):
            for piece in _pieces(block):
                shares, _ = terms(piece)
                rows, at = np.nonzero(shares)
                cut = np.searchsorted(rows, np.arange(len(shares) + 1))
                part = batch.slice(piece.lo, piece.hi - piece.lo)
                yield _text.replace_columns(part, ["key", "quality"], {
                    "at": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32())),
                    "share": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(shares[rows, at], pa.float32()))})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most SAMPLE labelled rows: ``labels`` (doc_id, quality) met with ``docs`` (doc_id, text)."""
    key = F.xxhash64(F.lit(11), F.col("doc_id"))
    some = (labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"), key.alias("key"))
            .orderBy("key", "doc_id", "quality").limit(SAMPLE))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("key", "quality", "text")
    rows = rows.mapInArrow(_labelled, "key long, quality int, at array<int>, share array<float>")
    got = rows.orderBy("key", "quality", "at", "share").limit(SAMPLE).toArrow()
    n = got.num_rows
    if not n:
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0), 0.5)
    x = np.zeros((n, TERMS))
    at, share = got.column("at").combine_chunks(), got.column("share").combine_chunks()
    owner = np.repeat(np.arange(n), np.diff(at.offsets.to_numpy()))
    x[owner, at.flatten().to_numpy()] = share.flatten().to_numpy()
    label = got.column("quality").to_numpy().astype(float)
    rarity = np.log((1 + n) / (1 + (x > 0).sum(axis=0))) + 0.3
    x *= rarity
    values, vectors = np.linalg.eigh(x.T @ x)
    basis = vectors[:, ::-1][:, :min(RANK, n)]
    model = Model(rarity, basis, np.zeros((0, 1)), label, float(label.mean()))
    model.vectors = model.embed(x / rarity)
    return model


def score(docs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``keys`` columns, score and predicted for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            got = [fitted.score(*terms(piece)) for block in _text.blocks(batch.column(len(keys))) for piece in _pieces(block)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield _text.replace_columns(batch, keys, {"score": pa.array(s), "predicted": pa.array((s >= CUT).astype(np.int32))})

    picked = docs.select(*keys, "text")
    schema = ", ".join(f"`{k}` {t}" for k, t in picked.dtypes[:-1]) + ", score double, predicted int"
    return picked.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labelled rows outside ``fold`` by crc32 of the id."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))
    model = train(docs, labels.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"])
