"""Training-order materialisation: a keyed permutation of all token sequences in fixed-stride shards (operator 3).

Texts are encoded and cut into sequences of ``length`` tokens. Every sequence has a number: input splits get disjoint
ranges of numbers by the byte lengths of their texts (a text has no more tokens than bytes), and count up inside. A keyed Feistel
network with cycle-walking - a bijection of all numbers - maps the number to a key, and the order of the keys is the training order: no global sort is needed to
shuffle, and texts are encoded once. Keys are dealt into shards by range; the task of a range sorts its own
and writes files of equal records. Numbers that no sequence took leave no gap: a slot is a shard's offset (the running sum of
the shards' sizes, known from their file lengths) plus the place in the file, so record ``i`` of a shard
stands at byte ``i * stride``. Spark's writer commits the files: lost executors and repeated tasks leave each
record once, in any store that Spark reaches.

A record is doc_id (8 bytes, little-endian), sequence number in the text (4), the ids (2 or 4 bytes each, by the
vocabulary; the rest filled with the largest number) and a line feed. A reader that stopped goes on at any slot by arithmetic.

Contract for odd rows: null and empty texts, and texts without tokens, have no sequences; a null doc_id is written as the
smallest integer and read back as null; repeated rows have sequences each; texts of any length are encoded whole; extra
columns are ignored; an empty table writes no shard and reads as an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taintrank.llm import _text

LENGTH = 256
SHARD = 1 << 13              # sequences in a shard, about
ROUNDS = 6
NO_ID = -2**63


class Encoder:
    """A byte-level vocabulary file of ranks, loaded once per Python worker."""

    _made: dict[tuple[str, str], Encoder] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Encoder:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.kind = np.dtype("<u2" if self.size < 2**16 else "<u4")
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), self.kind)


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slots of sequence numbers ``index`` under the keyed permutation of 0..n-1."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _text.mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(_text._MUL) + np.uint64(key % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_text.mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():                   # walk the cycle back into the range
        out[far] = once(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """How the records of one run are laid out."""

    numbers: int             # size of the permuted range
    shards: int
    length: int
    width: int               # bytes of an id

    @property
    def stride(self) -> int:
        return 12 + self.length * self.width + 1

    @property
    def kind(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")


def _records(vocabulary: tuple[str, str], layout: Layout, key: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, first = Encoder.of(*vocabulary), shared.value
        at: dict[tuple[str, int], int] = {}
        fill = np.iinfo(layout.kind).max
        for batch in batches:
            files, starts, ids = (batch.column(i).to_pylist() for i in range(3))
            for block in _text.blocks(batch.column(3)):
                number, out = [], []
                for i in range(block.hi - block.lo):
                    if block.offsets[i] == block.offsets[i + 1]:
                        continue
                    row = block.lo + i
                    split = (files[row], starts[row])
                    here = at.get(split, first.get(split, 0))
                    tokens = encoder.encode(block.text(i))
                    count = -(-len(tokens) // layout.length)
                    at[split] = here + count
                    body = np.full((count, layout.length), fill, layout.kind)
                    body.ravel()[:len(tokens)] = tokens
                    head = (NO_ID if ids[row] is None else ids[row]).to_bytes(8, "little", signed=True)
                    number += range(here, here + count)
                    out += [head + k.to_bytes(4, "little") + x.tobytes() for k, x in enumerate(body)]
                place = permute(np.array(number, np.int64), layout.numbers, key) if number else np.zeros(0, np.int64)
                shard = (place.astype(object) * layout.shards // layout.numbers).astype(np.int64) if layout.numbers * layout.shards >= 2**63 else (
                    place * layout.shards // layout.numbers)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(place), pa.array(out, pa.binary())], names=["shard", "place", "record"])
    return run


def materialise(docs: DataFrame, vocabulary: tuple[str, str], path: str, key: int = 1, length: int = LENGTH, shard: int = SHARD) -> Layout:
    """Write the shards of ``docs`` (read from files: doc_id, text) under ``path``; returns their layout."""
    spark = docs.sparkSession
    rows = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text")
    most = F.ceil(F.octet_length("text") / length)
    splits = rows.groupBy("file", "start").agg(F.coalesce(F.sum(most), F.lit(0)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    first, numbers, size = {}, 0, 0
    for r in splits.orderBy("file", "start").collect():          # one row per input split
        first[r["file"], r["start"]] = numbers
        numbers += int(r["n"])
        size += int(r["bytes"] or 0)
    encoder = Encoder.of(*vocabulary)
    layout = Layout(numbers, max(1, -(-size // (3 * length * shard))), length, encoder.kind.itemsize)
    shared = spark.sparkContext.broadcast(first)
    made = rows.mapInArrow(_records(vocabulary, layout, key, shared), "shard long, place long, record binary")
    ranges = max(1, min(layout.shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    made = made.repartition(F.floor(F.col("shard") * ranges / layout.shards)).sortWithinPartitions("shard", "place")
    # the line separator ends each record; the bytes of the others pass through the text writer unchanged
    (made.select("shard", F.col("record").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n")
     .option("compression", "none").partitionBy("shard").text(path))
    return layout


def shard_table(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """shard, n, first (the slot of its first record): one row per file, from file lengths alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    n = files.select(F.col("shard").cast("long").alias("shard"), (F.col("length") / layout.stride).cast("long").alias("n"))
    return n.withColumn("first", F.sum("n").over(W.orderBy("shard")) - F.col("n"))


def _parse(layout: Layout, begin: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, layout.stride)
                slot = first + np.arange(len(raw))
                raw, slot = raw[slot >= begin], slot[slot >= begin]
                doc = np.ascontiguousarray(raw[:, :8]).view("<i8").ravel()
                seq = np.ascontiguousarray(raw[:, 8:12]).view("<i4").ravel()
                ids = np.ascontiguousarray(raw[:, 12:-1]).view(layout.kind)
                size = (ids != np.iinfo(layout.kind).max).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slot), pa.array(doc, mask=doc == NO_ID), pa.array(seq.astype(np.int64)), pa.array(size.astype(np.int64)),
                     pa.array([x[:n].astype("<u4").tobytes() for x, n in zip(ids, size.tolist())], pa.binary())],
                    names=["slot", "doc_id", "seq_no", "n_tokens", "ids"])
    return run


def read(spark: SparkSession, path: str, layout: Layout, begin: int = 0) -> DataFrame:
    """slot, doc_id, seq_no, n_tokens, ids (little-endian unsigned 32-bit) from slot ``begin`` on."""
    schema = "slot long, doc_id long, seq_no long, n_tokens long, ids binary"
    if not layout.numbers:
        return spark.createDataFrame([], schema)
    wanted = shard_table(spark, path, layout).where(F.col("first") + F.col("n") > begin)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    files = files.select(F.col("shard").cast("long").alias("shard"), "content").join(F.broadcast(wanted), "shard")   # a row per file
    return files.select("first", "content").mapInArrow(_parse(layout, begin), schema)
