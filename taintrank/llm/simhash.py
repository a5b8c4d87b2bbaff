"""SimHash near-duplicates found with BK-trees (operator 12).

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its 4-word shingles, repeats
included. Texts are read in pieces of ``PIECE`` bytes with the last words and the bit counts carried on, so a long text
costs no more memory than a piece (or than its longest word).

Equal fingerprints are one class (a partial aggregate). Two fingerprints that differ in at most ``RADIUS`` bits
agree on at least ``m - RADIUS`` of any ``m`` blocks of the 64 bits, so every choice of that many blocks is a
table whose buckets share these bits: every link stands in a bucket, none is lost. The number of blocks follows the number of classes
(:func:`blocks_for`), so that buckets stay small; any number gives the same links.

Each bucket is a shard with a BK-tree of its own: a child hangs on its parent by its integer Hamming distance, and a
search follows only edges within the radius of the distance to the node. A bucket of more than ``SHARD`` members
is dealt into parts, and every two parts meet in a shard, so no tree outgrows that bound. All trees together hold all fingerprints,
so they reach their queries through the shuffle (a bucket's members are its queries), never through the driver. Many trees are built and searched at once in numpy, level by level.
Inside a shard, members within the radius of its centre (the member next to the bitwise majority) are connected already;
trees hold the others, and a shard hands on a spanning forest, at most one edge a member, never its pairs.

Contract for odd rows: a null, empty or wordless text has the fingerprint zero and is linked like any other; fewer than four
words are one shingle; rows that repeat a doc_id are one document linked by all its texts; a row without doc_id keeps its fingerprint, has no
component and links nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm.neardup import components
from taintrank.session import Scratch

SHINGLE, SEED, RADIUS = 4, 42, 4
PIECE = 1 << 20              # bytes of a text read at once
SHARD = 4096                 # members of one tree
CHUNK = 1 << 16              # members whose trees are built and searched at once
FRONTIER = 1 << 20           # (query, node) pairs held at once
BUCKET = 1024                # members that blocks_for allows an average bucket

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U1 = np.uint64(1)


# ------------------------------------------------------------------ fingerprints

def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The lower-cased words of a text, piece by piece; no word is cut."""
    if len(text) <= size:
        yield text.lower().split()
        return
    lo = 0
    while lo < len(text):
        hi = len(text)
        if lo + size < hi:
            cut = _SPACE.search(text, lo + size)
            hi = cut.start() if cut else hi
        yield text[lo:hi].lower().split()
        lo = hi


def _hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of all windows of SHINGLE words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1:] - 1).tolist())), np.uint64, len(starts))


def _bits(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each bit, the lowest first."""
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, size: int = PIECE) -> int:
    total, n, carry = np.zeros(64, np.int64), 0, []
    for words in pieces(text, size):
        words = carry + words
        for lo in range(0, len(words) - SHINGLE + 1, CHUNK):
            h = _hashes(words[lo:lo + CHUNK + SHINGLE - 1])
            total, n = total + _bits(h), n + len(h)
        carry = words[-(SHINGLE - 1):]
    if not n and carry:
        total, n = _bits(np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)), 1
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.zeros(len(batch), np.uint64)
        for i, t in enumerate(batch.column(1).cast(pa.large_binary())):
            if t.is_valid:
                fp[i] = fingerprint(t.as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


# ------------------------------------------------------------------ BK-trees

def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees over distinct fingerprints, one per shard number; built and searched level by level."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray, shards: int):
        self.fp = fp
        self.root = np.full(shards, -1)
        own, first = np.unique(shard, return_index=True)
        self.root[own] = first
        rest = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        node = self.root[shard[rest]]
        edges, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(rest):
            edge = node * 65 + distance(fp[rest], fp[node])
            keys, first, group = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            children.append(rest[first])
            down = np.ones(len(rest), bool)
            down[first] = False                        # these are the new children, the others go below them
            node, rest = rest[first][group][down], rest[down]
        edge = np.concatenate(edges)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], np.concatenate(children)[order]

    def search(self, fp: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) pairs within the radius, a bounded number of visits at a time."""
        start = np.flatnonzero(self.root[shard] >= 0)
        todo = [(start, self.root[shard[start]])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = distance(fp[q], self.fp[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            lo = np.searchsorted(self.edge, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.edge, node * 65 + np.minimum(d + radius, 64), "right")
            n = hi - lo
            if n.any():
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                todo.append((np.repeat(q, n), self.child[at]))


class Union:
    """Connected members of a chunk; ``label`` is the smallest index each one reaches so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                jumped = self.label[self.label]
                if (jumped == self.label).all():
                    break
                self.label = jumped


def centres(fp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every shard (rows from ``first`` on) the member next to the bitwise majority."""
    size = np.diff(np.append(first, len(fp)))
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    major = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > size[:, None], axis=1, bitorder="little").view("<u8").ravel()
    shard = np.repeat(np.arange(len(first)), size)
    order = np.lexsort((fp, distance(fp, major[shard]), shard))
    return order[first]


def connect(fp: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Labels of the members of whole shards (numbered from 0, in order), linked within the radius."""
    first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    union = Union(len(fp))
    centre = centres(fp, first)[shard]
    near = distance(fp, fp[centre]) <= RADIUS
    union.add(np.flatnonzero(near), centre[near])
    rest = np.flatnonzero(~near)
    if len(rest):
        forest = Forest(fp[rest], shard[rest], len(first))
        # the others are in no tree: a link between two of them joins what the centre has joined
        for q, node in forest.search(fp, shard):
            union.add(q, rest[node])
    return union.label


def connect_away(fp: np.ndarray, shard: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Labels after the ``query`` rows of each shard are searched in a tree of its other rows."""
    union = Union(len(fp))
    held, asked = np.flatnonzero(~query), np.flatnonzero(query)
    if len(held) and len(asked):
        forest = Forest(fp[held], shard[held], int(shard[-1]) + 1)
        for q, node in forest.search(fp[asked], shard[asked]):
            union.add(asked[q], held[node])
    return union.label


# ------------------------------------------------------------------ Spark

_KEYS = ["t", "key", "i", "j"]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole shards of a sorted partition, about CHUNK rows at a time; yields spanning edges."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        ids, fp, query = (table.column(c).to_numpy() for c in ("id", "fp", "query"))
        new = np.zeros(len(ids), np.int64)
        for c in _KEYS:
            v = table.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        shard, fp = np.cumsum(new), fp.view(np.uint64)
        label = connect_away(fp, shard, query) if query.any() else connect(fp, shard)
        a, b = ids[label], ids
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], names=["a", "b"])

    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        rows += len(batch)
        if rows >= CHUNK:
            table = pa.Table.from_batches(kept).combine_chunks()
            last = np.ones(rows, bool)
            for c in _KEYS:
                v = table.column(c).to_numpy()
                last &= v == v[-1]
            cut = rows - int(last.sum())                   # the last shard may go on in the next batch
            if cut:
                yield solve(table.slice(0, cut))
            kept, rows = table.slice(cut).to_batches(), rows - cut
    if rows:
        yield solve(pa.Table.from_batches(kept).combine_chunks())


def blocks_for(classes: int) -> int:
    """The least number of bit blocks whose tables keep an average bucket at BUCKET members."""
    m = RADIUS + 1
    while classes > BUCKET * 2.0 ** (64 * (m - RADIUS) / m) and m < 16:
        m += 1
    return m


def masks(m: int) -> list[int]:
    """For every choice of m - RADIUS of m blocks, the mask of their bits (signed)."""
    edge = [64 * k // m for k in range(m + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edge, edge[1:])]
    out = [sum(c) for c in combinations(block, m - RADIUS)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (a signed 64-bit number) for every row of ``docs``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(_fingerprints, "doc_id long, fp long")


def _sharded(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "query", "fp").mapInArrow(_edges, "a long, b long")


def links(tmp: Scratch, classes: DataFrame, blocks: int | None = None, shard: int = SHARD) -> DataFrame:
    """Edges (a, b) that connect what fingerprints within RADIUS bits connect. ``classes``: fp, id, distinct in fp."""
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(x)).alias("key"))
                                for t, x in enumerate(masks(blocks or blocks_for(classes.count())))]))
    rows = classes.select("fp", "id", table.alias("b")).select("b.t", "b.key", "fp", "id")
    big = tmp.table(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard), "big")
    n_big = big.count()
    dealt = F.pmod(F.xxhash64("fp"), F.coalesce(F.ceil(F.col("n") / shard), F.lit(1)))
    hint = F.broadcast if n_big <= 100_000 else (lambda x: x)
    placed = rows.join(hint(big), ["t", "key"], "left").withColumn("i", dealt.cast("int"))
    found = tmp.table(_sharded(placed.select("t", "key", "i", F.lit(0).alias("j"), F.lit(False).alias("query"), "fp", "id")), "links")
    if not n_big:
        return found
    # large buckets: whoever is outside the bucket's largest component so far is searched in all its other shards
    comp = components(tmp, found)
    member = rows.join(hint(big), ["t", "key"]).join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    member = tmp.table(member, "large")
    sizes = member.groupBy("t", "key", "comp").agg(F.count("*").alias("c"))
    home = sizes.groupBy("t", "key").agg(F.max_by("comp", F.struct("c", "comp")).alias("home"), (F.sum("c") - F.max("c")).alias("away")).where("away > 0")
    member = member.join(hint(home), ["t", "key"])
    held, asked = F.ceil(F.col("n") / shard).cast("int"), F.ceil(F.col("away") / shard).cast("int")
    mine = lambda parts: F.pmod(F.xxhash64("fp", F.lit(7)), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    trees = member.withColumn("i", mine(held)).withColumn("j", every(asked)).withColumn("query", F.lit(False))
    queries = member.where("comp <> home").withColumn("j", mine(asked)).withColumn("i", every(held)).withColumn("query", F.lit(True))
    rest = tmp.table(_sharded(trees.unionByName(queries).select(*_KEYS, "query", "fp", "id")), "away")
    return found.unionByName(rest)


def near_duplicates(docs: DataFrame, blocks: int | None = None, shard: int = SHARD) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of ``docs`` (doc_id, text)."""
    tmp = Scratch(docs.sparkSession, "simhash")
    signed = tmp.table(fingerprints(docs), "signed")
    classes = tmp.table(signed.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    comp = components(tmp, links(tmp, classes, blocks, shard))
    groups = classes.join(comp, "id", "left").select("fp", F.coalesce("comp", "id").alias("component_id"))
    out = signed.join(groups, "fp", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), own.alias("component_id"))
