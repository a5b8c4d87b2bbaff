"""Merkle manifest of a dataset with retained hash states (operator 11).

Every row is a leaf, the SHA-256 of its fields. The leaves of a source, in the order of their ids, are the
lowest level of a tree: every ``ARITY`` consecutive nodes become the hash of their hex digests. The subroots,
ordered by source, likewise give the root.

Positions come from range partitions, so a hot source is split. The tree is built in rounds of
``HEIGHT`` levels: ``SPAN`` = ARITY ** HEIGHT consecutive nodes make a block, one task group hashes its
levels, and the block tops are the nodes of the next round (three rounds hold 10^11 leaves). The manifest is one row
per block: the digests of its nodes, and for every parent the copied hash state before each of its child slots.

Folding a replaced leaf takes the state that its parent retains for its slot and feeds the replacement and
the siblings to the right only; nothing to the left is hashed again. Above a block all its leaves share one path
(per level: state, slot, siblings), written once per block on the way from the root down and met with the leaves there.

Contract for odd rows: a null field is written as ``-``; a null source is a source, the first; rows
without an id come first in their source, rows that repeat an id are ordered by leaf, equal rows are separate leaves with their own
proofs; a source of one row has its leaf as subroot; an empty table has no rows and no root; texts of any length are hashed by Spark;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _sha
from taintrank.operators.rank import ordered_positions
from taintrank.session import Scratch

ARITY, HEIGHT = 3, 8
SPAN = ARITY ** HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = 2 + 32 + 32 * (ARITY - 1)      # a path's bytes per level: run length, slot, state, siblings


def leaf(values: list[Column]) -> Column:
    """The leaf digest (binary) of a row's fields."""
    parts = []
    for v in values:
        s = v.cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def source_key(c: Column) -> Column:
    """A binary key that sorts null first, then by UTF-8 bytes."""
    return F.when(c.isNull(), F.lit(b"\x00")).otherwise(F.concat(F.lit(b"\x01"), c.cast("string").cast("binary")))


# ------------------------------------------------------------------ inside a block

def levels_of(block: int, n: int, span: int = SPAN) -> int:
    """How many levels a block has: all of them, but for a lone block, which ends at one node."""
    out, full = 0, n if block == 0 else span
    while full > 1:
        full, out = -(-full // ARITY), out + 1
    return out


@dataclass
class Subtree:
    """Levels of digests (8, n) and, for each parent, the state before every child slot (8, parents * ARITY)."""

    digests: list[np.ndarray]
    states: list[np.ndarray]

    @classmethod
    def grow(cls, leaves: np.ndarray, levels: int) -> Subtree:
        digests, states = [leaves], []
        for _ in range(levels):
            below = digests[-1]
            n = below.shape[1]
            parents = -(-n // ARITY)
            state = _sha.start(parents)
            kept = np.zeros((8, parents, ARITY), _sha.U)
            for slot in range(ARITY):
                kept[:, :, slot] = state
                have = np.arange(parents) * ARITY + slot < n
                child = below[:, np.minimum(np.arange(parents) * ARITY + slot, n - 1)]
                state = _sha.feed(state, child, have)
            run = np.minimum(n - np.arange(parents) * ARITY, ARITY)
            digests.append(_sha.finish(state, run))
            states.append(kept.reshape(8, -1))
        return cls(digests, states)

    @classmethod
    def load(cls, n: int, digests: bytes, states: bytes) -> Subtree:
        d, s = _sha.unpack(digests), _sha.unpack(states)
        out, at, kept = cls([], []), 0, 0
        while at < d.shape[1]:
            out.digests.append(d[:, at:at + n])
            at, n = at + n, -(-n // ARITY)
            if at < d.shape[1]:
                out.states.append(s[:, kept:kept + n * ARITY])
                kept += n * ARITY
        return out


class Climb:
    """Nodes on their way up: the folded digest and the running hash of the siblings passed, one column each."""

    def __init__(self, digest: np.ndarray):
        n = digest.shape[1]
        self.digest, self.proof, self.passed = digest, _sha.start(n), np.zeros(n, np.int64)

    def through(self, tree: Subtree, at: np.ndarray) -> None:
        """From places ``at`` of the lowest level to the top of a subtree."""
        for below, states in zip(tree.digests, tree.states):
            n, parent, slot = below.shape[1], at // ARITY, at % ARITY
            run = np.minimum(n - parent * ARITY, ARITY)
            state = _sha.feed(states[:, at], self.digest)       # retained state, then the replacement
            for t in range(ARITY):
                other = below[:, np.minimum(parent * ARITY + t, n - 1)]
                state = _sha.feed(state, other, (t > slot) & (t < run))
                beside = (t != slot) & (t < run)
                self.proof = _sha.feed(self.proof, other, beside)
                self.passed += beside
            self.digest, at = _sha.finish(state, run), parent

    def along(self, path: bytes) -> None:
        """Up a path that all nodes share."""
        n = self.digest.shape[1]
        for lo in range(0, len(path), STEP):
            run, slot = path[lo], path[lo + 1]
            words = _sha.unpack(path[lo + 2:lo + STEP])
            state = _sha.feed(np.repeat(words[:, :1], n, axis=1), self.digest)
            for t in range(run - 1):
                other = words[:, 1 + t:2 + t]
                if t >= slot:
                    state = _sha.compress(state, _sha.hex_block(other))
                self.proof = _sha.compress(self.proof, _sha.hex_block(other))
            self.passed += run - 1
            self.digest = _sha.finish(state, np.full(n, run))

    def proofs(self) -> np.ndarray:
        return _sha.finish(self.proof, self.passed)


def path_in(tree: Subtree, at: int) -> bytes:
    """The path of place ``at`` to the top of its subtree: per level run length, slot, state, siblings."""
    out = []
    for below, states in zip(tree.digests, tree.states):
        parent, slot = divmod(at, ARITY)
        run = min(below.shape[1] - parent * ARITY, ARITY)
        beside = [parent * ARITY + t for t in range(run) if t != slot]
        step = bytes([run, slot]) + _sha.pack(states[:, at:at + 1]) + _sha.pack(below[:, beside])
        out.append(step.ljust(STEP, b"\0"))
        at = parent
    return b"".join(out)


# ------------------------------------------------------------------ Spark

_BLOCKS = "key binary, block long, n int, digests binary, states binary, top binary"


def _grow(span: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        block = table.column("block")[0].as_py()
        tree = Subtree.grow(_sha.unpack(b"".join(table.column("digest").to_pylist())), levels_of(block, len(table), span))
        row = {"key": table.column("key")[0].as_py(), "block": block, "n": len(table), "digests": b"".join(map(_sha.pack, tree.digests)),
               "states": b"".join(map(_sha.pack, tree.states)), "top": _sha.pack(tree.digests[-1])}
        types = {"key": pa.binary(), "block": pa.int64(), "n": pa.int32(), "digests": pa.binary(), "states": pa.binary(), "top": pa.binary()}
        return pa.table({k: pa.array([row[k]], t) for k, t in types.items()})
    return run


def rounds(tmp: Scratch, nodes: DataFrame, name: str, span: int = SPAN) -> list[DataFrame]:
    """The block tables over ``nodes`` (key, pos, digest), lowest first; the last has one block a key."""
    out = []
    while True:
        placed = nodes.select("key", F.floor(F.col("pos") / span).alias("block"), (F.col("pos") % span).alias("at"), "digest")
        table = tmp.table(placed.groupBy("key", "block").applyInArrow(_grow(span), _BLOCKS), f"{name}-{len(out)}")
        out.append(table)
        if not table.agg(F.max("block")).first()[0]:
            return out
        nodes = table.select("key", F.col("block").alias("pos"), F.col("top").alias("digest"))


def _descend(span: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        tree = Subtree.load(row["n"], row["digests"], row["states"])
        n = row["n"]
        return pa.table({"key": pa.array([row["key"]] * n, pa.binary()), "block": pa.array([row["block"] * span + i for i in range(n)], pa.int64()),
                         "path": pa.array([path_in(tree, i) + row["path"] for i in range(n)], pa.binary()),
                         "subroot": pa.array([row["subroot"]] * n, pa.binary())})
    return run


def paths(tmp: Scratch, tables: list[DataFrame], top: DataFrame, span: int = SPAN) -> DataFrame:
    """(key, block, path, subroot) for the blocks of the lowest table. ``top``: the same for those of the last one."""
    for k, table in reversed(list(enumerate(tables[1:]))):
        joined = table.join(top, ["key", "block"])
        top = tmp.table(joined.groupBy("key", "block").applyInArrow(_descend(span), "key binary, block long, path binary, subroot binary"), f"paths-{k}")
    return top


@dataclass
class Manifest:
    """``leaves``: key, pos, id, leaf and replacement; ``blocks``: the block tables of the sources; ``paths``: (key, block, path, subroot)."""

    leaves: DataFrame
    blocks: list[DataFrame]
    sources: list[DataFrame]
    paths: DataFrame
    root: str | None
    span: int


def build(docs: DataFrame, fields: tuple[str, ...] = FIELDS, replace: dict[str, Column] | None = None, span: int = SPAN) -> Manifest:
    """The manifest of ``docs``. ``replace`` gives columns that stand in for fields in each row's replacement leaf."""
    tmp = Scratch(docs.sparkSession, "merkle")
    new = leaf([(replace or {}).get(f, F.col(f)) for f in fields])
    rows = docs.select(source_key(F.col("source")).alias("key"), F.col("doc_id").alias("id"), leaf([F.col(f) for f in fields]).alias("leaf"), new.alias("new"))
    rows = tmp.table(rows.withColumn("new", F.when(F.col("new") != F.col("leaf"), F.col("new"))), "rows")
    order = [F.col("id").asc_nulls_first(), F.col("leaf").asc(), F.col("new").asc()]
    leaves = tmp.table(ordered_positions(rows.withColumn("_id", F.col("id").cast("double")), ["key"], "_id", False, order, sums=[(None, "pos")])
                       .withColumn("pos", F.col("pos") - 1).drop("_id"), "leaves")
    blocks = rounds(tmp, leaves.select("key", "pos", F.col("leaf").alias("digest")), "blocks", span)
    tops = blocks[-1].select("key", F.col("top").alias("digest"), F.lit(0.0).alias("_zero"), F.lit(b"").alias("_all"))
    ordered = ordered_positions(tops, ["_all"], "_zero", False, [F.col("key").asc()], sums=[(None, "pos")])
    subroots = tmp.table(ordered.select(F.col("_all").alias("key"), (F.col("pos") - 1).alias("pos"), "digest", F.col("key").alias("source")), "subroots")
    sources = rounds(tmp, subroots.select("key", "pos", "digest"), "sources", span)
    last = sources[-1].first()
    start = sources[-1].select("key", "block", F.lit(b"").alias("path"), F.col("top").alias("subroot"))
    # one level lower, the children of the lowest source blocks are the subroots themselves
    above = paths(tmp, [subroots, *sources], start, span).select(F.col("block").alias("pos"), "path")
    top = subroots.join(above, "pos").select(F.col("source").alias("key"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    return Manifest(leaves, blocks, sources, paths(tmp, blocks, top, span), last["top"].hex() if last else None, span)


def _fold(id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        tree = Subtree.load(block["n"], block["digests"], block["states"])
        old, new = left.column("leaf").to_pylist(), left.column("new").to_pylist()
        climb = Climb(_sha.unpack(b"".join(b or a for a, b in zip(old, new))))
        climb.through(tree, left.column("at").to_numpy())
        climb.along(block["path"])
        return pa.table({"id": left.column("id").cast(id_type), "leaf": pa.array([x.hex() for x in old], pa.string()),
                         "subroot": pa.array([block["subroot"].hex()] * len(old), pa.string()),
                         "proof_sha256": pa.array(_sha.hexes(climb.proofs()), pa.string()),
                         "folded_root": pa.array(_sha.hexes(climb.digest), pa.string())})
    return run


def fold(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every leaf of a manifest.

    A leaf's root is folded from its replacement where it has one, else from itself.
    """
    at = m.leaves.select("key", F.floor(F.col("pos") / m.span).alias("block"), (F.col("pos") % m.span).alias("at"), "id", "leaf", "new")
    blocks = m.blocks[0].join(m.paths, ["key", "block"])
    kind = dict(m.leaves.dtypes)["id"]
    arrow = {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64())
    out = (at.groupBy("key", "block").cogroup(blocks.groupBy("key", "block"))
           .applyInArrow(_fold(arrow), f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string"))
    root = F.lit(m.root).cast("string")
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == root).alias("verified"))


def tampered_text() -> Column:
    """The text without its line ends where 2 divides crc32 of the decimal doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return F.when(hit, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))
