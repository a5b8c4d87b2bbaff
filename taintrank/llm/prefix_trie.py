"""Trie of conversation prefixes by splitter skeleton (operator 13).

A conversation is a path of turn keys (16-byte digests of role and text, so texts never move). Paths are dealt to
range shards by splitters drawn from a bounded sample, and sorted there. A node whose path is no prefix of a splitter path has
all its members in one shard; the trie of the splitter paths, the skeleton, is broadcast and tells which these are. A shard walks its sorted
paths once, finishes every other node, and hands on one partial aggregate per skeleton node it meets; the partials are
reduced by node, and the totals of the (bounded) skeleton are added up from its ends to the root. Splitters
hold the path and the conversation, so a path that very many conversations share is split over shards too.

From the first turn on that no other conversation has at the same depth, a conversation is alone: these nodes need no trie and are written row by
row, so a long conversation of its own never becomes a long path. Turns are numbered by range partitions.

Bounds: a shared path is one row, 24 bytes a turn; there are at most ``SKELETON_BYTES`` of splitter paths; the ends of one node are
digested in id order, as its definition asks, by one task that streams them in chunks.

Contract for odd rows: null role or text is empty; turns sort by number (null first), then by role, then by digest; repeated rows are repeated turns; rows
without conv_id belong to no conversation and take no part; a conversation left without turns is a member of the root alone; extra columns
are ignored; an empty table has no node.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.operators.rank import ordered_positions
from taintrank.session import Scratch

WIDTH = 16                       # bytes of a turn key
SHARD_BYTES = 4 << 20            # path bytes of a shard
SKELETON_BYTES = 16 << 20        # bound of all splitter paths
DRAWS = 32                       # sampled conversations per shard
SAMPLE_BYTES = 64 << 20
ENDS = 1 << 15                   # ids of one chunk of a skeleton node's ends
WORD = r"[^\x20\x09-\x0D]+"
NOTHING = hashlib.sha256(b"").hexdigest()

Splitters = list[tuple[bytes, int]]


# ------------------------------------------------------------------ conversations

def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), key, words for every turn of a conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = rows.select("conv_id", "turn", "role", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("key").asc()]
    tmp = Scratch(conversations.sparkSession, "trie-turns")
    rows = tmp.table(rows.withColumn("_turn", F.col("turn").cast("double")), "turns")
    placed = ordered_positions(rows, ["conv_id"], "_turn", False, order, sums=[(None, "pos")])
    return placed.select("conv_id", (F.col("pos") - 1).alias("pos"), "key", "words")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that open with turns of another: (conv_id, n) and (conv_id, depth, key, words).

    Conversation c takes the first h turns of conversation ``c - c % every``, then its own after its first h; h is crc32(c) modulo ``most``.
    """
    convs = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("own"))
    c = F.col("conv_id")
    convs = convs.select("conv_id", "own", (F.crc32(c.cast("string")) % most).alias("h"), (c - c % every).alias("base"))
    base = convs.select(c.alias("base"), F.col("own").alias("n_base"))
    convs = convs.join(base, "base", "left").withColumn("opening", F.least("h", F.coalesce("n_base", F.lit(0))))
    first = turns.where(F.col("pos") < most - 1).select(c.alias("base"), "pos", "key", "words")
    opening = convs.join(first, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "words")
    rest = turns.join(convs.select("conv_id", "h", "opening"), "conv_id").where("pos >= h")
    rest = rest.select("conv_id", (F.col("opening") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "words")
    n = F.col("opening") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", n.alias("n")), opening.unionByName(rest)


# ------------------------------------------------------------------ shards

class Node:
    __slots__ = ("conv", "depth", "n", "children", "leaves", "saved", "words", "ends", "at", "skeleton")

    def __init__(self, depth: int, words: int, skeleton: int):
        self.depth, self.words, self.skeleton = depth, words, skeleton
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.at = None, 0, 0, 0, 0, [], -1

    def take(self, conv: int, n: int = 1) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)


def skeleton(splitters: Splitters) -> dict[bytes, int]:
    """All prefixes of the splitter paths, numbered in path order (the root is 0)."""
    paths = {b""} | {p[:i] for p, _ in splitters for i in range(WIDTH, len(p) + 1, WIDTH)}
    return {p: k for k, p in enumerate(sorted(paths))}


def shared_depth(a: bytes, b: bytes) -> int:
    """How many leading turns two paths share."""
    n = min(len(a), len(b)) // WIDTH
    if a[:n * WIDTH] == b[:n * WIDTH]:
        return n
    lo, hi = 0, n - 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid * WIDTH] == b[:mid * WIDTH] else (lo, mid - 1)
    return lo


class Walk:
    """One shard's sorted paths. Finished nodes and skeleton partials are collected in ``out``."""

    def __init__(self, shard: int, nodes: dict[bytes, int]):
        self.shard, self.nodes, self.path, self.chunk = shard, nodes, b"", 0
        self.open = [Node(0, 0, 0)]
        self.done: list[tuple[Node, Node]] = []       # finished nodes (with their parents) of the open local subtree
        self.out: list[tuple] = []

    def add(self, conv: int, path: bytes, words: list[int], more: bool) -> None:
        depth = shared_depth(self.path, path)
        while len(self.open) - 1 > depth:
            self._close()
        for d in range(depth + 1, len(path) // WIDTH + 1):
            # below a local node there is no skeleton node
            at = self.nodes.get(path[:d * WIDTH], -1) if self.open[-1].skeleton >= 0 else -1
            self.open.append(Node(d, words[d - 1], at))
        self.path = path
        node = self.open[-1]
        node.take(conv)
        if more:                                      # its other turns are alone
            node.children += 1
            node.leaves += 1
        else:
            node.ends.append(conv)
            if node.skeleton >= 0 and len(node.ends) >= ENDS:
                self._ends(node)

    def finish(self) -> list[tuple]:
        while self.open:
            self._close()
        return self.out

    def _ends(self, node: Node) -> None:
        if node.ends:
            self.out.append((node.skeleton, -1, None, node.depth, None, 0, 0, 0, 0, node.words, self.shard, self.chunk, ",".join(map(str, node.ends))))
            self.chunk, node.ends = self.chunk + 1, []

    def _close(self) -> None:
        node = self.open.pop()
        if node.skeleton >= 0:
            self._ends(node)
            self.out.append((node.skeleton, -1, node.conv, node.depth, None, node.n, node.children, node.leaves, node.saved, node.words, self.shard, -1, None))
            return
        above = self.open[-1]
        node.leaves = node.leaves or int(not node.children)
        node.saved += (node.n - 1) * node.words
        above.take(node.conv, node.n)
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        self.done.append((node, above))
        if above.skeleton >= 0:                       # a whole local subtree: all smallest members are known
            for x, up in self.done:
                ends = hashlib.sha256(",".join(map(str, x.ends)).encode()).hexdigest()
                self.out.append((-1, up.skeleton, x.conv, x.depth, up.conv if up.skeleton < 0 else None, x.n, x.children, x.leaves, x.saved, x.words,
                                 self.shard, -1, ends))
            self.done = []


_OUT = ("skeleton int, parent int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "words long, shard int, chunk long, ends string")
_ARROW = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]]) for f in _OUT.split(", ")])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out)) if out else [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _walk(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = skeleton(shared.value)
        walk = None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words", "more")]
            for shard, conv, path, words, more in zip(*columns):
                if walk is None or walk.shard != shard:
                    if walk:
                        yield _rows(walk.finish())
                    walk = Walk(shard, nodes)
                walk.add(conv, path, words, more)
            if walk and walk.out:
                yield _rows(walk.out)
                walk.out = []
        if walk:
            yield _rows(walk.finish())
    return run


def _place(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value
        for batch in batches:
            at = [bisect.bisect_right(splitters, x) for x in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield batch.append_column("shard", pa.array(at, pa.int32()))
    return run


def draw_splitters(paths: DataFrame, shard_bytes: int = SHARD_BYTES) -> Splitters:
    """At most SKELETON_BYTES of splitters (path, conv_id), evenly spaced in a sample drawn by hash."""
    size = F.length("path")
    n, total, longest = paths.agg(F.count("*"), F.coalesce(F.sum(size + 24), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    least = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // shard_bytes), min(least, n // 256))
    shards = max(1, min(shards, SKELETON_BYTES // (longest + 24)))
    draws = min(shards * DRAWS, max(shards, SAMPLE_BYTES // (longest + 24)))
    if shards == 1:
        return []
    drawn = sorted((bytes(r.path), r.conv_id) for r in paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(draws).collect())
    return [drawn[len(drawn) * k // shards] for k in range(1, shards)]


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of ids, sorted by node, shard and chunk: one running digest a node."""
    node, running = None, None
    schema = pa.schema([("skeleton", pa.int32()), ("ends_sha256", pa.string())])
    row = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([running.hexdigest()])], schema=schema)
    for batch in batches:
        for at, ids in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if at != node:
                if running:
                    yield row()
                node, running = at, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if running:
        yield row()


def totals(nodes: dict[bytes, int], partial: dict[int, tuple]) -> list[tuple]:
    """Skeleton nodes from their reduced partials (conv, n, children, leaves, saved, words), added up from the ends to the root."""
    paths = sorted(nodes, key=nodes.get)
    acc = {k: list(v) for k, v in partial.items()}
    for p in sorted(paths, key=len, reverse=True):
        conv, n, children, leaves, saved, words = acc[nodes[p]]
        acc[nodes[p]][3] = leaves = leaves or int(not children)
        acc[nodes[p]][4] = saved = saved + (n - 1) * words
        if p:
            up = acc[nodes[p[:-WIDTH]]]
            up[0] = conv if up[0] is None else min(up[0], conv)
            up[1], up[2], up[3], up[4] = up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved
    return [(k, acc[k][0], len(p) // WIDTH, acc[nodes[p[:-WIDTH]]][0] if p else None, *acc[k][1:5]) for p, k in nodes.items()]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(convs: DataFrame, turns: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The nodes of the prefix trie of conversations ``convs`` (conv_id, n) with ``turns`` (conv_id, depth, key, words)."""
    spark = convs.sparkSession
    tmp = Scratch(spark, "trie")
    convs, turns = tmp.table(convs, "convs"), tmp.table(turns, "rebuilt")
    lone = turns.groupBy("depth", "key").agg(F.count("*").alias("_n"), F.min("conv_id").alias("conv_id")).where("_n = 1")
    alone = tmp.table(lone.groupBy("conv_id").agg(F.min("depth").alias("alone")), "alone")
    marked = turns.join(alone, "conv_id", "left")
    steps = F.sort_array(F.collect_list(F.struct("depth", "key", "words")))
    paths = marked.where("alone is null or depth <= alone").groupBy("conv_id").agg(steps.alias("s"))
    paths = convs.join(paths, "conv_id", "left").select(
        "conv_id", F.coalesce(F.unhex(F.array_join("s.key", "")), F.lit(b"")).alias("path"), F.coalesce("s.words", F.array().cast("array<long>")).alias("words"),
        (F.col("n") > F.coalesce(F.size("s"), F.lit(0))).alias("more"))
    paths = tmp.table(paths.withColumn("more", F.col("more") & (F.length("path") > 0)), "paths")
    splitters = draw_splitters(paths, shard_bytes)
    shared = spark.sparkContext.broadcast(splitters)
    placed = paths.mapInArrow(_place(shared), "conv_id long, path binary, words array<long>, more boolean, shard int")
    dealt = placed.repartition(len(splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    out = tmp.table(dealt.mapInArrow(_walk(shared), _OUT), "nodes")

    # skeleton: partials reduced by node; there are no more nodes than turns in the splitter paths
    some = out.where("skeleton >= 0")
    reduced = some.groupBy("skeleton").agg(F.min("conv_id"), F.sum("n_convs"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("words"))
    partial = {r[0]: tuple(r)[1:] for r in reduced.collect()}
    rows = totals(skeleton(splitters), partial) if partial else []
    top = spark.createDataFrame(rows, "skeleton int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    ends = (some.where("ends is not null").select("skeleton", "shard", "chunk", "ends").repartition("skeleton")
            .sortWithinPartitions("skeleton", "shard", "chunk").mapInArrow(_digest_ends, "skeleton int, ends_sha256 string"))
    upper = top.join(ends, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*COLUMNS)

    above = F.broadcast(top.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("_up")))
    local = out.where("skeleton < 0").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    local = local.withColumnRenamed("ends", "ends_sha256").select(*COLUMNS)

    last = F.col("depth") == F.col("n")
    tail = marked.where("depth > alone").join(convs, "conv_id").select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    return upper.unionByName(local).unionByName(tail)


def conversation_trie(conversations: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The trie over rebuilt conversations (see :func:`rebuilt`)."""
    tmp = Scratch(conversations.sparkSession, "trie-in")
    return trie(*rebuilt(tmp.table(numbered(conversations), "numbered")), shard_bytes)
