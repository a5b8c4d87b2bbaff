"""Operator 13: against a plain dictionary trie, for many shards, hot paths and odd rows."""

import hashlib
import random
import re
import zlib

from taintrank.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth long, path string, n int"


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, role, key, text))
    nodes = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = sorted(own.get(c - c % 20 if c >= 0 else c + -c % 20, []))
        seq = tuple((r, t) for _, _, r, _, t in base[:h] + sorted(own[c])[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq) == d))
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(nodes, key=len, reverse=True):
        below = [total[k] for k in kids.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        total[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(nodes[p]) - 1) * words)
    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, end in members if end)))
        up = min(nodes[p[:-1]])[0] if p else None
        out.append((min(members)[0], len(p), up, len(members), len(kids.get(p, [])), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, 9, "x", 1) for r in rows], ROWS)
    got = prefix_trie.conversation_trie(df, **how)
    assert got.columns == prefix_trie.COLUMNS
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def talk(rng, n, words):
    return [(i, ("user", "assistant")[i % 2], " ".join(rng.choice(words) for _ in range(rng.randrange(4)))) for i in range(n)]


def test_many_shards(spark):
    """Common first turns, a common conversation, long copies and loners; shards of a few conversations."""
    rng = random.Random(7)
    common = talk(rng, 6, ["ok", "no"])
    rows = []
    for c in range(400):
        kind = rng.random()
        turns = common if kind < 0.35 else common[:2] + talk(rng, 5, "abcdefgh")[2:] if kind < 0.6 else talk(rng, rng.randrange(1, 9), ["ok", "a", "b c"])
        rows += [(c, *t) for t in turns]
    rng.shuffle(rows)
    for size in (600, 20_000, 1 << 22):
        check(spark, rows, shard_bytes=size)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 0, "user", ""), (0, 0, "user", ""), (1, 0, None, "x y"), (2, 5, "user", "x"), (None, 0, "user", "x"), (None, None, None, None),
            (41, 0, "user", "only"), (42, 0, "user", "only"), (43, 0, "user", "only"), (44, 0, "user", "only"), (-3, 0, "user", "a"), (-1, 0, "user", "a"), (-1, 1, "user", "b"),
            (60, 0, "user", "w " * 100_000), (61, 0, "a\nb", "日本 x"), (61, 1, "user", "x"), (61, 2, "user", "x"), (61, 3, "user", "x"), (61, 4, "user", "x")]
    check(spark, rows)
    check(spark, rows, shard_bytes=50)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], ROWS)).count() == 0
    check(spark, [(None, 1, "user", "x")])


def test_long_conversation_is_no_long_path(spark):
    rows = [(7, i, "user", f"turn {i}") for i in range(3000)] + [(8, 0, "user", "turn 0"), (9, 0, "user", "turn 0"), (9, 1, "user", "turn 1")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.conversation_trie(df)
    assert got.count() == len(plain(rows)) and sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def test_only_splitter_prefixes_are_skeleton():
    k = [bytes([i]) * prefix_trie.WIDTH for i in range(4)]
    nodes = prefix_trie.skeleton([(k[0] + k[1], 5), (k[0] + k[2] + k[3], 9), (k[2], 1)])
    assert set(nodes) == {b"", k[0], k[0] + k[1], k[0] + k[2], k[0] + k[2] + k[3], k[2]} and nodes[b""] == 0
    assert prefix_trie.shared_depth(k[0] + k[1], k[0] + k[2] + k[3]) == 1 and prefix_trie.shared_depth(k[0], k[0] + k[1]) == 1
    walk = prefix_trie.Walk(0, nodes)
    walk.add(1, k[0] + k[1], [1, 1], False)
    walk.add(2, k[1] + k[1], [1, 1], False)
    out = walk.finish()
    assert sorted(r[0] for r in out if r[12] is None) == [0, nodes[k[0]], nodes[k[0] + k[1]]] and sum(r[0] < 0 for r in out) == 2
