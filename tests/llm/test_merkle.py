"""Operator 11: against a recursive plain tree, retained states, odd rows."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from taintrank.llm import _sha, merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, key int, pos long"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def up(nodes, at, mine):
    """(top of the nodes, top with ``mine`` at place ``at``, siblings passed)."""
    passed = []
    while len(nodes) > 1:
        lo = at // 3 * 3
        run = nodes[lo:lo + 3]
        passed += [x for i, x in enumerate(run) if lo + i != at]
        mine = sha("".join(mine if lo + i == at else x for i, x in enumerate(run)))
        nodes = [sha("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at //= 3
    return nodes[0], mine, passed


def plain(rows):
    groups = {}
    for r in rows:
        new = r[4].replace("\n", "") if r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
        groups.setdefault(b"" if r[1] is None else b"1" + r[1].encode(), []).append((r[0], plain_leaf(r), plain_leaf((*r[:4], new))))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    keys = sorted(groups)
    tops = [up([x[1] for x in groups[k]], 0, "")[0] for k in keys]
    root = up(tops, 0, "")[0] if tops else None
    out = []
    for i, k in enumerate(keys):
        for j, (doc, leaf, new) in enumerate(groups[k]):
            _, mine, low = up([x[1] for x in groups[k]], j, new)
            _, mine, high = up(tops, i, mine)
            out.append((doc, leaf, tops[i], root, sha("".join(low + high)), mine, mine == root))
    return out


def ran(spark, rows, span=merkle.SPAN):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    return merkle.fold(merkle.build(df, replace={"text": merkle.tampered_text()}, span=span))


def key(r):
    return tuple(str(x) for x in r)


def test_matches_plain_tree_over_many_rounds(spark):
    """A span of 9 makes several rounds of blocks in both trees; one source holds a third of the rows."""
    rng = random.Random(3)
    rows = [(i, f"s{rng.choice([0, rng.randrange(30)])}", "en", rng.randrange(9), rng.choice(["a\nb", "plain", "\n", "é\n"]) + str(i)) for i in range(700)]
    rng.shuffle(rows)
    got = ran(spark, rows, span=9).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain(rows)))
    assert {r.verified for r in got} == {True, False}


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, None, "en", 0, ""), (2, None, "en", 0, ""), (None, None, "en", 1, "x\n"), (None, "", None, 1, "x\n"),
            (4, "", "en", 3, "a\nb"), (6, "alone", "en", 3, "\n"), (8, "日本", "en", 3, "w " * 200_000 + "\n"), (9, "Z", "en", -5, "x")]
    got = ran(spark, rows).collect()
    assert sorted(map(key, got)) == sorted(map(key, plain(rows)))
    assert ran(spark, []).collect() == []
    one = ran(spark, [(3, "s", "en", 1, "t")]).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_states_are_those_of_hashlib():
    """Every retained state goes on to the parent's digest with its own and the right-hand children only."""
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(25)]
    tree = merkle.Subtree.grow(_sha.unpack(b"".join(digests)), 3)
    again = merkle.Subtree.load(25, b"".join(map(_sha.pack, tree.digests)), b"".join(map(_sha.pack, tree.states)))
    assert [d.shape[1] for d in again.digests] == [25, 9, 3, 1]
    for level in range(3):
        below, above, states = (x[level] for x in (again.digests, again.digests[1:], again.states))
        names = _sha.hexes(below)
        for at in range(below.shape[1]):
            parent = at // 3
            run = names[parent * 3:parent * 3 + 3]
            state = states[:, at:at + 1]
            for j in range(at, parent * 3 + len(run)):
                state = _sha.feed(state, below[:, j:j + 1])
            assert _sha.hexes(_sha.finish(state, np.array([len(run)])))[0] == _sha.hexes(above[:, parent:parent + 1])[0] == sha("".join(run))


def test_hot_source_is_split(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    m = merkle.build(df, span=729)
    assert m.blocks[0].count() == -(-20_000 // 729) and m.blocks[0].agg(F.max("n")).first()[0] == 729
    assert merkle.fold(m).where("verified").count() == 20_000
