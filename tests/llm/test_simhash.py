"""Operator 12: against all pairs of plainly computed fingerprints, trees, tables, odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from taintrank.llm import queries, simhash
from taintrank.session import Scratch

DOCS = "doc_id long, text string, lang string, fp long, id long, t int"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes):
    """nodes: (id, fingerprint); the smallest id each reaches over links of at most four bits."""
    parent = {i: i for i, _ in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(nodes):
        for b, y in nodes[k + 1:]:
            if (x ^ y).bit_count() <= 4:
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    return {i: find(i) for i, _ in nodes}


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "en", 1, 2, 3) for i, t in rows], DOCS)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **how).collect()}
    nodes = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(nodes)
    assert got == {i: (f"{x:016x}", comp[i]) for i, x in nodes}
    return comp


def test_query_matches_all_pairs(spark):
    """The registered query on the whole smallest table."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    nodes = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    comp = plain_components(nodes)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op12_bktree_simhash"](spark, sf).collect()}
    assert got == {i: (f"{x:016x}", comp[i]) for i, x in nodes}
    assert len(set(comp.values())) < len(comp)


def test_spark_hash_is_the_same(spark):
    words = ["a b c d", "été naïve x y", "w " * 40]
    got = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(w,) for w in words], "s string").select(F.xxhash64("s")).collect()]
    assert got == [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t\x0b"), (4, "one two"), (5, "ONE  two"), (6, "x" * 50_000), (7, "été NAÏVE日本 a b c"), (8, "w " * 20_000), (9, "w w w w")]
    comp = check(spark, rows)
    assert comp[2] == comp[3] == 1 and comp[5] == 4 and comp[9] == 8
    df = spark.createDataFrame([(None, "one two", "", 0, 0, 0), (7, "one two", "", 0, 0, 0), (7, "one two", "", 0, 0, 0)], DOCS)
    got = sorted(((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == [(0, None), (7, 7), (7, 7)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces():
    rng = random.Random(5)
    text = " ".join(rng.choice(["alpha", "be", "C" * 300, "d\n", "été"]) for _ in range(4000))
    whole = plain_fingerprint(text)
    assert {simhash.fingerprint(text.encode(), size) for size in (7, 64, 1000, 1 << 20)} == {whole}


def planted(rng, families, size, flips):
    out = []
    for _ in range(families):
        at = rng.getrandbits(64)
        for _ in range(size):
            out.append(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.choice(flips)))
    return out


@pytest.mark.parametrize("blocks", [5, 6, 7])
def test_links_lose_none(spark, blocks):
    """Chains of neighbours at 1 to 5 bits, far apart from each other, over several tables and small shards."""
    rng = random.Random(blocks)
    fps = sorted(set(planted(rng, 12, 25, [1, 3, 4, 5]) + [0, 15, 31, 1 << 63, (1 << 64) - 1]))
    rng.shuffle(fps)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    for shard in (4096, 16):
        tmp = Scratch(spark, "test")
        edges = simhash.links(tmp, spark.createDataFrame(rows, "fp long, id long"), blocks, shard)
        comp = {r.id: r.comp for r in simhash.components(tmp, edges).collect()}
        assert {i: comp.get(i, i) for i in range(len(fps))} == plain_components(list(enumerate(fps)))


def test_hot_bucket_is_dealt(spark):
    """One large cluster: shards stay bounded and what is outside its component is still searched everywhere."""
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 6, 7]))) for _ in range(700)}
    fps = sorted(fps)
    rows = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)]
    tmp = Scratch(spark, "test")
    edges = simhash.links(tmp, spark.createDataFrame(rows, "fp long, id long"), 5, 64)
    comp = {r.id: r.comp for r in simhash.components(tmp, edges).collect()}
    assert {i: comp.get(i, i) for i in range(len(fps))} == plain_components(list(enumerate(fps)))


def test_forest_follows_only_edges_within_the_radius():
    rng = np.random.default_rng(4)
    fp = np.unique(rng.integers(0, 2**12, 600, dtype=np.uint64) * np.uint64(0x0101010101010101))
    shard = np.sort(rng.integers(0, 3, len(fp)))
    forest = simhash.Forest(fp, shard, 3)
    parent, key = forest.edge // 65, forest.edge % 65
    assert (simhash.distance(fp[parent], fp[forest.child]) == key).all() and len(np.unique(forest.edge)) == len(forest.edge)
    hits = {(int(a), int(b)) for q, n in forest.search(fp, shard, 8) for a, b in zip(q, n)}
    d = simhash.distance(fp[:, None], fp[None, :])
    assert hits == {(a, b) for a, b in zip(*np.nonzero((d <= 8) & (shard[:, None] == shard[None, :])))}


def test_number_of_blocks():
    assert simhash.blocks_for(0) == simhash.blocks_for(10**6) == 5 and simhash.blocks_for(10**9) == 6 and simhash.blocks_for(5 * 10**10) == 7
    for m in (5, 6, 7):
        tables = [x & (2**64 - 1) for x in simhash.masks(m)]
        assert len(set(tables)) == len(tables) and sum(x.bit_count() for x in tables) * m == len(tables) * (m - 4) * 64
