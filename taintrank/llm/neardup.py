"""Near-duplicate groups by HyperMinHash (operator 10).

One hash per 5-word shingle. Its top bits choose one of the registers; a
register keeps the smallest remaining hash, compressed to its number of leading zeros plus
``MANTISSA`` bits. Empty registers borrow from a fixed random probe order, so short
texts use all bands too. ``BANDS`` bands of ``ROWS`` compressed registers make the
candidate keys; a bit of each of 64 registers gives a Jaccard estimate, corrected for bits and for compressed registers that
agree by chance, which removes pairs more than ``DEVIATIONS`` standard deviations below the threshold; every remaining
pair is verified on the full shingle sets. One formula holds for all sizes: the deviation counts the sampled registers and
the shingles, so it widens as sets get short, until nothing is removed.

Loss: a pair at the threshold shares a band with probability 0.75**5 = 0.237, so it shares
none of 64 bands with 3e-8; in long texts the estimate rejects it with 7e-8 (a binomial tail), and of 95,000 simulated pairs
at the threshold, of 3 to 80 shingles, it rejected none: the lowest lay 4.1 deviations below. Closer pairs are lost far less. In texts of a few
shingles two of them may fall into one register: of 40,000 simulated pairs of 4 and 3 shingles one shared no
band, of as many pairs of 5 and 4, 8 and 6, 16 and 12 shingles none.

Groups are never expanded into pairs:

1. Texts with equal shingle sets are one class (a partial aggregate). Classes that hold more than a ``HOT``-th of all
   documents, fewer than ``HOT`` of them, find their members by broadcast, the others by a shuffle join.
2. In each band bucket every class meets the bucket's smallest class only. Each class is
   verified against the one it shares most bands with, then against the others it is not yet connected with.
3. What is left is compared across components alone: classes of one bucket that are still in
   different components, block by block inside tasks, without emitting their pairs. A bucket whose
   members are connected needs no further check, so a large group of near copies adds nothing here.

Contract for odd rows: a null or wordless text has an empty set, is its own group and is kept; a
text with fewer than five words has one shingle, the whole sequence; a row without doc_id is its own
group; rows that repeat a doc_id are one document; extra columns are ignored by :func:`near_duplicates` and kept by
:func:`drop_near_duplicates`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _text
from taintrank.session import Scratch

SHINGLE = 5
BANDS, ROWS = 64, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)
PROBES = 24
SAME_ZEROS = 0.1699          # chance that registers of unlike sets of one size have equal leading zeros (HyperMinHash)
DEVIATIONS = 6               # of the estimate at the threshold
HOT = 1000                   # classes above this share of the documents are joined by broadcast
BLOCK = 512                  # bucket members of one part in a block comparison
BROADCAST_IDS = 500_000      # id sets above this many rows are joined by shuffle

_RNG = np.random.Generator(np.random.PCG64(71))
_PROBE = _RNG.integers(0, REGISTERS, (REGISTERS, PROBES))
_BAND_SALT = _RNG.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_DIGEST_AT = np.linspace(0, REGISTERS - 1, 64).astype(int)
_DIGEST_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_DIGEST_SALT = np.arange(64, dtype=np.uint64) * np.uint64(_text._MUL)


def shingle_sets(block: _text.Block) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a block."""
    w = _text.words(block)
    h = _text.word_hashes(block, w, fold=True)
    win = _text.window_hashes(h, SHINGLE)
    for a, b in zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
        if b - a >= SHINGLE:
            yield np.unique(win[a:b - SHINGLE + 1])
        elif b > a:
            yield _text.sequence_hash(h[a:b]).reshape(1)
        else:
            yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16: leading zeros above MANTISSA bits) of sorted distinct hashes."""
    spread = (hashes >> np.uint64(32)) * np.uint64(REGISTERS)
    at = (spread >> np.uint64(32)).astype(np.int64)            # multiply-shift keeps the sort order
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    # the rest of the hash inside its register, as 53 bits
    rest = _text.mix(hashes) >> np.uint64(11)
    low = np.minimum.reduceat(rest, first)
    _, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(53 - exponent, 0, 62)
    kept = np.where(exponent > MANTISSA + 1, low >> np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64), low)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[at[first]] = (zeros.astype(np.uint16) << MANTISSA) | (kept.astype(np.uint64) & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    empty = np.flatnonzero(out == EMPTY)
    if len(empty):
        probe = out[_PROBE[empty]]
        hit = probe != EMPTY
        got = hit.any(axis=1)
        filled = probe[np.arange(len(empty)), hit.argmax(axis=1)]
        full = out[at[first]]
        # few full registers: continue on a fixed ring over the full ones
        filled = np.where(got, filled, full[_ring(empty, at[first])])
        out[empty] = filled
    return out


def _ring(empty: np.ndarray, full: np.ndarray) -> np.ndarray:
    """For an empty register, the full one with the smallest mixed (register, register) value."""
    pair = (empty[:, None] * REGISTERS + full[None, :]).astype(np.uint64)
    return _text.mix(pair * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)).argmin(axis=1)


def band_keys(reg: np.ndarray) -> np.ndarray:
    r = reg.reshape(BANDS, ROWS).astype(np.uint64) + np.uint64(1)
    return _text.mix((r * _BAND_SALT).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_text._MUL))


def digest(reg: np.ndarray) -> int:
    """One mixed bit of 64 registers; the position is mixed in, because short texts repeat a register value."""
    bit = _text.mix(_text.mix(reg[_DIGEST_AT].astype(np.uint64) + np.uint64(77)) + _DIGEST_SALT) & np.uint64(1)
    return int((bit * _DIGEST_BIT).sum(dtype=np.uint64).view(np.int64))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _text.blocks(batch.column(1)):
            n, fp1, fp2, dig, keys = [], [], [], [], []
            for s in shingle_sets(block):
                n.append(len(s))
                if not len(s):
                    fp1.append(None), fp2.append(None), dig.append(None), keys.append(None)
                    continue
                fp1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                fp2.append(int(_text.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                reg = registers(s)
                dig.append(digest(reg))
                keys.append(band_keys(reg).tobytes())
            ids = batch.column(0).slice(block.lo, block.hi - block.lo)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()),
                 pa.array(dig, pa.int64()), pa.array(keys, pa.binary())],
                names=["doc_id", "n_shingles", "fp1", "fp2", "digest", "bands"])


def _explode_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            continue
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(ids, BANDS))], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _text.blocks(batch.column(1)):
            sets = [s.tobytes() for s in shingle_sets(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(sets, pa.binary())],
                                             names=["id", "set"])


def _verify(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep[i] = 100 * both >= threshold * (len(s) + len(t) - both)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])
    return run


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The upper 32 bits of every shingle hash: equal shingles stay equal; :func:`repeats` covers those that collide."""
    for batch in batches:
        for block in _text.blocks(batch.column(1)):
            sets = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.lo, block.hi - block.lo), pa.array(sets, pa.binary())],
                                             names=["id", "set"])


def overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block of sets: products of incidence matrices of the shingles that stand twice."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(count > 1) - 1
    use = count[at] > 1
    owner, at = owner[use], rank[at[use]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        a, b = np.searchsorted(at, [lo, lo + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[owner[a:b], at[a:b] - lo] = 1
        out += x @ x.T
    return out


def repeats(sets: list[np.ndarray]) -> np.ndarray:
    """How many shortened hashes of each sorted set repeat another one of it; an intersection misses at most as many."""
    return np.array([int((s[1:] == s[:-1]).sum()) for s in sets], np.float64)


def _block_links(threshold: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, comp, part = (table.column(c).to_numpy() for c in ("id", "comp", "part"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("set").combine_chunks()]
        n = np.array([len(s) for s in sets], np.float64)
        again = repeats(sets)
        both = overlaps(sets) + np.minimum(again[:, None], again[None, :])   # an upper bound; verified() decides on the 64-bit sets
        hit = (100 * both >= threshold * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :]) & (ids[:, None] < ids[None, :])
        if i != j:
            hit &= part[:, None] != part[None, :]
        a, b = np.nonzero(hit)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})
    return run


def block_pairs(tmp: Scratch, rest: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Likely links (a, b) between components inside the buckets of ``rest`` (key, parts, id, comp).

    A bucket is dealt into parts of about BLOCK members and every two parts meet in a task, where one matrix product
    compares them; only pairs that reach the threshold on the shortened hashes leave the task.
    """
    ids = tmp.table(rest.select("id").distinct(), "ids")
    sets = tmp.table(texts.join(_checked_broadcast(ids), "id", "left_semi").mapInArrow(_short_sets, "id long, set binary"), "sets")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    placed = rest.withColumn("part", part).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("key", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "part", "id", "comp")
    return (placed.join(sets, "id").groupBy("key", "i", "j")
            .applyInArrow(_block_links(threshold), "a long, b long").distinct())


def _checked_broadcast(ids: DataFrame) -> DataFrame:
    """Broadcast an id table only after counting it; larger tables are joined by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def verified(tmp: Scratch, pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """The written pairs (a, b) whose full shingle sets reach the threshold. ``texts``: (id, text)."""
    ids = tmp.table(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    sets = tmp.table(texts.join(_checked_broadcast(ids), "id", "left_semi").mapInArrow(_sets, "id long, set binary"), "sets")
    left = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    joined = pairs.join(left, "b").join(right, "a").select("a", "b", "set_a", "set_b")
    out = tmp.table(joined.mapInArrow(_verify(threshold), "a long, b long"), "links")
    tmp.drop(ids, sets)
    return out


def components(tmp: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, comp) for every node of ``edges`` (a, b): the smallest id it reaches.

    Alternating large-star and small-star steps; each round shortens what is left of long
    chains. Neighbourhood minima are aggregates joined back to the edges, never lists.
    """
    e = tmp.table(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = big.groupBy("v").agg(F.min("u").alias("m"))
        small = (big.join(low, "v")
                 .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
                                           F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u <> v").distinct())
        last, e = e, tmp.table(small, "edges")
        tmp.drop(last)
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
    else:
        raise RuntimeError("components did not settle")
    out = tmp.table(e.select(F.col("v").alias("id"), F.col("u").alias("comp")).unionByName(
        e.select(F.col("u").alias("id"), F.col("u").alias("comp"))).distinct(), "components")
    tmp.drop(e)
    return out


def _estimate_ok(threshold: int):
    """The estimate from the digests, corrected for chance, is not far below the threshold.

    Unlike registers are equal if their leading zeros and mantissas are; the bits of registers that differ agree half the time.
    """
    t = threshold / 100.0
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    agree = 64 - F.bit_count(F.col("dig_a").bitwiseXOR(F.col("dig_b")))
    equal = SAME_ZEROS / (1 << MANTISSA) * 4 * a * b / ((a + b) * (a + b))
    chance = (equal + 1) / 2
    estimate = (agree / 64.0 - chance) / (1 - chance)
    spread = F.sqrt((1 - t * t) / 64 + t * (1 - t) / F.least(a, b))     # of the bits, of the shingles behind the registers
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold
    return sizes & (estimate >= t - DEVIATIONS * spread)


def _members(tmp: Scratch, full: DataFrame) -> DataFrame:
    """(doc_id, id): the smallest document of each document's class."""
    same = ["fp1", "fp2", "n_shingles"]
    classes = tmp.table(full.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    share = (classes.agg(F.sum("n").alias("n")).first()["n"] or 0) / HOT
    hot = F.broadcast(classes.where(F.col("n") > share).select(*same, "id"))         # fewer than HOT rows
    rows = full.select("doc_id", *same)
    large = rows.join(hot, same).select("doc_id", "id")
    small = rows.join(hot, same, "left_anti").join(classes.where(F.col("n") <= share), same).select("doc_id", "id")
    out = tmp.table(large.unionByName(small), "member")
    tmp.drop(classes)
    return out


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    tmp = Scratch(docs.sparkSession, "neardup")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signed = tmp.table(base.mapInArrow(
        _sign, "doc_id long, n_shingles long, fp1 long, fp2 long, digest long, bands binary"), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    member = _members(tmp, full)
    heads = member.where("doc_id = id").select("doc_id").distinct()
    rep = full.join(heads, "doc_id", "left_semi")
    info = tmp.table(rep.groupBy(F.col("doc_id").alias("id")).agg(F.max("n_shingles").alias("n"), F.max("digest").alias("dig")), "info")
    keys = rep.select("doc_id", "bands").mapInArrow(_explode_bands, "key long, id long")
    head = keys.groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last")
    rows = tmp.table(keys.join(head.select("key", "head"), "key").select("key", "head", "id"), "buckets")
    texts = base.select(F.col("doc_id").alias("id"), "text")

    def near(pairs: DataFrame, *keep: str) -> DataFrame:
        """Pairs that the sizes and the digest estimate leave open, with the digest agreement."""
        a = info.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("dig").alias("dig_a"))
        b = info.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("dig").alias("dig_b"))
        agree = 64 - F.bit_count(F.col("dig_a").bitwiseXOR(F.col("dig_b")))
        return pairs.join(a, "a").join(b, "b").where(_estimate_ok(threshold)).select("a", "b", *keep, agree.alias("agree"))

    def label(df: DataFrame, comp: DataFrame, c: str, out: str) -> DataFrame:
        found = comp.select(F.col("id").alias(c), F.col("comp").alias("_comp"))
        return df.join(found, c, "left").withColumn(out, F.coalesce("_comp", c)).drop("_comp")

    # every class meets the heads of its buckets: first the one it shares most bands with (the
    # centre of a family, if that is its smallest member), then the others outside its component
    star = rows.where("id <> head").groupBy(F.col("head").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    star = tmp.table(near(star, "shared"), "star")
    closest = F.max_by("a", F.struct("shared", "agree", -F.col("a")))
    chosen = tmp.table(star.groupBy("b").agg(closest.alias("a")).select("a", "b"), "chosen")
    links = verified(tmp, chosen, texts, threshold)
    comp = components(tmp, links)
    other = label(label(star.select("a", "b").join(chosen, ["a", "b"], "left_anti"), comp, "a", "ca"), comp, "b", "cb")
    other = tmp.table(other.where("ca <> cb").select("a", "b"), "other")
    more = verified(tmp, other, texts, threshold)
    tmp.drop(comp)
    comp = components(tmp, links.unionByName(more))

    # classes of one bucket that are no heads and still in different components
    tagged = label(rows, comp, "id", "comp")
    mixed = (tagged.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
             .where("lo <> hi and size > 2").select("key", F.ceil((F.col("size") - 1) / BLOCK).cast("int").alias("parts")))
    rest = tmp.table(tagged.where("id <> head").join(mixed, "key").select("key", "parts", "id", "comp"), "mixed")
    later = tmp.table(block_pairs(tmp, rest, texts, threshold), "later")
    last = verified(tmp, later, texts, threshold)
    tmp.drop(comp)
    comp = components(tmp, links.unionByName(more).unionByName(last))
    tmp.drop(info, rows, star, chosen, other, links, more, rest, later, last)

    groups = (member.join(comp, "id", "left").select("doc_id", F.coalesce("comp", "id").alias("component_id"))
              .groupBy("doc_id").agg(F.min("component_id").alias("component_id")))
    out = signed.select("doc_id", "n_shingles").join(groups, "doc_id", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` that stand for their group; all columns stay."""
    found = near_duplicates(docs, threshold)
    lost = found.where(~F.col("kept")).select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_lost"], "left_anti")
