"""Mixing sources to target weights by a splitting tree (operator 6). DataFrame and SQL functions only.

Targets share all words by the sources' weights; a source stops at ``MOST`` times its size and the excess is shared again (water
filling, solved in one pass over the sources in order of size per weight). A target is whole epochs plus a rest.

* A document's place in its source's permutation is a 60-bit keyed hash; its top bits
  name its block of about ``BLOCK_DOCS`` documents, at every size of a source, so blocks are disjoint and permuted. An epoch takes every block once; the rest takes blocks in a keyed
  order until the next would pass it. That block is cut by its documents' hashes: a histogram of
  the next bits finds the cell that holds the cut, four times, down to one hash.
* Every source so has an exact quota of block draws. A binary tree splits the vector of quotas among
  the output shards: at each node the left half gets a multivariate hypergeometric draw (one
  hypergeometric per source, by inversion from its mode) and the right half the remainder. The leaves'
  running sums deal each source's draws out as disjoint ranges.
* Inside a shard documents are ordered by another keyed hash.

Blocks and draws are numbered by range partitions, so a large source's are split; a histogram level holds at most 4096 cells a source. One row
holds the quotas of all sources. Everything is keyed by hashes of the rows, so reruns agree.

Contract for odd rows: null text has size 0 and is never taken; a null source is a source of its own, last in
order; repeated rows share a hash and share what falls on it; a source without words has target 0; extra columns stay in
:func:`mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taintrank.operators.rank import ordered_positions
from taintrank.session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
WEIGHTS = (1, 2, 3)
SHARD_WORDS = 1 << 20
BLOCK_DOCS = 64
BITS = 60
LEVELS = (24, 36, 48, 60)
BROADCAST_ROWS = 300_000


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``fn``."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def uniform(*parts: Column) -> Column:
    """A keyed number in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """Inverse-transform draw of the number of ``good`` among ``drawn`` of ``total``.

    Outcomes are listed from the mode upwards, then downwards, to twelve standard deviations; each weight follows from the
    one before it, so no factorial is needed.
    """
    start = F.struct(good.alias("g"), total.alias("n"), drawn.alias("m"), u.alias("u"))

    def sized(v: Column) -> Column:
        g, n, m = v["g"].cast("double"), v["n"].cast("double"), v["m"].cast("double")
        mode = F.floor((m + 1) * (g + 1) / (n + 2)).cast("long")
        least, most = F.greatest(F.lit(0).cast("long"), v["m"] + v["g"] - v["n"]), F.least(v["g"], v["m"])
        share = g / F.greatest(n, F.lit(1.0))
        sd = F.sqrt(F.greatest(m * share * (1 - share) * (n - m) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
        return F.struct(g.alias("g"), n.alias("n"), m.alias("m"), v["u"].alias("u"),
                        F.greatest(least, F.least(most, mode)).alias("mode"), least.alias("least"), most.alias("most"),
                        (F.ceil(sd * 12) + 12).cast("long").alias("w"))

    def walk(v: Column, up: bool, limit: Column | None) -> Column:
        """(p, s, pick): running sum of weights and the first outcome at which it passes ``limit``."""
        mode = v["mode"].cast("double")

        def after(k: Column) -> Column:
            if up:
                return (v["g"] - k) * (v["m"] - k) / ((k + 1) * (v["n"] - v["g"] - v["m"] + k + 1))
            return k * (v["n"] - v["g"] - v["m"] + k) / ((v["g"] - k + 1) * (v["m"] - k + 1))

        def step(a: Column, i: Column) -> Column:
            k = mode + i if up else mode - 1 - i
            s = a["s"] + a["p"]
            pick = F.lit(-1).cast("long") if limit is None else F.when((a["pick"] < 0) & (s > limit), k.cast("long")).otherwise(a["pick"])
            return F.struct((a["p"] * after(k)).alias("p"), s.alias("s"), pick.alias("pick"))

        first = F.lit(1.0) if up else after(mode)
        reach = F.least(v["w"], v["most"] - v["mode"] if up else v["mode"] - v["least"] - 1)
        zero = F.struct(first.alias("p"), F.lit(0.0).alias("s"), F.lit(-1).cast("long").alias("pick"))
        steps = F.when(reach >= 0, F.sequence(F.lit(0).cast("long"), F.greatest(reach, F.lit(0).cast("long")))).otherwise(
            F.array().cast("array<bigint>"))
        return F.aggregate(steps, zero, step)

    def draw(v: Column) -> Column:
        def sums(t: Column) -> Column:
            limit = v["u"] * (t["a"] + t["b"])
            high, low = walk(v, True, limit)["pick"], walk(v, False, limit - t["a"])["pick"]
            return F.when(limit < t["a"], F.when(high >= 0, high).otherwise(v["mode"])).otherwise(
                F.when(low >= 0, low).otherwise(v["mode"]))
        return let(F.struct(walk(v, True, None)["s"].alias("a"), walk(v, False, None)["s"].alias("b")), sums)

    return let(let(start, sized), draw)


def split_quotas(quotas: Column, *key: Column) -> Column:
    """The left half's quotas: a multivariate hypergeometric draw of half of all units."""
    zero = F.lit(0).cast("long")
    total = F.aggregate(quotas, zero, lambda a, q: a + q)

    def step(a: Column, i: Column) -> Column:
        def put(v: Column) -> Column:
            x = hypergeometric(v["q"], v["n"], v["m"], uniform(*key, i))
            return let(x, lambda y: F.struct((v["n"] - v["q"]).alias("n"), (v["m"] - y).alias("m"), F.concat(v["out"], F.array(y)).alias("out")))
        return let(F.struct(F.element_at(quotas, i).alias("q"), a["n"].alias("n"), a["m"].alias("m"), a["out"].alias("out")), put)

    def run(n: Column) -> Column:
        begin = F.struct(n.alias("n"), F.floor(n / 2).cast("long").alias("m"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(quotas)), begin, step)["out"]

    return F.when(F.size(quotas) > 0, let(total, run)).otherwise(quotas)


def tree(root: DataFrame, depth: int, seed: int) -> DataFrame:
    """(shard, quotas) for 2**depth shards from one row (quotas)."""
    df = root.select(F.lit(0).cast("long").alias("node"), "quotas")
    for level in range(depth):
        key = [F.lit(seed), F.lit(level), F.col("node")]

        def halves(left: Column) -> Column:
            right = F.zip_with("quotas", left, lambda q, x: q - x)
            return F.array(F.struct((F.col("node") * 2).alias("node"), left.alias("quotas")),
                           F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("quotas")))

        df = df.select(F.explode(let(split_quotas(F.col("quotas"), *key), halves)).alias("h")).select("h.node", "h.quotas")
        if level == 6:
            df = df.repartition("node")              # 128 subtrees go on apart
    return df.withColumnRenamed("node", "shard")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with _size (words of the text) and _rk (place in the source's permutation)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return (docs.withColumn("_size", F.regexp_count(text, F.lit(WORD)).cast("long"))
            .withColumn("_rk", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 64 - BITS)))


def targets(rows: DataFrame) -> DataFrame:
    """Per source: sid, docs, source_size, target, epochs, rest. One row per source, so plain windows do."""
    total = rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("docs"))
    by_name, every = W.orderBy(F.col("source").asc_nulls_last()), W.partitionBy()
    s = total.withColumn("sid", F.row_number().over(by_name)).withColumn("words", F.sum("source_size").over(every))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") - 1) % len(WEIGHTS) + 1)
    s = s.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    s = s.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = W.orderBy("full_at", "sid")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("words") - before) / after)
    s = s.withColumn("rate", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("rate") * F.col("weight"), F.col("cap"))))
    take = F.round("target").cast("long")
    some = F.col("source_size") > 0
    s = s.withColumn("epochs", F.when(some, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long"))
    s = s.withColumn("rest", F.when(some, take - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0)).cast("long"))
    bits = F.ceil(F.log2(F.greatest(F.col("docs") / BLOCK_DOCS, F.lit(1.0)))).cast("int")
    return s.withColumn("bits", F.least(bits, F.lit(LEVELS[-1]))).select(
        "source", "sid", "docs", "source_size", "target", "epochs", "rest", "bits")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast a table only when it was counted to be small; otherwise it is joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _block(bits: str = "bits") -> Column:
    return F.expr(f"shiftrightunsigned(_rk, {BITS} - {bits})")


def _first_over(cells: DataFrame, order: list[str]) -> DataFrame:
    """Cells (sid, left, cell, words, ...) with cum, the words up to and with the cell in ``order``."""
    return cells.withColumn("cum", F.sum("words").over(W.partitionBy("sid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))


def plan(rows: DataFrame, seed: int, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): per source its targets and the cut, per block its draws (epoch, shard, part)."""
    source = tmp.table(targets(rows), "targets")
    placed = rows.select("source", "_size", "_rk").join(_small(source.select("source", "sid", "bits", "rest", "epochs")).alias("t"),
                                                        rows["source"].eqNullSafe(F.col("t.source"))).select("sid", "bits", "rest", "epochs", "_size", "_rk")
    block = placed.groupBy("sid", "bits", "rest", "epochs", _block().alias("cell")).agg(F.sum("_size").alias("words"))
    block = block.withColumn("perm", F.xxhash64(F.lit(seed), F.lit("rest"), "sid", "cell"))
    block = tmp.table(block.withColumn("_perm", F.col("perm").cast("double")), "cells")
    block = tmp.table(ordered_positions(block, ["sid"], "_perm", False, [F.col("perm").asc(), F.col("cell").asc()], sums=[("words", "cum")]).drop("_perm"), "blocks")
    cut = block.where("cum > rest and cum - words <= rest and words > 0")
    edge = tmp.table(cut.select("sid", F.col("cell").alias("pre"), F.col("bits").alias("have"), (F.col("rest") - F.col("cum") + F.col("words")).alias("left")), "edge")
    first = edge.select("sid", F.col("pre").alias("cut_block"))
    narrow = placed.select("sid", "_size", "_rk")
    for want in LEVELS:
        inside = narrow.join(_small(edge), "sid").where(F.expr(f"shiftrightunsigned(_rk, {BITS} - have)") == F.col("pre"))
        inside = inside.withColumn("want", F.greatest("have", F.lit(want)))       # a block may be narrower than the level
        cell = inside.groupBy("sid", "left", "want", F.expr(f"shiftrightunsigned(_rk, {BITS} - want)").alias("cell")).agg(
            F.sum("_size").alias("words"), F.count("*").alias("n"))
        cell = _first_over(cell, ["cell"]).where("cum > left and cum - words <= left and words > 0")
        last, edge = edge, tmp.table(cell.select("sid", F.col("cell").alias("pre"), F.col("want").alias("have"),
                                                 (F.col("left") - F.col("cum") + F.col("words")).alias("left"), "n"), "edge")
    cuts = edge.select("sid", F.col("pre").alias("cut_rk"), F.expr("left div n").alias("cut_take")).join(first, "sid")
    sources = tmp.table(source.join(cuts, "sid", "left"), "sources")

    # quotas of block draws, split among the shards
    part = F.when(F.col("cum") <= F.col("rest"), F.lit("whole")).when(
        (F.col("cum") - F.col("words") < F.col("rest")) & (F.col("words") > 0), F.lit("cut"))
    draws = block.where("words > 0").select("sid", "cell", "epochs", part.alias("rest_part"), "perm").select(
        "sid", "cell", F.explode(F.concat(
            F.when(F.col("epochs") > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("epochs"), F.lit(1).cast("long"))),
                                                    lambda e: F.struct((e - 1).alias("epoch"), F.lit("whole").alias("part"))))
            .otherwise(F.array().cast("array<struct<epoch:bigint,part:string>>")),
            F.when(F.col("rest_part").isNotNull(), F.array(F.struct(F.col("epochs").alias("epoch"), F.col("rest_part").alias("part"))))
            .otherwise(F.array().cast("array<struct<epoch:bigint,part:string>>")))).alias("d")).select("sid", "cell", "d.epoch", "d.part")
    draws = tmp.table(draws.withColumn("_deal", F.xxhash64(F.lit(seed), F.lit("deal"), "sid", "epoch", "cell")).withColumn("_epoch", F.col("epoch").cast("double")), "draws")
    order = [F.col("epoch").asc(), F.col("_deal").asc(), F.col("cell").asc()]
    placed_draws = ordered_positions(draws, ["sid"], "_epoch", False, order, sums=[(None, "at")])
    draws = tmp.table(placed_draws.select("sid", "cell", "epoch", "part", (F.col("at") - 1).alias("at")), "dealing")
    quota = source.select("sid").join(draws.groupBy("sid").agg(F.count("*").alias("q")), "sid", "left")
    root = quota.agg(F.transform(F.array_sort(F.collect_list(F.struct("sid", F.coalesce("q", F.lit(0)).cast("long").alias("q")))),
                                 lambda x: x["q"]).alias("quotas"))
    words = source.agg(F.sum(F.round("target"))).first()[0] or 0
    depth = max(0, int(words) // SHARD_WORDS).bit_length()
    leaf = tree(root, depth, seed).select("shard", F.posexplode("quotas").alias("k", "n")).withColumn("sid", (F.col("k") + 1).cast("int"))
    leaf = leaf.withColumn("to", F.sum("n").over(W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    dealt = leaf.where("n > 0").select("sid", "shard", F.explode(F.sequence(F.col("to") - F.col("n"), F.col("to") - 1)).alias("at"))
    blocks = draws.join(dealt, ["sid", "at"]).groupBy("sid", F.col("cell").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("epoch", "shard", "part"))).alias("dealt"))
    blocks = tmp.table(blocks, "dealt")
    tmp.drop(block, draws, edge, source)
    return sources, blocks


def draw(rows: DataFrame, seed: int = 17, keep: list[str] | None = None, stats: DataFrame | None = None) -> DataFrame:
    """``rows`` (from :func:`sized`) with source_size, target and draws: an array of (shard, place, words), one for each time the document is taken.

    ``stats`` may be a narrow copy (source, _size, _rk) of the same rows, for the counting passes.
    """
    tmp = Scratch(rows.sparkSession, "mixing")
    sources, blocks = plan(stats if stats is not None else rows, seed, tmp)
    s = _small(sources.select(F.col("source").alias("_source"), "sid", "source_size", "target", "bits", "cut_rk", "cut_take", "cut_block"))
    keep = keep or rows.columns
    out = rows.join(s, rows["source"].eqNullSafe(s["_source"])).withColumn("block", _block())
    out = out.join(_small(blocks), ["sid", "block"], "left")
    cut = F.when(F.col("_rk") < F.col("cut_rk"), F.col("_size")).when(
        F.col("_rk") == F.col("cut_rk"), F.least("cut_take", "_size")).otherwise(F.lit(0).cast("long"))
    each = F.transform(F.coalesce("dealt", F.array().cast("array<struct<epoch:bigint,shard:bigint,part:string>>")), lambda d: F.struct(
        d["shard"].alias("shard"), F.xxhash64(F.lit(seed), F.lit("place"), d["shard"], d["epoch"], F.col("_rk")).alias("place"),
        F.when(d["part"] == "whole", F.col("_size")).otherwise(F.coalesce(cut, F.lit(0).cast("long"))).alias("words")))
    return out.select(*keep, "source_size", "target", F.filter(each, lambda d: d["words"] > 0).alias("draws"))


def taken(docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken per row."""
    tmp = Scratch(docs.sparkSession, "mixing-rows")
    rows = tmp.table(sized(docs.select("doc_id", "text", "source"), seed).drop("text"), "rows")
    out = draw(rows, seed)
    words = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", words.alias("taken"))


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, shard by shard in shuffled order.

    Documents are taken whole here: a cut document stays if half of it or more is taken.
    """
    tmp = Scratch(docs.sparkSession, "mixing-rows")
    stats = tmp.table(sized(docs.select("doc_id", "text", "source"), seed).select("source", "_size", "_rk"), "rows")
    packed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source")   # no name of ``docs`` can clash
    out = draw(sized(packed, seed), seed, keep=["_row", "_size"], stats=stats)
    out = out.select("_row", "_size", F.explode("draws").alias("_d")).where(F.col("_d.words") * 2 >= F.col("_size"))
    return out.repartition("_d.shard").sortWithinPartitions("_d.shard", "_d.place").select("_row.*")
