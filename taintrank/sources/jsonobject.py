"""One JSON document of any size as rows, and rows as one JSON document.

Reading: Spark's text source cuts the files at every quote, so a document without a line end is split like any
other, and any store that Spark reads will do. A ``.gz`` one as written here is cut too (:mod:`.blockgzip`); other gzip is one stream, read by one task.
Three scans, one driver row per file split:

1. per split, the number of quotes that no backslash escapes and the change of depth; running sums say whether a split starts inside a string, and how deep;
2. per split, the text before its first and after its last safe point (a comma that ends a member): what stands between
   two splits' safe points is glued and read on its own. Files of one split skip this scan;
3. the members between the safe points, a bounded number of pieces of text at a time.

Writing: Spark writes (and compresses) the members in parallel; then the parts are joined into one file through a fixed buffer of the file system's client. One
file has one writer, so tables beyond what one stream should carry belong in ``.jsonl``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut_lineage, delete_path
from . import blockgzip

_STRUCTURE = re.compile(r"[{}\[\],]")
_OUT = "file string, block long, key string, raw string"
_PIECE = "file string, block long, side int, depth int, key string, raw string"


class Members:
    """Members of a document at one depth, fed with the text between quotes.

    ``depth`` 0: the top-level values; 1: the members of the top-level container; 2: those of each of its
    members, whose ``key`` goes with them. ``whole`` is False for a split that starts inside a document: nothing before its first safe point counts.
    """

    def __init__(self, wanted: int, depth: int = 0, inside: bool = False, key: str | None = None, whole: bool = True):
        self.wanted, self.depth, self.inside, self.key, self.started = wanted, depth, inside, key, whole
        self.head: str | None = None
        self.member: list[str] = []
        self.label: list[str] = []
        self.pending: list[tuple[str | None, str]] = []
        self.safe: list[tuple[str | None, str]] = []        # members before the last safe point
        self.since: list[str] = []                          # text after it
        self.since_depth, self.since_key = depth, key

    def feed(self, text: str, quote: str = '"') -> None:
        """The next text and the quote behind it."""
        if self.inside:
            if (len(text) - len(text.rstrip("\\"))) % 2 == 0:
                self.inside = False
            self._keep(text + quote)
            self.since.append(text + quote)
            return
        at = self._outside(text) if _STRUCTURE.search(text) else 0
        self._keep(text[at:] + quote)
        self.since.append(text[self._cut:] + quote if at else text + quote)
        self.inside = True

    _cut = 0

    def _keep(self, text: str) -> None:
        if self.depth >= self.wanted:
            self.member.append(text)
        elif self.depth == self.wanted - 1:
            self.label.append(text)

    def _outside(self, text: str) -> int:
        at = self._cut = 0
        for m in _STRUCTURE.finditer(text):
            c = m[0]
            if c == ",":
                if self.depth > self.wanted:
                    continue
                if self.depth == self.wanted:
                    self._member(text[at:m.start()])
                at = m.end()
                self.label = []
                self._safe_point(text, at)
            elif c in "{[":
                if self.depth == self.wanted - 1:
                    self.key = ("".join(self.label) + text[at:m.start()]).strip().rstrip(":").rstrip() or None
                if self.depth < self.wanted:
                    self.label, self.member = [], []
                    at = m.end()
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.wanted - 1:
                    self._member(text[at:m.start()])
                if self.depth < self.wanted:
                    self.label = []
                    at = m.end()
                elif self.depth == self.wanted == 0:
                    self._member(text[at:m.end()])
                    at = m.end()
                    self._safe_point(text, at)
        return at

    def _member(self, text: str) -> None:
        raw = ("".join(self.member) + text).strip()
        self.member = []
        if raw:
            self.pending.append((self.key, raw))

    def _safe_point(self, text: str, at: int) -> None:
        if self.started:
            self.safe += self.pending
        else:
            self.head = "".join(self.since) + text[self._cut:at]
            self.started, self.key = True, None             # the key is that of the glued text before
        self.pending, self.since, self._cut = [], [], at
        self.since_depth, self.since_key = self.depth, self.key

    def take(self) -> list[tuple[str | None, str]]:
        out, self.safe = self.safe, []
        return out


def glued(text: str, wanted: int, depth: int, key: str | None) -> tuple[list[tuple[str | None, str]], str | None]:
    """Members of the text between two splits' safe points, and the key it ends with."""
    m = Members(wanted, depth, key=key)
    *body, last = text.split('"')
    for part in body:
        m.feed(part)
    if m.inside:
        m.feed(last, "")
    else:
        m._outside(last)
    return m.safe + m.pending, m.key


# ------------------------------------------------------------------ Spark

def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep='"').select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of rows of one file split, in file order."""
    for batch in batches:
        file, block, value = (batch.column(i).to_pylist() for i in range(3))
        lo = 0
        for i in range(1, len(file) + 1):
            if i == len(file) or block[i] != block[lo] or file[i] != file[lo]:
                yield (file[lo], block[lo]), value[lo:i]
                lo = i


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: quotes that are not escaped, and the change of depth in the texts with an even or odd number of them before."""
    found: dict[tuple[str, int], list] = {}
    for split, values in _by_split(batches):
        s = found.setdefault(split, [0, 0, 0, ""])
        for v in values:
            if not s[3] and not s[0]:
                s[3] = v.strip()[:1]
            if not v.endswith("\\") or (len(v) - len(v.rstrip("\\"))) % 2 == 0:
                s[1 + s[0] % 2] += v.count("{") + v.count("[") - v.count("}") - v.count("]")
                s[0] += 1
            # a text before an escaped quote stands in a string: it changes no depth
    rows = [(f, b, *s) for (f, b), s in found.items()]
    columns = list(zip(*rows)) if rows else [()] * 6
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "quotes", "even", "odd", "first"])


class Layout:
    """How every split of the files starts: (depth, inside a string, first split, last split)."""

    def __init__(self, segments: DataFrame):
        rows = segments.mapInArrow(_summary, "file string, block long, quotes long, even long, odd long, first string").collect()
        self.splits: dict[tuple[str, int], tuple[int, bool, bool, bool]] = {}
        self.first: set[str] = set()
        per_file: dict[str, list] = {}
        for r in rows:
            per_file.setdefault(r.file, []).append(r)
        for file, own in per_file.items():
            own.sort(key=lambda r: r.block)
            depth, inside = 0, False
            for i, r in enumerate(own):
                self.splits[(file, r.block)] = (depth, inside, i == 0, i == len(own) - 1)
                depth += r.odd if inside else r.even
                inside ^= bool(r.quotes % 2)
            self.first.add(own[0].first)
        self.several = any(len(own) > 1 for own in per_file.values())


def _read(shared, wanted: int, pieces: bool):
    def done(split, m: Members) -> list[tuple]:
        """What a finished split leaves over."""
        _, _, first, last = shared.value[split]
        if not pieces:
            return [(*split, k, raw) for k, raw in m.take() + (m.pending if last and m.started else [])]
        if not m.started:
            return [(*split, 1, 0, None, "".join(m.since))]
        out = [(*split, 0, 0, None, m.head)] if not first else []
        tail = [] if last else [(*split, 2, m.since_depth, m.since_key, "".join(m.since))]
        return out + tail + [(*split, 3, 0, m.key, None)]

    schema = pa.schema([(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]])
                        for f in (_PIECE if pieces else _OUT).split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, m, out = None, None, []
        for split, values in _by_split(batches):
            if split != at:
                out += done(at, m) if m else []
                depth, inside, first, _ = shared.value[split]
                at, m = split, Members(wanted, depth, inside, whole=first)
            for v in values:
                m.feed(v)
            taken = m.take()
            if not pieces:
                out += [(*split, k, raw) for k, raw in taken]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        out += done(at, m) if m else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def _glue(wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, block, depth, key, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found, last = glued(text, wanted, depth, key)
                out += [(file, block, k, raw) for k, raw in found] + [(file, block, last, None)]
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()))],
                                             names=["file", "block", "key", "raw"])
    return run


def members(spark: SparkSession, path: str, wanted: int | None = None) -> DataFrame:
    """(key, raw): the members of the JSON documents at ``path``, as JSON text.

    ``wanted`` 1 takes the members of the top-level container, 2 those of each of its members (``key`` is the outer member's, as
    JSON text), None the records: the members of a top-level array, or every top-level value.
    """
    segments = blockgzip.in_splits(spark, path)
    if segments is None:
        segments = _segments(spark, path)
    layout = Layout(segments)
    if wanted is None:
        wanted = 1 if layout.first <= {"[", ""} else 0
    shared = spark.sparkContext.broadcast(layout.splits)
    rows = segments.mapInArrow(_read(shared, wanted, False), _OUT)
    if not layout.several:
        return rows.select("key", "raw")
    left = cut_lineage(segments.mapInArrow(_read(shared, wanted, True), _PIECE), "json_pieces")
    order = Window.partitionBy("file").orderBy("block", "side")
    text = left.where("side < 3").withColumn("glue", F.sum((F.col("side") == 2).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    glue = text.groupBy("file", "glue").agg(F.sort_array(F.collect_list(F.struct("block", "side", "depth", "key", "raw"))).alias("p"))
    glue = glue.select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["depth"].alias("depth"), F.col("p")[0]["key"].alias("key"),
                       F.array_join("p.raw", "").alias("text"))
    between = cut_lineage(glue.mapInArrow(_glue(wanted), _OUT), "json_between")
    inner = between.where("raw is not null")
    if wanted < 2:
        return rows.select("key", "raw").unionByName(inner.select("key", "raw"))
    # a split's first members may belong to a key that stands before it
    seen = left.where("side = 3").select("file", "block", F.lit(0).alias("step"), "key").unionByName(
        between.where("raw is null").select("file", "block", F.lit(1).alias("step"), "key"))
    before = Window.partitionBy("file").orderBy("block", "step").rowsBetween(Window.unboundedPreceding, -1)
    known = cut_lineage(seen.select("file", "block", "step", F.last("key", ignorenulls=True).over(before).alias("_before")), "json_keys")
    both = rows.withColumn("step", F.lit(0)).unionByName(inner.withColumn("step", F.lit(1)))
    return both.join(F.broadcast(known), ["file", "block", "step"], "left").select(F.coalesce("key", "_before").alias("key"), "raw")


def entry(key: Column, value: Column) -> Column:
    """``"key":value`` as JSON text."""
    whole = F.to_json(F.create_map(key.cast("string"), value))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def label(key: Column) -> Column:
    """``"key":`` as JSON text."""
    whole = F.to_json(F.create_map(key.cast("string"), F.lit(0)))
    return F.substr(whole, F.lit(2), F.length(whole) - 3)


def write_document(lines: DataFrame, path: str, opening: str, closing: str, skip: int, compress: bool, mode: str = "overwrite") -> None:
    """Write the text column of ``lines`` in partition order as one file: ``opening``, the lines without the first ``skip`` bytes, ``closing``."""
    spark = lines.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target) and mode != "overwrite":
        if mode == "ignore":
            return
        raise FileExistsError(path)
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    if compress:
        skip = blockgzip.write_members(lines, parts, skip)
    else:
        lines.write.text(parts)
    names = sorted(s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts)) if s.getLen())
    names = [n for n in names if n.startswith("part-")]
    fs.delete(target, True)
    out = fs.create(target)
    before, after = (opening if names else opening[:1] + closing[-1:]).encode(), (closing if names else "").encode()
    if compress:                                            # every part ends with the header of the member behind it; an empty member ends the file
        header = blockgzip.HEADER
        before = header + blockgzip.member(before) + header
        after = (blockgzip.member(after) + header if after else b"") + blockgzip.member(b"")
    out.write(bytearray(before))
    for k, name in enumerate(names):
        source = fs.open(jvm.org.apache.hadoop.fs.Path(f"{parts}/{name}"))
        if k == 0:
            source.seek(skip)
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.write(bytearray(after))
    out.close()
    delete_path(spark, parts)
