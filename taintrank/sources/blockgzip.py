"""Gzip that is read in splits: a file of many small gzip members, each with its length in its header (BGZF, the form of bgzip).

Any gzip reader reads such a file whole. Every member begins with the same 16 bytes, so Spark's text sink and source write and cut it with
these as line separator, on any store that Spark reads. The source takes the codec from the name and cuts no ``.gz``; the options of
:func:`_raw` keep the gzip codec from this one read. Where they do not, or a file has other members, :func:`in_splits` says None and the file is streamed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
TEXT_BYTES = 1 << 14                # text of a member; a batch of Arrow holds thousands of members
_SEPARATOR = {"encoding": "ISO-8859-1", "lineSep": HEADER.decode("latin-1")}
_SEGMENTS_BYTES = 1 << 20
Split = tuple[str, int]


def member(data: bytes, stored: bool = False) -> bytes:
    """A gzip member of ``data`` without its HEADER; ``stored`` makes its length depend on the length of ``data`` only."""
    if stored:
        body = struct.pack("<BHH", 1, len(data), len(data) ^ 0xFFFF) + data
    else:
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data) + z.flush()
    return struct.pack("<H", len(HEADER) + 2 + len(body) + 8 - 1) + body + struct.pack("<II", zlib.crc32(data), len(data))


def text_of(body: bytes) -> bytes:
    data = zlib.decompress(body[2:-8], -15)
    if struct.unpack("<II", body[-8:]) != (zlib.crc32(data), len(data)):
        raise ValueError("a gzip member's checksum is wrong")
    return data


# ------------------------------------------------------------------ writing

def _members(skip: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = bytearray(), skip
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held += b"".join((v or b"") + b"\n" for v in batch.column(0).slice(lo, 256).to_pylist())
                out = []
                if first and len(held) >= first:
                    out.append(member(bytes(held[:first]), stored=True))
                    del held[:first]
                    first = 0
                full = len(held) // TEXT_BYTES * TEXT_BYTES
                out += [member(bytes(held[i:i + TEXT_BYTES])) for i in range(0, full, TEXT_BYTES)]
                del held[:full]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["body"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([member(bytes(held))], pa.binary())], names=["body"])
    return run


def write_members(lines: DataFrame, path: str, skip: int) -> int:
    """Write the text column of ``lines`` as members, each with the HEADER of the next behind it; the first ``skip`` bytes
    of a partition are a member of their own. Returns that member's bytes in a file."""
    column = F.col(lines.columns[0]).cast("binary").alias("text")
    bodies = lines.select(column).mapInArrow(_members(skip), "body binary")
    bodies.select(F.col("body").cast("string")).write.options(**_SEPARATOR).text(path)
    return len(member(b" " * skip, stored=True)) + len(HEADER)


# ------------------------------------------------------------------ reading

def _raw(spark: SparkSession) -> dict[str, str]:
    """Options of a read that takes the bytes of ``.json.gz`` files as they are: a pass-through codec whose ending comes between ``.gz`` and
    the file's in the factory's order, which then looks no further."""
    codec = spark._jvm.org.apache.hadoop.io.compress.PassthroughCodec
    return {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec", codec.OPT_EXTENSION: ".-.gz"}


def _in_members(spark: SparkSession, path: str) -> bool:
    """Whether every file at ``path`` begins with a HEADER and is read without a codec."""
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration(spark._jsc.hadoopConfiguration())
    for k, v in _raw(spark).items():
        conf.set(k, v)
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in spark.read.text(path).inputFiles()]
    for file in files:
        fs = file.getFileSystem(conf)
        if codecs.getCodec(file) is not None or fs.getFileStatus(file).getLen() < len(HEADER):
            return False
        source = fs.open(file)
        begins = struct.pack(">qq", source.readLong(), source.readLong())
        source.close()
        if begins != HEADER:
            return False
    return bool(files)


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, bytes | None]]:
    """Members without HEADER, in file order; None for what is no member. A HEADER among a member's bytes cuts nothing: the length tells."""
    at, held = None, None
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            for file, block, v in zip(*(batch.column(i).slice(lo, 64).to_pylist() for i in range(3))):
                if (file, block) != at:
                    if held is not None:
                        yield at, None
                    at, held = (file, block), None
                v = v if held is None else held + HEADER + v
                held = None
                if not v:
                    continue                                # before the first HEADER of the file
                size = struct.unpack("<H", v[:2])[0] + 1 - len(HEADER) if len(v) > 1 else 2
                if len(v) < size:
                    held = v
                else:
                    yield at, v if len(v) == size >= 12 else None
    if held is not None:
        yield at, None


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per split: its text before the first quote, whether there is a quote, whether all are members."""
    found: dict[Split, list] = {}
    for split, body in _bodies(batches):
        s = found.setdefault(split, [[], False, True])
        if body is None:
            s[2] = False
        elif not s[1]:
            text, quote, _ = text_of(body).partition(b'"')
            s[0].append(text)
            s[1] = bool(quote)
    rows = [(f, b, b"".join(head), quote, good) for (f, b), (head, quote, good) in found.items()]
    types = [pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]
    columns = list(zip(*rows)) if rows else [()] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "block", "head", "quote", "good"])


def _borders(rows: list) -> dict[Split, tuple[int, bytes, bool, bool]]:
    """Per split that has text between quotes of its own: (bytes before it, bytes of the next splits that end it, whether a quote stands behind these, first
    split). Text before a split's first quote belongs to the split before."""
    out = {}
    per_file: dict[str, list] = {}
    for r in rows:
        per_file.setdefault(r.file, []).append(r)
    for file, own in per_file.items():
        own.sort(key=lambda r: r.block)
        behind: list[bytes] = []
        closed = False
        for k in range(len(own) - 1, -1, -1):
            r = own[k]
            if r.quote or k == 0:
                out[(file, r.block)] = (len(r.head) + 1 if k else 0, b"".join(reversed(behind)), closed, k == 0)
                behind, closed = [], True
            behind.append(bytes(r.head))
    return out


def _between_quotes(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The texts between quotes, as Spark's text source gives them of a plain file: (file, block, value)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, drop, size = None, 0, 0
        since: list[bytes] = []                             # text behind the last quote
        out: list[tuple[str, int, str]] = []

        def ended() -> list[tuple[str, int, str]]:
            if at not in shared.value:
                return []
            _, tail, closed, _ = shared.value[at]
            last = b"".join(since) + tail
            return [(*at, last.decode())] if closed or last else []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))],
                                              names=["file", "block", "value"])

        for split, body in _bodies(batches):
            if body is None:
                raise ValueError(f"{split[0]}: a gzip member is broken")
            if split != at:
                out += ended()
                at, since = split, []
                drop = shared.value[split][0] if split in shared.value else 0
                begins = split in shared.value and shared.value[split][3]
            if split not in shared.value:
                continue
            text = text_of(body)
            if begins and text:
                text, begins = text.removeprefix(b"\xef\xbb\xbf"), False
            if drop:
                text, drop = text[drop:], max(0, drop - len(text))
            head, *rest = text.split(b'"')
            since.append(head)
            if rest:
                values = [b"".join(since), *rest[:-1]]
                since = [rest[-1]]
                out += [(*split, v.decode()) for v in values]
                size += len(text)
            if size >= _SEGMENTS_BYTES:
                yield batch()
                out, size = [], 0
        out += ended()
        if out:
            yield batch()
    return run


def in_splits(spark: SparkSession, path: str) -> DataFrame | None:
    """(file, block, value): the texts between quotes of the ``.gz`` files at ``path``, or None where they are not files of such members.

    One scan checks the members' lengths and finds the text before the first quote of every split, which the driver hands to the split before.
    """
    if not path.rstrip("/").endswith(".gz") or not _in_members(spark, path):
        return None
    raw = spark.read.options(**_SEPARATOR, **_raw(spark)).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    heads = raw.mapInArrow(_heads, "file string, block long, head binary, quote boolean, good boolean").collect()
    if not all(r.good for r in heads):
        return None
    shared = spark.sparkContext.broadcast(_borders(heads))
    return raw.mapInArrow(_between_quotes(shared), "file string, block long, value string")
