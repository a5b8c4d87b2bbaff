"""BPE encoding and decoding with content-defined chunk reuse (operator 7).

Every text is cut into content-defined chunks: a rolling hash of 16 bytes ends a chunk
wherever its low bits are zero, so equal passages give equal chunks in any text. Three scans:

1. Count chunk hashes. Hashes seen twice set bits in a filter of ``FILTER_BITS`` bits, the only thing broadcast:
   its size is fixed. A false hit costs a shuffle, never a result.
2. Texts with a shared chunk become pieces: shared chunks (by 128-bit hash; their
   text goes along once per task) and the stretches between. Each distinct shared chunk is encoded
   once, its ids are joined to all its places, and the pieces meet again per text in order.
   A join inside a word is repaired: the run of non-blank characters around it is encoded again and replaces the
   tokens on both sides. Blanks end every pre-token of the vocabulary and take no part in a token,
   so left and right of that run both encodings agree.
3. Texts without a shared chunk are encoded where they are.

Inside a task the ids of blank-separated words are kept in a bounded memo. The tokenizer must
drop white space between pre-tokens (checked by :class:`Codec`).

Contract for odd rows: null text is empty and has no ids; texts of any length are
encoded whole; rows that repeat an id each give a row; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _text
from taintrank.session import Scratch

_BITS = 10
AVERAGE = 1 << _BITS         # mean chunk length in bytes
LONGEST = 1 << 14
SHORTEST = 64                # shorter chunks are not worth a shuffle
FILTER_BITS = 1 << 26
MEMO_WORDS = 120_000
MEMO_LENGTH = 48

_RNG = np.random.Generator(np.random.PCG64(99))
_MARKS = string.punctuation
# byte-level vocabularies show every byte as one printable character: the others follow from 256 on, in order
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BYTE2 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Codec:
    """One tokenizer per Python worker, with a bounded memo of words."""

    _made: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.joined_by_blank = self.tokenizer.decoder is None
        one, two = (self._raw([x])[0] for x in ("ab cd\nef", "ab"))
        if one[:len(two)] != two or one != b"".join(self._raw(["ab", "cd", "ef"])):
            raise ValueError("chunk reuse needs a tokenizer that drops white space between words")
        self.memo: dict[bytes, bytes] = {}           # blank-separated word -> ids
        self.cores: dict[str, bytes] = {}            # lower-case letters, or marks behind them -> ids
        trial = ["ab", "theory", "zqxj", "inging", "!!", "?", "été", "ñandúß"]
        made = [self._piece(x) for x in trial]
        lowers = self._raw(["Ab", "THEORY"]) == made[:2] and self._raw(["ab!!"])[0] == made[0] + made[4]
        self.splits_marks = lowers and made == self._raw(trial)     # else every word goes to the tokenizer whole

    def forget(self) -> None:
        """Give the memo back at the end of a task: workers live on and run other stages."""
        self.memo.clear()
        self.cores.clear()

    def _raw(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32).tobytes() for x in got]

    def _core(self, core: str) -> bytes:
        """Ids of one pre-token of plain letters or marks."""
        got = self.cores.get(core)
        if got is None:
            got = self.cores[core] = self._piece(core)
        return got

    def _piece(self, core: str) -> bytes:
        shown = core if core.isascii() else core.encode().decode("latin-1").translate(_SHOWN)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()

    def _words(self, fresh: list[bytes]) -> None:
        """Fill the memo. Letters followed by marks are two pre-tokens whose case does not matter: most
        new words are known ones in another dress. All other words go to the tokenizer as they are."""
        if len(self.cores) > MEMO_WORDS:
            self.cores.clear()
        rest = []
        for w in fresh:
            text = w.decode("utf-8", "replace")
            core = text.rstrip(_MARKS)
            # below U+0130 letters are NFC-stable and lower-case one to one
            if self.splits_marks and core.isalpha() and max(core) < "\u0130" and len(text) <= MEMO_LENGTH:
                self.memo[w] = self._core(core.lower()) + (self._core(text[len(core):]) if len(core) < len(text) else b"")
            else:
                rest.append(w)
        self.memo.update(zip(rest, self._raw([w.decode("utf-8", "replace") for w in rest])))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of UTF-8 texts."""
        split = [x.split() for x in texts]
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        fresh = list(set().union(*split).difference(memo)) if split else []
        self._words(fresh)
        out = [b"".join([memo[w] for w in words]) for words in split]
        for w in fresh:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return out

    def decode(self, ids: bytes) -> str:
        """The text that ``tokenizers`` gives for these ids, special tokens kept."""
        numbers = np.frombuffer(ids, np.uint32).tolist()
        if self.joined_by_blank:
            return b" ".join([self.pieces[i] for i in numbers]).decode("utf-8")
        return self.tokenizer.decode(numbers, skip_special_tokens=False)


def chunk_ends(block: _text.Block) -> list[np.ndarray]:
    """For every text of the block, the byte ends (inside the block) of its chunks."""
    data, offsets = block.data, block.offsets
    n = len(data)
    h = _text._BYTE[data]
    step, power = 1, _text._MUL
    while step < 16 and n > step:
        h[step:] = h[step:] + h[:-step] * np.uint64(power)
        step, power = step * 2, power * power % 2**64
    cut = np.flatnonzero(h >> np.uint64(64 - _BITS) == 0) + 1      # the high bits depend on all 16 bytes
    start = np.append((data & 0xC0) != 0x80, True)
    for _ in range(3):                               # on to the next character
        cut = np.where(start[np.minimum(cut, n)], cut, cut + 1)
    cut = np.unique(np.minimum(cut, n))
    first, last = np.searchsorted(cut, offsets[:-1] + 16), np.searchsorted(cut, offsets[1:])
    out = []
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if a == b:
            out.append(np.zeros(0, np.int64))
            continue
        ends = [*cut[first[i]:last[i]].tolist(), b]
        if any(y - x > LONGEST for x, y in zip([a, *ends], ends)):
            spread, at = [], a
            for e in ends:
                while e - at > LONGEST:
                    at += LONGEST
                    while not start[at]:
                        at += 1
                    spread.append(at)
                if e > at:
                    spread.append(e)
                    at = e
            ends = spread
        out.append(np.array(ends, np.int64))
    return out


def _range_hash(block: _text.Block, table: np.ndarray):
    n = len(block.data)
    power, inverse = _text._powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[block.data] * power[:n], out=total[1:], dtype=np.uint64)
    return lambda a, b: _text.mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))


def _chunks(block: _text.Block):
    """(text index, start, end, hash 1) of all chunks of a block."""
    ends = chunk_ends(block)
    size = [len(e) for e in ends]
    owner = np.repeat(np.arange(len(ends)), size)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    start = np.zeros(len(end), np.int64)
    if len(end):
        start[1:] = end[:-1]
        at = np.cumsum([0, *size[:-1]])
        head = np.array([k for k, s in zip(at.tolist(), size) if s], np.int64)
        start[head] = block.offsets[:-1][np.array(size) > 0]
    return owner, start, end, _range_hash(block, _text._BYTE)(start, end)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in _text.blocks(batch.column(0)):
            _, start, end, h = _chunks(block)
            value, n = np.unique(h[end - start >= SHORTEST], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def _bit(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bits of the hashes of chunks that stand twice or more; FILTER_BITS bits whatever the input."""
    twice = docs.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 2")
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = (twice.select(F.shiftright(bit, 6).cast("int").alias("w"), bit.bitwiseAND(F.lit(63)).cast("int").alias("s"))
             .groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, s)")).alias("bits")).toArrow())
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint64)


def _hits(bits: np.ndarray, h: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = _bit(h)
    return (((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)) == 1) & (length >= SHORTEST)


def _edges(codec: Codec, texts: list[bytes]) -> list[tuple]:
    """(ids, head, head tokens, tail, tail tokens) of chunk texts; a text without blank has all in its head and no tail."""
    heads, tails = [], []
    for t in texts:
        words = t.split()
        blank = any(x in t for x in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
        heads.append(t if not blank else words[0] if words and t[:len(words[0])] == words[0] else b"")
        tails.append(None if not blank else words[-1] if words and t.endswith(words[-1]) else b"")
    ids = codec.encode(texts)
    head_ids = codec.encode(heads)
    tail_ids = codec.encode([x or b"" for x in tails])
    return [(a, b, len(c) // 4, d, len(e) // 4) for a, b, c, d, e in zip(ids, heads, head_ids, tails, tail_ids)]


_EDGE = "ids binary, head binary, n_head int, tail binary, n_tail int"
_EDGE_TYPES = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32()]
_EDGE_NAMES = ["ids", "head", "n_head", "tail", "n_tail"]


def _pieces(path: str, shared):
    """Pieces of the texts that hold a shared chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, bits = Codec.of(path), shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column(0)
            for block in _text.blocks(batch.column(1)):
                owner, start, end, h1 = _chunks(block)
                hit = _hits(bits, h1, end - start)
                if not hit.any():
                    continue
                mine = np.zeros(block.hi - block.lo, bool)
                mine[owner[hit]] = True
                # neighbouring chunks that are not shared make one piece
                glue = np.zeros(len(owner), bool)
                glue[1:] = ~hit[1:] & ~hit[:-1] & (owner[1:] == owner[:-1])
                use = mine[owner]
                first = np.flatnonzero(use & ~glue)
                last = np.append(first[1:], len(owner)) - 1
                # the last chunk of a piece: before the next piece, inside the same text
                stop = np.searchsorted(owner, owner[first], "right") - 1
                last = np.minimum(last, stop)
                a, b, who, is_shared = start[first], end[last], owner[first], hit[first]
                h2 = _range_hash(block, _BYTE2)(a, b)
                head = np.searchsorted(who, who)
                number = np.arange(len(first)) - head
                tag = _range_hash(block, _BYTE2)(block.offsets[who], block.offsets[who + 1])
                raw = [block.data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]
                key1, key2 = h1[first].view(np.int64), h2.view(np.int64)
                text: list[bytes | None] = [None] * len(first)
                own = np.flatnonzero(~is_shared).tolist()
                for k in np.flatnonzero(is_shared).tolist():
                    pair = (int(key1[k]), int(key2[k]))
                    if pair not in seen:
                        seen.add(pair)
                        text[k] = raw[k]
                if len(seen) > 1_000_000:
                    seen.clear()
                edges: list[tuple] = [(None,) * 5] * len(first)
                for k, e in zip(own, _edges(codec, [raw[k] for k in own])):
                    edges[k] = e
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(block.lo + who)), pa.array(tag.view(np.int64)), pa.array(number.astype(np.int32)),
                     pa.array(is_shared), pa.array(key1), pa.array(key2), pa.array(text, pa.binary())]
                    + [pa.array(c, t) for c, t in zip(zip(*edges), _EDGE_TYPES)],
                    names=["doc_id", "tag", "piece", "shared", "h1", "h2", "chunk", *_EDGE_NAMES])
        codec.forget()
    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        for batch in batches:
            edges = _edges(codec, batch.column(2).to_pylist())
            columns = list(zip(*edges)) if edges else [()] * 5
            yield _text.replace_columns(batch, ["h1", "h2"], {n: pa.array(c, t) for n, c, t in zip(_EDGE_NAMES, columns, _EDGE_TYPES)})
        codec.forget()
    return run


def join_pieces(codec: Codec, pieces: list[tuple]) -> bytes:
    """Ids of a text from its pieces in order; runs across a join are encoded again."""
    out: list[bytes] = []
    run, run_ids = b"", b""              # the open run of non-blanks and its ids, if known
    for ids, head, n_head, tail, n_tail in pieces:
        if tail is None:                 # no blank in the piece
            run, run_ids = (head, ids) if not run else (run + head, None)
            continue
        if not run:
            out.append(ids[:4 * n_head])
        elif not head:
            out.append(run_ids if run_ids is not None else codec.encode([run])[0])
        else:
            out.append(codec.encode([run + head])[0])
        out.append(ids[4 * n_head:len(ids) - 4 * n_tail])
        run, run_ids = tail, ids[len(ids) - 4 * n_tail:]
    out.append((run_ids if run_ids is not None else codec.encode([run])[0]) if run else b"")
    return b"".join(out)


def _rows(ids: pa.Array, got: list[bytes], codec: Codec) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(got, pa.binary()), pa.array([len(x) // 4 for x in got], pa.int64()),
         pa.array([codec.decode(x) for x in got], pa.string())], names=["doc_id", "ids", "n_tokens", "decoded"])


def _assemble(path: str):
    """Input is sorted by text and piece; one text at a time is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path)
        key, pieces, times, kind = None, {}, 0, None

        def done() -> pa.RecordBatch:
            got = join_pieces(codec, [pieces[k] for k in sorted(pieces)])
            return _rows(pa.array([key[0]] * times, kind), [got] * times, codec)

        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if key is not None:
                        yield done()
                    key, pieces, times = row[:2], {}, 0
                times += row[2] == 0
                pieces[row[2]] = row[3:]
        if key is not None:
            yield done()
        codec.forget()
    return run


def _direct(path: str, shared):
    """Texts without a shared chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, bits = Codec.of(path), shared.value
        for batch in batches:
            ids = batch.column(0)
            for block in _text.blocks(batch.column(1)):
                owner, start, end, h1 = _chunks(block)
                plain = np.ones(block.hi - block.lo, bool)
                plain[owner[_hits(bits, h1, end - start)]] = False
                at = np.flatnonzero(plain)
                texts = [block.data[block.offsets[i]:block.offsets[i + 1]].tobytes() for i in at.tolist()]
                yield _rows(ids.take(pa.array(block.lo + at)), codec.encode(texts), codec)
        codec.forget()
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit), n_tokens, decoded for every row of ``docs``."""
    tmp = Scratch(docs.sparkSession, "bpe")
    base = docs.select("doc_id", "text")
    kind = base.dtypes[0][1]
    shared = docs.sparkSession.sparkContext.broadcast(shared_filter(base))
    piece = tmp.table(base.mapInArrow(_pieces(path, shared), f"doc_id {kind}, tag long, piece int, shared boolean, h1 long, h2 long, "
                                      f"chunk binary, {_EDGE}"), "pieces")
    chunk = piece.where("shared and chunk is not null").groupBy("h1", "h2").agg(F.any_value("chunk").alias("chunk"))
    chunk = tmp.table(chunk.mapInArrow(_encode_chunks(path), f"h1 long, h2 long, {_EDGE}"), "chunks")
    key = ["doc_id", "tag", "piece"]
    places = piece.where("shared").select(*key, "h1", "h2").join(chunk, ["h1", "h2"]).select(*key, *_EDGE_NAMES)
    parts = piece.where("not shared").select(*key, *_EDGE_NAMES).unionByName(places)
    parts = parts.repartition("doc_id", "tag").sortWithinPartitions(*key)
    schema = f"doc_id {kind}, ids binary, n_tokens long, decoded string"
    return base.mapInArrow(_direct(path, shared), schema).unionByName(parts.mapInArrow(_assemble(path), schema))


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
