"""Chat formatting by event-sourced reconstruction (operator 9).

A conversation is a log of events, ordered by ``seq``: ``message`` opens a message with a role and a text,
``delta`` appends text to one (streaming), ``edit`` replaces its text, ``delete`` and ``regenerate`` drop it (a
regeneration is followed by the events of a new message). Logs are dealt out by conversation, then sorted
twice inside the partition (Spark spills such sorts): by message and sequence, where one pass folds each message's events, and by
the opening event, where one pass renders the turns. A task holds one message at a time, never a conversation.

A conversation of more than ``HOT`` events is split: its events are dealt out by message and folded there, its final messages are
put into range partitions over the turn order and rendered there, and turn numbers go on from one partition to the
next by a table of one row per conversation and partition. Both ways give the same turns.

The template is ``<|im_start|>role`` LF ``text<|im_end|>`` LF for each turn. In roles and texts a backslash
becomes two, and ``\\.`` goes behind the first character of every control string, so no control string is left
in a text and the escape can be undone. The loss mask covers the (escaped) texts of assistant turns.

Contract for odd rows: null text and null role are empty strings; a null conversation id is a
conversation of its own; events of equal order are taken openings first, then by role and text; repeated rows are repeated turns; an
event that names no open message, or has an unknown kind, changes nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taintrank.session import Scratch

HOT = 1 << 16                # events of a conversation that one task takes
PIECE = 256                  # code points of a streamed delta

# fixed values: control strings of public chat templates
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|startoftext|>")
OPEN, CLOSE = CONTROL[0], CONTROL[1]

_SPECIAL = re.compile("|".join(re.escape(c) for c in (*CONTROL, "\\")))
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\." + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the start and end of its loss mask (equal if none)."""
    head = f"{OPEN}{escape(role)}".replace("\n", "\\n") + "\n"
    body = escape(text)
    lo = len(head)
    hi = lo + len(body) if role == "assistant" else lo
    return f"{head}{body}{CLOSE}\n", lo, hi


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, read back from formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


class Fold:
    """The events of one message id, in order; yields each message it opens once that is final."""

    def __init__(self):
        self.at: tuple | None = None          # where the open message stands
        self.role, self.parts = "", []

    def add(self, kind: str, at: tuple, role: str, text: str) -> Iterator[tuple]:
        if kind == "message":
            yield from self.close()
            self.at, self.role, self.parts = at, role, [text]
        elif self.at is None:
            return
        elif kind == "delta":
            self.parts.append(text)
        elif kind == "edit":
            self.parts = [text]
        elif kind in ("delete", "regenerate"):
            self.at = None

    def close(self) -> Iterator[tuple]:
        if self.at is not None:
            yield (*self.at, self.role, "".join(self.parts))
        self.at = None


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by conversation, message and sequence."""
    key, fold, conv, schema = None, Fold(), None, None
    for batch in batches:
        schema = schema or pa.schema([("conv_id", pa.int64()), ("seq", batch.schema.field("seq").type), ("message", pa.string()),
                                      ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []
        for c, seq, kind, message, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "seq", "kind", "message", "role", "text"))):
            if key != (c, message):
                out += [(key[0], *m) for m in fold.close()] if key else []
                key = (c, message)
            out += [(c, *m) for m in fold.add(kind, (seq, message), role, text)]
        yield _batch(out, schema)
    if key:
        yield _batch([(key[0], *m) for m in fold.close()], schema)


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by conversation and order of opening."""
    conv, number = object(), 0
    for batch in batches:
        out = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            conv, number = (c, number + 1) if c == conv else (c, 0)
            out.append((c, number, *render(role, text)))
        yield _batch(out, _TURNS)


_ORDER = ("conv_id", "seq", "role", "text", "message")
_TURN_COLUMNS = "conv_id long, turn_no long, formatted string, loss_from long, loss_to long"


def _folded(log: DataFrame, *keys: str) -> DataFrame:
    """Final messages; all events of a message are in one partition, which ``keys`` choose."""
    log = log.repartition(*keys).sortWithinPartitions("conv_id", "message", "seq", F.col("kind") != "message", "role", "text", "kind")
    return log.mapInArrow(_fold, f"conv_id long, seq {dict(log.dtypes)['seq']}, message string, role string, text string")


def _whole(log: DataFrame) -> DataFrame:
    """The turns of conversations that lie in one partition each, in order inside it."""
    return _folded(log, "conv_id").sortWithinPartitions(*_ORDER).mapInArrow(_render, _TURN_COLUMNS)


def _split(log: DataFrame, tmp: Scratch) -> DataFrame:
    """The turns of conversations that are spread over range partitions."""
    # the start of a text orders as the text does, so the bounds follow the turn order and stay short
    final = _folded(log, "conv_id", "message").repartitionByRange("conv_id", "seq", "role", F.substring("text", 1, 64))
    rows = final.sortWithinPartitions(*_ORDER).mapInArrow(_render, _TURN_COLUMNS).withColumn("part", F.spark_partition_id())
    rows = tmp.table(rows, "turns")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # a row per conversation and partition that it reaches; broadcast by Spark if the written table is small
    rows = rows.join(tmp.table(first, "first"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    return rows.select("conv_id", (F.col("turn_no") + F.col("first")).alias("turn_no"), "formatted", "loss_from", "loss_to")


def _turns(events: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The turns of conversations up to ``HOT`` events, and of the others if there are any."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", text("kind"), text("message"), text("role"), text("text"))
    tmp = Scratch(events.sparkSession, "chat")
    hot = tmp.table(log.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select(F.col("conv_id").alias("h")), "hot")
    if hot.isEmpty():
        return _whole(log), None
    is_hot = F.col("conv_id").eqNullSafe(F.col("h"))
    return _whole(log.join(hot, is_hot, "left_anti")), _split(log.join(hot, is_hot, "left_semi"), tmp)


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn_no, formatted, loss_from, loss_to: the formatted turns of ``events`` (conv_id, seq, kind, message, role, text).

    A conversation's text is the concatenation of its turns by ``turn_no``.
    """
    whole, split = _turns(events)
    return whole if split is None else whole.unionByName(split)


def messages(conversations: DataFrame) -> DataFrame:
    """Events of finished turns (conv_id, turn, role, text): one ``message`` each."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"),
                                F.col("turn").cast("string").alias("message"), "role", "text")


def streamed(conversations: DataFrame) -> DataFrame:
    """Events of a chat log (conv_id, turn, role, text): assistant turns open empty and arrive in deltas, others at once.

    Every row is a message of its own, so ``conversations`` has to be read from files (a row keeps its number when a task is repeated).
    """
    said = F.coalesce("text", F.lit(""))
    parts = F.when(F.col("role") == "assistant", F.concat(F.array(F.lit("")), F.regexp_extract_all(said, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
                   ).otherwise(F.array(said))
    # numbered before the texts are cut: all events of a row name one message
    rows = conversations.select("conv_id", "turn", "role", F.monotonically_increasing_id().cast("string").alias("message"), parts.alias("parts"))
    rows = rows.select("conv_id", "turn", "role", "message", F.posexplode("parts").alias("part", "text"))
    return rows.select("conv_id", F.struct("turn", "part").alias("seq"), F.when(F.col("part") == 0, "message").otherwise("delta").alias("kind"),
                       "message", "role", "text")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read the formatted turns back; running digests, so no conversation is held."""
    conv, started = None, False
    turns = loss = None
    n = loss_chars = chars = 0
    for batch in batches:
        out = []
        for c, text, lo, hi in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_from", "loss_to"))):
            if not started or c != conv:
                if started:
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                conv, started, n, loss_chars, chars = c, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, said in parse(text):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
            masked = unescape(text[lo:hi])
            loss.update(masked.encode())
            loss_chars += len(masked)
            chars += len(text)
        yield _batch(out, _DIGESTS)
    if started:
        yield _batch([(conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], _DIGESTS)


_DIGEST_COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation what its formatted turns say. The digest of one conversation is one running hash, so one task streams its turns."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no").mapInArrow(_digest, _DIGEST_COLUMNS)


def reconstructed_digests(events: DataFrame) -> DataFrame:
    """:func:`digests` of :func:`reconstruct`; turns that come out in order are not dealt again."""
    whole, split = _turns(events)
    out = whole.mapInArrow(_digest, _DIGEST_COLUMNS)
    return out if split is None else out.unionByName(digests(split))
