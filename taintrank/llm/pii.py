"""Personal data: base patterns plus candidates chosen by gradient-boosted trees (operator 4).

Base spans (email, ip, card, phone) follow fixed patterns and always stay. High-recall
generators then propose overlapping spans: anything around an ``@`` or a spelled-out "at ... dot", dotted
numbers, all windows of digit groups inside runs with separators (read as card and as phone) and long mixed tokens (secrets).
A candidate may contain base spans of its kind (then it adds the wider span beside them), but not cut into one.
Every candidate gets format features (lengths, character shares, entropy, separators, check digit, issuer prefix, date form, neighbouring digits) and context
features (neighbouring characters, quotes, assignment signs, cue words), and one of evidence: a form of its own kind (spelled-out address with a
plausible host, issuer prefix and check digit of 13 to 19 digits, area code notation, a public token prefix) or a cue (a phone word before a number, a leading
plus, an assignment to a cue word), else unknown.

Boosted trees alone decide what is added. They learn from at most ``SAMPLE`` candidates, drawn by hash over all texts, and from those of ``PRACTICE`` made-up
lines (:func:`practice`), so that rare notations and hard negatives are known on every corpus. Labels are weak: 1 for base spans
and for evidence, else 0 (dates, versions, table cells, failing check digits, parts of numbers). Each sampled 1 is learned from twice, once with its evidence
hidden, so that the trees know the form of personal data that nothing announces. Half of the sample fits the trees, the other half
calibrates them (Platt) and sets each kind's threshold: the smallest probability, ``LEAST`` or more, above which
at least ``PRECISION`` of the labels are 1, hidden copies included; a kind of fewer than ``FEW`` calibration rows takes the threshold of all kinds together. Where chosen
candidates overlap each other, those with evidence come first, forms before cues and the longest first, then the likeliest.

Contract for odd rows: null text is empty; empty texts have no spans and the digest of the empty string;
texts of any length are read whole (all patterns are linear); a corpus without candidates is judged by what the practice lines taught;
ties in probability go to the earlier, then longer span; repeated rows give equal results; extra columns are
ignored by :func:`find` and kept by :func:`redact`; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain as _chain
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taintrank.llm import _text

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
SAMPLE = 20_000              # bound of the training sample
LEAST, PRECISION = 0.9, 0.98
PRACTICE = 6000              # made-up lines
FEW = 50                     # calibration rows below which a kind takes the pooled threshold
HIDDEN = -1.0                # evidence that is absent or hidden
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
CHUNK = 4096                 # candidates of one text whose features are held at once
CUES = {
    "email": ("mail", "e-mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "credit", "iban", "account"), "phone": ("tel", "phone", "call", "fax", "mobile"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match starts at the start of a digit run: from any later digit it would fail or have begun before
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOTTED = re.compile(r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3,}")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,3}[0-9])+")
_GROUP = re.compile(r"[0-9]+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_MAY_SPELL = re.compile(rb"[\[({]\x20?(?:at|dot)\x20?[\])}]|\x20dot\x20", re.I)
_AT = re.compile(r"\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20|@", re.I)
_SPELLED_DOT = r"(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20)"
_HAS_DOT = re.compile(_SPELLED_DOT, re.I)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_SPELLED_DOT})[A-Za-z0-9-]+)+", re.I)
_MAILBOX = re.compile(r"[\w.%+'-]+@(?:[\w-]+\.)+[^\W\d_]{2,24}")
_WORDY_TLD = frozenset("com org net edu gov info io dev".split())
_AREA = re.compile(r"(?:\+?1[\x20.-]?)?(?:\([2-9][0-9]{2}\)[\x20.-]?|[2-9][0-9]{2}[.-])[0-9]{3}[\x20.-][0-9]{4}")
_DATE = re.compile(r"[0-9]{1,2}([.-])[0-9]{1,2}\1[0-9]{4}|[0-9]{4}([.-])[0-9]{1,2}\2[0-9]{1,2}")
_PHONE_WORD = re.compile(r"(?<![^\W\d_])(?:tel|telephone|telefon|phone|mobile|cell|fax|call|dial|hotline|whatsapp)(?![^\W\d_])[^0-9\n]{1,20}\Z", re.I)
_ISSUER = re.compile(r"4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)[0-9]{12}|3[47][0-9]{13}"
                     r"|3(?:0[0-5]|[689][0-9])[0-9]{11}|35[0-9]{14}|(?:5[06-8]|6[0-9])[0-9]{11,17}")
_CARD_GROUPS = re.compile(r"[0-9]{13,19}|[0-9]{4}([\x20-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{6}\1[0-9]{4,5})")
# fixed values: public prefixes of access tokens
_PREFIXED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}")
_WORDY = re.compile(r"[\w.'-]+")
_TIED_LEFT, _TIED_RIGHT = re.compile(r"(?:[0-9][.-]{1,3}|\w)\Z"), re.compile(r"[.-]{1,3}[0-9]|\w")
_MORE_LEFT, _MORE_RIGHT = re.compile(r"[0-9][\x20().-]{0,3}\Z"), re.compile(r"[\x20().-]{0,3}[0-9]")
_NUMERIC = np.zeros(256, bool)
_NUMERIC[48:58] = True
_NUMERIC[[64]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the email pattern, found from each ``@`` so that long runs stay linear."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > free and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1) if lo == at else free
        at = text.find("@", max(at + 1, free))
        free = max(free, 0)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of every kind."""
    out = {"email": base_emails(text) if "@" in text else []}
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that may be personal data; they may overlap."""
    at = text.find("@")
    while at >= 0:
        lo, hi = at, at + 1
        while lo > 0 and not text[lo - 1].isspace() and text[lo - 1] not in "@<>\"'(),;":
            lo -= 1
        while hi < len(text) and not text[hi].isspace() and text[hi] not in "@<>\"'(),;":
            hi += 1
        while hi > at + 1 and text[hi - 1] in ".!?:*#$%&":
            hi -= 1
        if lo < at and hi > at + 1:
            yield "email", lo, hi
        at = text.find("@", at + 1)
    if _MAY_SPELL.search(text.encode("utf-8", "replace")):
        yield from spelled(text)
    for m in _DOTTED.finditer(text):
        yield "ip", m.start(), m.end()
    for m in _NUMBER.finditer(text):
        yield from _windows(text, m.start(), m.end())
    for m in _TOKEN.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            yield "secret", m.start(), m.end()


def _windows(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """All windows of consecutive digit groups of a run with 7 to 19 digits: at most 19 from each group, so linear."""
    open_windows: list[tuple[int, int]] = []              # (start, digits) of windows that end before the group
    for g in _GROUP.finditer(text, start, end):
        size = g.end() - g.start()
        open_windows = [(lo, n + size) for lo, n in open_windows if n + size <= 19]
        if size <= 19:
            open_windows.append((g.start(), size))
        for first, n in open_windows:
            if n >= 13:
                yield "card", first, g.end()
            if 7 <= n <= 15:
                lo = first
                while lo > 0 and first - lo < 3 and text[lo - 1] in "+(":
                    lo -= 1
                while text[lo] == "(" and text.find(")", first, g.end()) < 0:
                    lo += 1
                yield "phone", lo, g.end()


def spelled(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses whose at or dot is spelled out. Neither side reaches over another at, so the scan is linear."""
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if host and (any(c in "[({" for c in m[0]) or _HAS_DOT.search(host[0])):
            lo = m.start()
            while lo > 0 and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < m.start():
                yield "email", lo, host.end()


def cue(text: str, kind: str, lo: int) -> int:
    near = text[max(0, lo - 24):lo].lower()
    return int(any(re.search(rf"(?<![a-z]){re.escape(w)}", near) for w in CUES[kind]))


def features(text: str, kind: str, lo: int, hi: int, known: float = HIDDEN) -> list[float]:
    """Format and context of a candidate; ``known`` is its evidence, if any is to be seen."""
    s = text[lo:hi]
    n = len(s)
    digits = _digits(s)
    letters = sum(c.isalpha() for c in s)
    upper = sum(c.isupper() for c in s)
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    seen = Counter(s).values()
    entropy = -sum(k / n * math.log2(k / n) for k in seen)
    before, after = text[lo - 1:lo], text[hi:hi + 1]
    left, right = text[max(0, lo - 20):lo], text[hi:hi + 20]
    around = left + right
    groups = _GROUP.findall(s)
    tail = s.rpartition("@")[2]
    host = s.rpartition(".")[2]
    number = kind in ("card", "phone")
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, letters / n, upper / n, hexes / n,
        entropy, len(seen) / n, s.count("."), s.count("-"), s.count(" "), s.count("("), float(s[:1] == "+" and kind != "phone"), float("@" in s),
        float("." in tail[1:-1]), len(host), float(host.isalpha()), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        max((int(g[-6:]) for g in groups), default=0), float(luhn(digits)) if digits else 0.0,
        float(before.isspace() or not before), float(after.isspace() or not after), float(before in "\"'"), float(after in "\"'"),
        float(left.rstrip(" \"'")[-1:] in ("=", ":")), float(before.isalnum()), float(after.isalnum()),
        sum(c.isdigit() for c in around) / 40, float("|" in around), cue(text, kind, lo) if kind != "phone" else 0,
        float(number and bool(_TIED_LEFT.search(left[-4:]) or _TIED_RIGHT.match(right))), float(number and bool(_MORE_LEFT.search(left[-4:]))),
        float(number and bool(_MORE_RIGHT.match(right))), float(number and bool(_DATE.fullmatch(s))), float(kind == "card" and bool(_ISSUER.fullmatch(digits))),
        float(groups[0][:1] == "0") if groups else 0.0, known]


N_FEATURES = len(features("a", "email", 0, 1))


def _email_evidence(s: str) -> int:
    at = _AT.search(s)
    host = _HOST.fullmatch(s, at.end()) if at else None
    dots = _HAS_DOT.findall(host[0]) if host else []
    if not host or at[0] == "@" and not dots:
        return 2 * bool(_MAILBOX.fullmatch(s))
    last = _HAS_DOT.sub(".", host[0]).rpartition(".")[2]
    if not last.isalpha() or not 2 <= len(last) <= 24:
        return 0
    if at[0].lower() != " at " or any(d.lower() != " dot " for d in dots):
        return 2
    return int(last.lower() in _WORDY_TLD)


def evidence(text: str, kind: str, lo: int, hi: int) -> int:
    """2 if the span has a form of its own kind, 1 if a cue says so, else 0; independent of the base spans."""
    s = text[lo:hi]
    if kind == "secret":
        signed = text[max(0, lo - 3):lo].rstrip(" \"'")[-1:] in ("=", ":")
        return 2 * bool(_PREFIXED.fullmatch(s)) or int(signed and cue(text, kind, lo))
    if kind == "email":
        return _email_evidence(s)
    if kind == "ip":
        return 2 * (s.count(".") == 3 and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in s.split(".")))
    left, right = text[max(0, lo - 4):lo], text[hi:hi + 4]
    if kind == "card":
        digits = _digits(s)
        if left[-1:].isalnum() or right[:1].isalnum() or not luhn(digits) or not (_ISSUER.fullmatch(digits) or cue(text, kind, lo)):
            return 0
        return 2 * bool(_CARD_GROUPS.fullmatch(s) or not (_MORE_LEFT.search(left) or _MORE_RIGHT.match(right)))
    if _TIED_LEFT.search(left) or _TIED_RIGHT.match(right) or _DATE.fullmatch(s):
        return 0
    if _AREA.fullmatch(s):
        return 2
    return int(s.lstrip("(")[:1] == "+" and len(_digits(s)) >= 8 or bool(_PHONE_WORD.search(text[max(0, lo - 32):lo])))


def shown(level: int) -> float:
    """Evidence as the trees see it."""
    return float(level) if level else HIDDEN


# ------------------------------------------------------------------ boosted trees

@dataclass
class Trees:
    edges: list[np.ndarray]
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: dict[str, float] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        rows = np.arange(len(b))
        out = np.full(len(b), self.start)
        for f, c, v in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(b), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            out += v[node - (2 ** DEPTH - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.margin(x) + b, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Histogram gradient boosting with logistic loss."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(edges, start=float(np.log(rate / (1 - rate))))
    b = model.bins(x)
    flat = np.arange(width) * BINS
    margin = np.full(n, model.start)
    inner, leaves = 2 ** DEPTH - 1, 2 ** DEPTH
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p) + 1e-6
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first = 2 ** level - 1
            slot = ((node - first)[:, None] * width * BINS + flat + b).ravel()
            size = 2 ** level * width * BINS
            sums = [np.bincount(slot, np.repeat(v, width), size).reshape(2 ** level, width, BINS).cumsum(axis=2) for v in (g, h)]
            all_g, all_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            gain = sums[0] ** 2 / (sums[1] + 1) + (all_g - sums[0]) ** 2 / (all_h - sums[1] + 1) - all_g ** 2 / (all_h + 1)
            gain[:, :, -1] = 0
            best = gain.reshape(2 ** level, -1).argmax(axis=1)
            feature[first:2 * first + 1], cut[first:2 * first + 1] = best // BINS, best % BINS
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        margin += value[leaf]
        model.feature.append(feature)
        model.cut.append(cut)
        model.value.append(value)
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    m = model.margin(x)
    a, b = 1.0, 0.0
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):                                   # Newton steps of the two-parameter logistic fit
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([((target - p) * m).sum() - (a - 1), (target - p).sum() - b])       # a ridge keeps separable labels finite
        hess = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.platt = (float(max(a, 1e-3)), float(b))
    p = model.probability(x)
    pooled = _threshold(p, y)
    for k, kind in enumerate(KINDS):
        own = x[:, k] == 1
        model.threshold[kind] = _threshold(p[own], y[own]) if own.sum() >= FEW else pooled
    return model


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The smallest probability from LEAST on above which PRECISION of the labels are 1; above 1 if there is none."""
    order = np.lexsort((y, -p))                          # of equal probability, the zeros first
    high = p[order]
    hit = y[order].cumsum() / np.arange(1, len(p) + 1)
    good = np.flatnonzero((hit >= PRECISION) & (high >= LEAST))
    if not len(good):
        return 2.0
    # half-way to the next row, or LEAST where all above it are precise
    below = float(high[good[-1] + 1]) if good[-1] + 1 < len(high) else 0.0
    return max(LEAST, (float(high[good[-1]]) + below) / 2 if below >= LEAST else LEAST)


# ------------------------------------------------------------------ Spark

def _lettered(block: _text.Block) -> np.ndarray:
    """Texts of a block with a digit, an ``@`` or a spelled-out dot; no span stands in the others."""
    total = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_NUMERIC[block.data], out=total[1:])
    return np.flatnonzero(total[block.offsets[1:]] > total[block.offsets[:-1]])


def _may_spell(text: bytes) -> bool:
    return bool(_MAY_SPELL.search(text))


def _picked(block: _text.Block) -> list[int]:
    rest = set(_lettered(block).tolist())
    whole = block.data.tobytes()
    if _may_spell(whole):
        o = block.offsets.tolist()
        rest |= {i for i in range(block.hi - block.lo) if _may_spell(whole[o[i]:o[i + 1]])}
    return sorted(rest)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for block in _text.blocks(batch.column(1)):
            key, x, y = [], [], []
            for i in _picked(block):
                text = block.text(i)
                for (kind, lo, hi), row, label in labelled(text):
                    own = hashlib.blake2b(f"{ids[block.lo + i].as_py()}:{kind}:{lo}:{hi}".encode(), digest_size=8).digest()
                    key.append(int.from_bytes(own, "little", signed=True))
                    x.append(row)
                    y.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())],
                                             names=["key", "x", "y"])


def practice(lines: int = PRACTICE, seed: int = 11) -> Iterator[str]:
    """Short texts with personal data in many notations, announced or not, and with what only looks like it."""
    rng = random.Random(seed)
    pick, letters = rng.choice, "abcdefghijklmnopqrstuvwxyz"
    num = lambda n: "".join(pick("0123456789") for _ in range(n))
    word = lambda: "".join(pick(letters) for _ in range(rng.randint(2, 9)))
    area = lambda: pick("23456789") + num(2)

    def checked(prefix: str, n: int) -> str:
        body = prefix + num(n - 1 - len(prefix))
        return next(body + d for d in "0123456789" if luhn(body + d))

    def phone() -> str:
        return pick([f"({area()}) {num(3)}-{num(4)}", f"{area()}-{num(3)}-{num(4)}", f"0{num(2)} {num(7)}", f"0{num(3)} {num(6)}", f"0{num(3)}/{num(6)}",
                     f"+{num(2)} {num(3)} {num(6)}", f"0{num(2)}-{num(8)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{area()}.{num(3)}.{num(4)}"])

    def card() -> str:
        c = pick([checked("4", 16), checked("51", 16), checked("55", 16), checked("37", 15), checked("6011", 16), "4" + num(15), num(16), "37" + num(13)])
        if len(c) == 15:
            return pick([c, f"{c[:4]} {c[4:10]} {c[10:]}"])
        return pick([c, *(s.join(c[i:i + 4] for i in range(0, 16, 4)) for s in " -")])

    def email() -> str:
        who, host, end = pick([word(), f"{word()}.{word()}", word() + "é" + word(), f"ü{word()}"]), pick([word(), f"{word()}.{word()}", word() + "ä"]), pick(["com", "org", "de", "io"])
        plain = host.replace("ä", "")
        return pick([f"{who}@{host}.{end}", f"{who} [at] {plain} [dot] {end}", f"{who}(at){plain}.{end}", f"{who} at {plain} dot {pick(['com', 'org', 'net'])}", f"{who}@{plain}[dot]{end}"])

    def token() -> str:
        return pick(["".join(pick("0123456789abcdef") for _ in range(pick([32, 40, 64]))), "".join(pick(letters + letters.upper() + "0123456789") for _ in range(rng.randint(16, 48)))])

    def other() -> str:
        d, m, y = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1950, 2040)
        return pick([f"{d:02d}.{m:02d}.{y}", f"{y}-{m:02d}-{d:02d}", f"{d}-{m}-{y}", f"{y}-{m:02d}-{d:02d} {num(2)}.{num(2)}", " ".join(num(rng.randint(1, 3)) for _ in range(rng.randint(4, 14))),
                     f"{num(1)}.{num(1)}.{num(2)}.{num(4)}", f"{num(1)}.{num(2)}.{num(1)}.{num(1)}.{num(1)}", num(rng.randint(7, 19)), f"{num(3)}.{num(2)} {num(4)}.{num(2)} {num(2)}.{num(2)}",
                     f"{word()}@{word()}", f"look at the dot in {word()}", f"{word()} at {word()} dot {word()} {word()}", token(), f"{word()}_{word()}_{word()}_{num(2)}", f"a{num(16)}",
                     f"{num(2)}|{num(3)}|{num(4)}", f"{num(1)},{num(3)},{num(3)}", f"({num(4)}) {num(3)}-{num(3)}", f"{num(4)}-{num(4)}"])

    said = {"phone": ["Tel:", "call", "phone", "fax:", "mobile", "hotline", "dial"], "card": ["card", "visa", "credit card:"], "email": ["mail", "contact", "write to"],
            "secret": ["token =", 'key = "', "password:", "api_key=", 'secret: "'], "ip": ["host", "server"]}
    make = {"phone": phone, "card": card, "email": email, "secret": token, "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))}
    for _ in range(lines):
        if rng.random() < 0.45:
            middle = other()
            lead = pick([word(), "", f"{word()} {word()}", pick(pick(list(said.values())))])
        else:
            kind = pick(list(make))
            middle = make[kind]()
            if kind in ("phone", "card") and rng.random() < 0.3:         # inside a longer run of numbers
                run = lambda: pick([" ".join(num(1) for _ in range(rng.randint(2, 12))), other(), make[kind]()])
                middle = pick([f"{run()} {middle}", f"{middle} {run()}", f"{run()} {middle} {run()}"])
            lead = pick(said[kind]) if rng.random() < 0.7 else pick([word(), ""])
        tail = pick(["", ".", f" {word()}", f", {word()}", " " + other(), '"' if lead.endswith('"') else ""])
        yield f"{lead}{'' if lead.endswith(('=', chr(34))) or not lead else ' '}{middle}{tail}"


def labelled(text: str) -> Iterator[tuple[tuple[str, int, int], list[float], int]]:
    """Candidates and base spans of a text with their features and weak labels."""
    base = base_spans(text)
    known = {(k, lo, hi) for k in BASE_KINDS for lo, hi in base[k]}
    for c in _chain(free_candidates(text, base), sorted(known)):
        level = evidence(text, *c)
        yield c, features(text, *c, shown(level)), int(level > 0 or c in known)


def with_hidden(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and every 1 whose evidence shows once more with it hidden."""
    again = x[(y == 1) & (x[:, -1] != HIDDEN)].copy()
    again[:, -1] = HIDDEN
    return np.concatenate([x, again]), np.concatenate([y, np.ones(len(again))])


def train(docs: DataFrame) -> Trees:
    """The trees for a corpus."""
    rows = (docs.select("doc_id", "text").mapInArrow(_sample, "key long, x array<double>, y int")
            .orderBy("key", "x", "y").limit(SAMPLE).toArrow())
    made = [(row, label) for text in practice() for _, row, label in labelled(text)]
    x = np.array(rows.column("x").to_pylist() + [row for row, _ in made], float)
    y = np.array(rows.column("y").to_pylist() + [label for _, label in made], float)
    return calibrate(fit_trees(*with_hidden(x[::2], y[::2])), *with_hidden(x[1::2], y[1::2]))


def free_candidates(text: str, base: dict[str, list[tuple[int, int]]] | None = None) -> Iterator[tuple[str, int, int]]:
    """Candidates that cut into no base span, made and tested ``CHUNK`` at a time."""
    taken = None
    base = base or base_spans(text)
    rest = candidates(text)
    while found := list(islice(rest, CHUNK)):
        if taken is None:
            taken = sorted(s for spans in base.values() for s in spans)
        if not taken:
            yield from found
            continue
        outside = _outside(found, taken)
        yield from outside
        yield from (c for c in found if c[0] in BASE_KINDS and base[c[0]] and _wider(text, c, base[c[0]], taken))


def _wider(text: str, c: tuple[str, int, int], own: list[tuple[int, int]], taken: list[tuple[int, int]]) -> bool:
    """Whether a candidate extends one base span of its kind by more of the same word, and meets no other."""
    kind, lo, hi = c
    at = bisect.bisect_right(own, (lo, math.inf)) - 1
    inside = next((s for s in own[max(at, 0):at + 2] if lo <= s[0] and s[1] <= hi and s != (lo, hi)), None)
    if inside is None or not all(_WORDY.fullmatch(x) for x in (text[lo:inside[0]], text[inside[1]:hi]) if x):
        return False
    first = bisect.bisect_left(taken, inside)
    near = taken[max(0, first - 4):first] + taken[first + 1:first + 5]
    return all(b <= lo or a >= hi for a, b in near)


def added_spans(text: str, base: dict[str, list[tuple[int, int]]], model: Trees | None) -> list[tuple[str, int, int]]:
    """What the trees choose; none without trees. Chosen spans do not overlap each other."""
    if model is None:
        return []
    order: list[tuple] = []                               # (evidence, length or probability, span)
    rest = free_candidates(text, base)
    while found := list(islice(rest, CHUNK)):
        known = [evidence(text, *c) for c in found]
        p = model.probability(np.array([features(text, *c, shown(e)) for c, e in zip(found, known)])).tolist()
        order += [(-e, c[1] - c[2] if e else 0, -q, c[1], -c[2], c[0]) for c, e, q in zip(found, known, p) if q >= model.threshold[c[0]]]
    order.sort()
    out: list[tuple[str, int, int]] = []
    used: list[tuple[int, int]] = []
    for *_, lo, end, kind in order:
        hi = -end
        at = bisect.bisect_left(used, (hi,))              # spans in ``used`` never overlap: only the one before can reach in
        if not at or used[at - 1][1] <= lo:
            bisect.insort(used, (lo, hi))
            out.append((kind, lo, hi))
    return out


def _outside(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap none of many spans: the running end of sorted spans decides."""
    start = np.array([a for a, _ in taken])
    end = np.maximum.accumulate(np.array([b for _, b in taken]))
    at = np.searchsorted(start, [hi for _, _, hi in found]) - 1
    return [c for c, k in zip(found, at.tolist()) if k < 0 or end[k] <= c[1]]


def spans_of(text: str, model: Trees | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    spans = [(k, a, b) for k in BASE_KINDS for a, b in base[k]] + added_spans(text, base, model)
    return base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = len(batch)
            count = {k: np.zeros(n, np.int64) for k in BASE_KINDS}
            base_text, all_text = [""] * n, [""] * n
            for block in _text.blocks(batch.column(1)):
                for i in _picked(block):
                    at = block.lo + i
                    base, spans = spans_of(block.text(i), model)
                    for k in BASE_KINDS:
                        count[k][at] = len(base[k])
                    base_text[at] = written([(k, a, b) for k in BASE_KINDS for a, b in base[k]])
                    all_text[at] = written(spans)
            yield _text.replace_columns(batch, ["doc_id"], {f"n_{k}": pa.array(count[k]) for k in BASE_KINDS}
                                        | {"base_spans": pa.array(base_text, pa.string()), "spans": pa.array(all_text, pa.string())})
    return run


def find(docs: DataFrame, model: Trees | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans for every row of ``docs``."""
    picked = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return picked.mapInArrow(_find(shared), f"doc_id {picked.dtypes[0][1]}, {counts}, base_spans string, spans string")


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    out, at = [], 0
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def _redact(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            change: dict[int, str] = {}
            for block in _text.blocks(batch.column(at)):
                for i in _picked(block):
                    text = block.text(i)
                    _, spans = spans_of(text, model)
                    if spans:
                        change[block.lo + i] = redacted(text, spans)
            if change:
                rows = batch.column(at).to_pylist()
                for k, v in change.items():
                    rows[k] = v
                batch = batch.set_column(at, batch.schema.field(at), pa.array(rows, batch.schema.field(at).type))
            yield batch
    return run


def redact(docs: DataFrame, model: Trees | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced; all other columns as they are."""
    return docs.mapInArrow(_redact(docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
