"""Native text expressions (no Python UDFs).

P6 query cleaning, P11 whitespace-token truncation, R11 duo text line and the
tokenizer shared by BM25 and its SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes must equal Python's ``[^\w\s]`` on
# Unicode text. Java's ``\w`` and ``\s`` are ASCII-only, so letters, digits
# and Python's extra whitespace (separators, \x1c-\x1f, \x85) are spelled out.
PY_SPACE = r" \t\n\x0B\f\r\x1C-\x1F\x85\p{Z}"
NON_WORD_NON_SPACE = r"[^\p{L}\p{N}_" + PY_SPACE + "]"
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"
WHITESPACE = r"[ \t\n\x0B\f\r]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_query(col) -> Column:
    """Drop every character that is neither a word character nor space."""
    return F.regexp_replace(_c(col), NON_WORD_NON_SPACE, "")


def tokens(col) -> Column:
    """Lower-cased word tokens of a text; empty pieces removed (K1)."""
    parts = F.split(F.lower(_c(col)), TOKEN_SPLIT)
    return F.filter(parts, lambda t: t != F.lit(""))


def whitespace_tokens(col) -> Column:
    return F.filter(F.split(F.trim(_c(col)), WHITESPACE), lambda t: t != F.lit(""))


def truncate_tokens(col, n: int) -> Column:
    """Keep the first ``n`` whitespace tokens (the model input limit)."""
    if n < 1:
        raise ValueError("n must be >= 1")
    return F.array_join(F.slice(whitespace_tokens(col), 1, n), " ")


# Input lengths of the reference loaders (query, doc, duo).
QUERY_MAX_TOKENS = 30
DOC_MAX_TOKENS = 200
PAIR_MAX_TOKENS = 230
DUO_MAX_TOKENS = 512


def pair_text(query, text, limit: int = PAIR_MAX_TOKENS) -> Column:
    """Cross-encoder input (P11): the query whole, the document cut to what the query leaves of ``limit`` tokens."""
    q = whitespace_tokens(F.coalesce(_c(query), F.lit("")))
    d = whitespace_tokens(F.coalesce(_c(text), F.lit("")))
    room = F.greatest(F.lit(limit) - F.size(q), F.lit(0))
    return F.array_join(F.concat(q, F.slice(d, F.lit(1), room)), " ")


def duo_text(query, text_a, text_b, limit: int = DUO_MAX_TOKENS) -> Column:
    """``[CLS] q [SEP] a [SEP] b`` line for a pair scorer, the whole line cut to ``limit`` tokens."""
    return truncate_tokens(F.format_string("[CLS] %s [SEP] %s [SEP] %s", _c(query), _c(text_a), _c(text_b)), limit)
