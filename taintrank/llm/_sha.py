"""SHA-256 over many messages at once, from any retained state (FIPS 180-4).

A digest written as 64 hex characters fills exactly one block. So a parent over hex digests is a chain of
blocks, its state before each child slot is eight words, and a later hash can go on from that state; the
states of ``hashlib`` cannot be stored. Arrays hold one message per column: states (8, n), blocks (16, n).
"""

from __future__ import annotations

import numpy as np

U = np.uint32


def _primes(n: int) -> list[int]:
    out: list[int] = []
    c = 2
    while len(out) < n:
        if all(c % p for p in out):
            out.append(c)
        c += 1
    return out


def _root_bits(p: int, degree: int) -> int:
    """The first 32 fractional bits of a root of ``p``, in whole numbers."""
    target = p << (32 * degree)
    lo, hi = 0, 1 << 40
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** degree <= target else (lo, mid - 1)
    return lo & 0xFFFFFFFF


START = np.array([_root_bits(p, 2) for p in _primes(8)], U)
_K = [U(_root_bits(p, 3)) for p in _primes(64)]
# the ASCII codes of the four hex digits of every 16-bit number
_NIBBLE = np.frombuffer(b"0123456789abcdef", np.uint8).astype(U)
_N = np.arange(1 << 16)
_HEX = (_NIBBLE[_N >> 12] << U(24)) | (_NIBBLE[(_N >> 8) & 15] << U(16)) | (_NIBBLE[(_N >> 4) & 15] << U(8)) | _NIBBLE[_N & 15]


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U(n)) | (x << U(32 - n))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The states after one more block; a block of one column serves all states."""
    w = [block[i] for i in range(16)]
    a, b, c, d, e, f, g, h = (state[i] for i in range(8))
    for i in range(64):
        if i >= 16:
            x, y = w[(i - 15) % 16], w[(i - 2) % 16]
            s0 = _rotate(x, 7) ^ _rotate(x, 18) ^ (x >> U(3))
            s1 = _rotate(y, 17) ^ _rotate(y, 19) ^ (y >> U(10))
            w[i % 16] = w[i % 16] + s0 + w[(i - 7) % 16] + s1
        t1 = h + (_rotate(e, 6) ^ _rotate(e, 11) ^ _rotate(e, 25)) + (g ^ (e & (f ^ g))) + _K[i] + w[i % 16]
        t2 = (_rotate(a, 2) ^ _rotate(a, 13) ^ _rotate(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + t1, c, b, a, t1 + t2
    return np.stack([a, b, c, d, e, f, g, h]) + state


def start(n: int) -> np.ndarray:
    return np.repeat(START[:, None], n, axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The block that a digest's 64 hex characters fill. ``digest``: (8, n)."""
    out = np.empty((16, digest.shape[1]), U)
    out[0::2] = _HEX[digest >> U(16)]
    out[1::2] = _HEX[digest & U(0xFFFF)]
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The digests of messages that end after so many whole blocks."""
    pad = np.zeros((16, state.shape[1]), U)
    pad[0] = U(0x80000000)
    bits = blocks.astype(np.uint64) * np.uint64(512)
    pad[14], pad[15] = (bits >> np.uint64(32)).astype(U), (bits & np.uint64(0xFFFFFFFF)).astype(U)
    return compress(state, pad)


def feed(state: np.ndarray, digest: np.ndarray, use: np.ndarray | None = None) -> np.ndarray:
    """The states after the hex text of a digest, in the columns of ``use`` (default all) only."""
    if use is None or use.all():
        return compress(state, hex_block(digest))
    if not use.any():
        return state
    out = state.copy()
    out[:, use] = compress(state[:, use], hex_block(digest[:, use]))
    return out


def pack(words: np.ndarray) -> bytes:
    """(8, n) as n * 32 bytes, digest by digest."""
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def unpack(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, ">u4").reshape(-1, 8).T).astype(U)


def hexes(words: np.ndarray) -> list[str]:
    text = pack(words).hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]
