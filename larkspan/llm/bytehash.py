"""Hashes of stretches of byte strings.

sums() and stretches() hash all places at once, modulo 2**64. Long strings with a regular pattern
can be made that share such a hash, so it only chooses places and groups (a collision costs
time, never a wrong match). digests() is a cryptographic hash and stands for the bytes.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = {}


def _upto(base: int, n: int) -> np.ndarray:
    """Powers 0 to n - 1 of ``base``; the longest table so far is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        table = np.full(size, np.uint64(base))
        table[0] = 1
        have = np.multiply.accumulate(table)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums (one more than bytes) from which stretches() takes hashes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _upto(_P, len(data)), out=out[1:])
    return out


def stretches(running: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each stretch of bytes [start, end); equal bytes have equal hashes wherever they lie."""
    inverse = _upto(_P_INVERSE, len(running))
    length = (end - start).astype(np.uint64)
    return mixed((running[end] - running[start]) * inverse[start] + length * np.uint64(0xD6E8FEB86659FD93))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of the stretches [start, end)."""
    view = memoryview(data)
    return np.frombuffer(b"".join([blake2b(view[a:b], digest_size=8).digest() for a, b in zip(start.tolist(), end.tolist())]), np.int64)
