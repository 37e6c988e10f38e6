"""Keyed permutations of row numbers: an order of n rows that any task can compute for its own rows."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64


def key_of(*parts) -> int:
    """A 64-bit key from any values."""
    return int.from_bytes(hashlib.blake2b("|".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Places of ``x`` in a keyed permutation of ``range(n)``: four Feistel rounds, walked until inside."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = _U((1 << half) - 1), _U(half)
    out, open_ = x.astype(_U), np.arange(len(x))
    while len(open_):
        left, right = out[open_] >> shift, out[open_] & mask
        for r in range(4):
            left, right = right, left ^ (_scramble(right + _U((key + r * 0x9E3779B97F4A7C15) % 2**64)) & mask)
        out[open_] = (left << shift) | right
        open_ = open_[out[open_] >= _U(n)]
    return out.astype(np.int64)
