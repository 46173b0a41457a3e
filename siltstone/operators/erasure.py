"""Systematic Cauchy Reed-Solomon shards over GF(256): any k of k + m shards give the data back."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x11D


def _tables() -> tuple[np.ndarray, np.ndarray]:
    exp, log, x = np.zeros(512, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        exp[i], log[x] = x, i
        x <<= 1
        x ^= POLYNOMIAL if x & 256 else 0
    exp[255:510] = exp[:255]
    return exp, log


EXP, LOG = _tables()


def mul(a, b) -> np.ndarray:
    a, b = np.asarray(a, np.uint8), np.asarray(b, np.uint8)
    return np.where((a == 0) | (b == 0), 0, EXP[LOG[a] + LOG[b]]).astype(np.uint8)


def inverse(a: int) -> int:
    return int(EXP[255 - LOG[a]])


def _rows(k: int, m: int) -> np.ndarray:
    """Identity over a Cauchy matrix: every square part of it can be inverted."""
    if k + m > 256:
        raise ValueError("at most 256 shards")
    cauchy = np.array([[inverse((k + i) ^ j) for j in range(k)] for i in range(m)], np.uint8).reshape(m, k)
    return np.vstack([np.eye(k, dtype=np.uint8), cauchy])


def _times(matrix: np.ndarray, shards: np.ndarray) -> np.ndarray:
    out = np.zeros((len(matrix), shards.shape[1]), np.uint8)
    for j in range(matrix.shape[1]):
        out ^= mul(matrix[:, j : j + 1], shards[j : j + 1])
    return out


def _invert(a: np.ndarray) -> np.ndarray:
    n = len(a)
    x = np.hstack([a.astype(np.uint8), np.eye(n, dtype=np.uint8)])
    for c in range(n):
        r = c + int(np.flatnonzero(x[c:, c])[0])
        x[[c, r]] = x[[r, c]]
        x[c] = mul(x[c], inverse(int(x[c, c])))
        for i in range(n):
            if i != c and x[i, c]:
                x[i] ^= mul(x[i, c], x[c])
    return x[:, n:]


def encode(data: bytes, k: int, m: int) -> list[bytes]:
    """k data shards and m parity shards of equal length; the data are padded with zero bytes."""
    size = -(-len(data) // k) or 1
    d = np.frombuffer(data.ljust(size * k, b"\0"), np.uint8).reshape(k, size)
    return [x.tobytes() for x in _times(_rows(k, m), d)]


def decode(shards: dict[int, bytes], k: int, m: int, length: int) -> bytes:
    """The data from any k shards by their numbers."""
    if len(shards) < k:
        raise ValueError("too few shards")
    have = sorted(shards)[:k]
    s = np.vstack([np.frombuffer(shards[i], np.uint8) for i in have])
    return _times(_invert(_rows(k, m)[have]), s).tobytes()[:length]
