"""Hashed word shingles of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

from cadence.llm.common import BLANKS

U = np.uint64
_RNG = np.random.default_rng(20240607)
#: A random number for each byte; A-Z share those of a-z.
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.int64).astype(U)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_BASE = 0x9E3779B97F4A7C17  # odd, 3 modulo 4
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            out = np.full(n, base, U)
            out[0] = 1
            _POWERS[i] = np.cumprod(out, dtype=U)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (runs of non-blank bytes, A-Z as a-z), and each text's word count."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    power, inverse = _powers(len(data) + 1)[:2]
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    blank = _BLANK[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts]) + 1
    return words, np.diff(np.searchsorted(starts, firsts))


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes: runs of ``width`` words, or all words
    where there are fewer; empty without words."""
    words, counts = word_hashes(texts)
    scale = [U(pow(_STEP, k, 1 << 64)) for k in range(width)]
    runs = np.full(max(0, len(words) - width + 1), width, U)
    for k in range(width):
        runs += words[k:k + len(runs)] * scale[k]
    runs = mix(runs)
    out, lo = [], 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(runs[lo:lo + n - width + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif n:
            s = mix(np.sum(words[lo:lo + n] * np.asarray(scale[:n], U), dtype=U, keepdims=True) + U(n))
        else:
            s = np.zeros(0, U)
        out.append(s)
        lo += n
    return out
