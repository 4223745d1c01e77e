"""Words, word hashes and window hashes of a whole batch of texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
_PINV = pow(_P, -1, 1 << 64)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=U) | U(1)


TABLES = (_table(11), _table(12))


def folded(table: np.ndarray) -> np.ndarray:
    """The same byte table with A-Z counted as a-z."""
    out = table.copy()
    out[65:91] = out[97:123]
    return out


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes of words: all but the excluded ranges."""
    out = np.ones(256, dtype=bool)
    for a, b in excluded:
        out[a : b + 1] = False
    return out


#: [^\x20\x09-\x0D]+
NON_SPACE = byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased
ALNUM = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
ALNUM[65:91] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_pow = {"n": 0, "p": np.empty(0, U), "q": np.empty(0, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, 1 << 16)
        _pow["p"] = np.concatenate([[U(1)], np.cumprod(np.full(m - 1, _P, U))])
        _pow["q"] = np.concatenate([[U(1)], np.cumprod(np.full(m - 1, _PINV, U))])
        _pow["n"] = m
    return _pow["p"][:n], _pow["q"][:n]


class Words:
    """Words of texts[0..]: starts and ends in `data`, and first[d]..first[d+1] are the words of text d."""

    def __init__(self, texts: list[bytes], in_word: np.ndarray):
        # a line end follows each text: it is in no word
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.doc_start = np.concatenate([[0], np.cumsum(lens + 1)])
        edge = np.diff(in_word[self.data].view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, self.doc_start)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, table: np.ndarray) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, table)

    def index(self) -> np.ndarray:
        """Place of each word in its own text."""
        return np.arange(len(self.starts)) - self.first[self.doc]

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return self.first[self.doc + 1] - np.arange(len(self.starts))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    p, q = powers(len(data))
    c = np.zeros(len(data) + 1, U)
    np.cumsum(table[data] * p, out=c[1:])
    return mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of words[i:i+n] for each i; the last n-1 values mean nothing. Callers mask windows over text ends."""
    m = np.random.default_rng(1000 * seed + n).integers(1, 1 << 63, n, dtype=U) | U(1)
    out = np.zeros(len(words), U)
    if len(words) >= n:
        for k in range(n):
            out[: len(words) - n + 1] += words[k : len(words) - n + 1 + k] * m[k]
    return mix(out)


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of `total` places lie in a run [s, s+n) of any s."""
    at = np.bincount(starts, minlength=total + 1) - np.bincount(np.minimum(starts + n, total), minlength=total + 1)
    return np.cumsum(at[:total]) > 0
