r"""One finite-state pass over UTF-8 bytes, and a verified hash table of the words it finds.

The pass is driven by three tables of fixed size: CLASS (byte -> class), NEXT (state, class -> state)
and OUTPUT (state, class -> marks). A mark says that a word starts or ends before the byte, or that
the byte is a capital, a symbol or the first byte of a code point. Every class leads to one state,
whatever the state before, so numpy can take all bytes of a batch at once: the state before a byte is
that after the byte before it. Each text is followed by the class END, which closes its last word.

Words go into an open-addressing table by the hash of text and bytes. An insertion that meets a
filled slot compares the bytes themselves, so equal hashes of different words go on to the next slot.
"""

from __future__ import annotations

import numpy as np

from . import textvec as tv

OUTSIDE, INSIDE = 0, 1
SPACE, PLAIN, CAPITAL, SYMBOL, CONTINUED, END = range(6)
STARTS, ENDS, POINT, CAP, SYM = 1, 2, 4, 8, 16

NEXT = np.zeros((2, 6), np.uint8)
NEXT[:, [PLAIN, CAPITAL, SYMBOL, CONTINUED]] = INSIDE

OUTPUT = np.zeros((2, 6), np.uint8)
OUTPUT[:, [SPACE, PLAIN, CAPITAL, SYMBOL]] |= POINT
OUTPUT[:, CAPITAL] |= CAP
OUTPUT[:, SYMBOL] |= SYM
OUTPUT[OUTSIDE, [PLAIN, CAPITAL, SYMBOL, CONTINUED]] |= STARTS
OUTPUT[INSIDE, [SPACE, END]] |= ENDS


def byte_classes(symbols: str) -> np.ndarray:
    """CLASS for words `[^\\x20\\x09-\\x0D]+`, capitals A-Z and the given ASCII symbols."""
    out = np.full(256, PLAIN, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[65:91] = CAPITAL
    out[list(symbols.encode("ascii"))] = SYMBOL
    out[0x80:0xC0] = CONTINUED
    return out


class Pass:
    """Counts of texts[0..] by one pass: arrays n_words, n_distinct, n_capitals, n_points, n_symbols."""

    def __init__(self, texts: list[bytes], classes: np.ndarray):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        after = np.cumsum(lens + 1)
        # a byte for each text's END, and 8 more so that 8 bytes can be read at any place
        self.data = np.frombuffer(b"\0".join(texts) + b"\0" * 9, np.uint8)
        n = int(after[-1]) if len(texts) else 0
        kind = classes[self.data[:n]]
        kind[after - 1] = END
        state = NEXT[OUTSIDE][kind]
        before = np.zeros(n, np.uint8)
        before[1:] = state[:-1]
        marks = OUTPUT.ravel()[before * np.uint8(OUTPUT.shape[1]) + kind]

        def per_text(mark: int) -> np.ndarray:
            at = np.flatnonzero(marks & mark)
            return np.diff(np.searchsorted(at, np.concatenate([[0], after])))

        self.starts, self.ends = np.flatnonzero(marks & STARTS), np.flatnonzero(marks & ENDS)
        self.n_words = np.diff(np.searchsorted(self.starts, np.concatenate([[0], after])))
        self.n_capitals, self.n_symbols, self.n_points = per_text(CAP), per_text(SYM), per_text(POINT)
        doc = np.repeat(np.arange(len(texts)), self.n_words)
        first = distinct(self.data, self.starts, self.ends, doc)
        self.n_distinct = np.bincount(doc[first], minlength=len(texts))


def _equal(data: np.ndarray, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes at two places are equal; the bytes themselves are compared, eight at a time."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = np.ones(len(at), bool)
    left, k = np.arange(len(at)), 0
    while len(left) and k < 64:
        rest = np.minimum(size[left] - k, 8).astype(np.uint64)
        shift = (np.uint64(8) - rest) * np.uint64(8)
        same = ((eight[at[left] + k] ^ eight[other[left] + k]) << shift) == 0
        out[left[~same]] = False
        left, k = left[same & (size[left] > k + 8)], k + 8
    for i in left:
        a, b, n = int(at[i]) + k, int(other[i]) + k, int(size[i]) - k
        out[i] = data[a : a + n].tobytes() == data[b : b + n].tobytes()
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Indices of one span for each distinct (doc, bytes), by insertion into a verified hash table.

    data: bytes with 8 spare ones at the end. hashes: one for each span, for tests of collisions."""
    n = len(starts)
    if hashes is None:
        hashes = tv.mix(tv.span_hashes(data, starts, ends, tv.TABLES[0]) + (doc.astype(tv.U) + tv.U(1)) * tv.U(0x9E3779B97F4A7C15))
    bits = max(4, int(2 * n).bit_length())
    table = np.full(1 << bits, -1, np.int64)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    waiting, owners, size = np.arange(n), [], ends - starts
    while len(waiting):
        s = slot[waiting]
        free = table[s] < 0
        table[s[free]] = waiting[free]  # of several that write one slot one stays
        owner = table[s]
        mine = owner == waiting
        owners.append(waiting[mine])
        waiting, owner = waiting[~mine], owner[~mine]
        alike = (hashes[owner] == hashes[waiting]) & (doc[owner] == doc[waiting]) & (size[owner] == size[waiting])
        i = np.flatnonzero(alike)
        alike[i] = _equal(data, starts[waiting[i]], starts[owner[i]], size[waiting[i]])
        waiting = waiting[~alike]
        slot[waiting] = (slot[waiting] + 1) & (len(table) - 1)
    return np.concatenate(owners) if owners else np.zeros(0, np.int64)
