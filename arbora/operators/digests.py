"""Digests of the features of arc candidates, in numpy, without the features' texts.

A text's digest is two sums of byte codes times powers of an odd number, so that of a concatenation
follows from those of its parts: H(ab) = H(a) + p**len(a) * H(b). Words and tags are hashed once for
each place of a sentence; a candidate's 88 features are then a few multiplications each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_RANDOM = np.random.default_rng(2024)
#: For each of the two sums: a code for each byte, and the number whose powers weigh places.
CODES = [_RANDOM.integers(1, 1 << 63, 256, dtype=U) for _ in range(2)]
FACTORS = [int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 63, 2)]
_INVERSE = [pow(f, -1, 1 << 64) for f in FACTORS]
#: Pairs of places whose features are made at a time, and words of a sentence up to which sentences share a step.
PAIRS, SHORT = 1 << 14, 128


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, U), np.cumprod(np.full(max(n - 1, 0), base, U))])[: max(n, 1)]


class Hashed:
    """Sums and weights (p**length) of texts: arrays h[0], h[1], p[0], p[1]."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(texts) else np.zeros(0, np.uint8)
        start, end = at[:-1] - at[0], at[1:] - at[0]
        self.h, self.p = [], []
        longest = int((end - start).max(initial=0))
        for code, factor, inverse in zip(CODES, FACTORS, _INVERSE):
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(code[data] * _powers(factor, len(data))[: len(data)], out=sums[1:])
            self.h.append((sums[end] - sums[start]) * _powers(inverse, len(data) + 1)[start])
            self.p.append(_powers(factor, longest + 1)[end - start])

    @classmethod
    def of(cls, *texts: str) -> Hashed:
        return cls(pa.array(texts, pa.string()))

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return mixed(self.h[0]), mixed(self.h[1])


class SpanHashes:
    """Digests of spans of texts from sums over whole texts. Offsets are characters in one row of all texts,
    each with one place more for its end: first[k] is where text k starts."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        # a byte after each text, which is the place of its end
        stops = at[1:] - at[0]
        data = np.insert(whole, stops, 0)
        self.place = np.flatnonzero((data & 0xC0) != 0x80)
        ends = stops + np.arange(len(stops))
        self.first = np.concatenate([[0], np.searchsorted(self.place, ends) + 1])
        self.sums, self.unshift = [], []
        for code, factor, inverse in zip(CODES, FACTORS, _INVERSE):
            sums = np.zeros(len(data) + 1, U)
            np.cumsum(code[data] * _powers(factor, len(data))[: len(data)], out=sums[1:])
            self.sums.append(sums)
            self.unshift.append(_powers(inverse, len(data) + 1))

    def digest(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One half of the digests."""
        a, b = self.place[start], self.place[end]
        return mixed((self.sums[k][b] - self.sums[k][a]) * self.unshift[k][a])

    def digests(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.digest(0, start, end), self.digest(1, start, end)


_SLASH = Hashed.of("/")


class Parts:
    """A table of hashed texts, of which templates join rows with slashes."""

    def __init__(self, *tables: Hashed):
        self.h = [np.concatenate([t.h[k] for t in tables]) for k in (0, 1)]
        self.p = [np.concatenate([t.p[k] for t in tables]) for k in (0, 1)]
        # a part and the slash after it
        self.h_slash = [h + p * s for h, p, s in zip(self.h, self.p, (x[0] for x in _SLASH.h))]
        self.p_slash = [p * s for p, s in zip(self.p, (x[0] for x in _SLASH.p))]

    def joined(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """The two sums of a/b/c for arrays of rows of the table."""
        out = [h[rows[-1]] for h in self.h]
        for row in reversed(rows[:-1]):
            out = [h[row] + p[row] * x for h, p, x in zip(self.h_slash, self.p_slash, out)]
        return out


def _numbered(prefix: Hashed, k: int, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (mixed(h[k] + p[k] * x) for h, p, x in zip(prefix.h, prefix.p, sums))
    return a, b


class Sentences:
    """Candidates of some sentences, in steps.

    words, tags, coarse, plain: lists of texts, one list a sentence, with the artificial root at place 0.
    coarse leaves edge marks as they are, plain (of tags between) does not."""

    def __init__(self, words: pa.ListArray, tags: pa.ListArray, coarse: pa.ListArray, plain: pa.ListArray, templates: list[str], between: list):
        self.sizes = np.diff(words.offsets.to_numpy()).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.total = n = int(self.sizes.sum())
        flat = [x.flatten() for x in (words, tags, coarse, plain)]
        self.base = {"w": 0, "t": n, "s": 2 * n, "plain": 3 * n}
        fixed = ["-S-", "-E-", "-M-", "L", "R", *map(str, range(6))]
        self.fixed = {x: 4 * n + k for k, x in enumerate(fixed)}
        self.parts = Parts(*map(Hashed, flat), Hashed.of(*fixed))
        self.previous = {k: self._previous(self.base[k]) for k in ("t", "plain")}
        self.templates, self.between = templates, between
        self.prefix = Hashed.of(*(f"{k}:" for k in range(len(templates) + len(between))))

    def _previous(self, base: int) -> np.ndarray:
        """For each place, the last one before it in its sentence that has the same tag; -1 without one."""
        place = np.arange(self.total) - np.repeat(self.starts, self.sizes)
        sentence = np.repeat(np.arange(len(self.sizes)), self.sizes)
        tag = mixed(self.parts.h[0][base : base + self.total])
        order = np.lexsort((place, tag, sentence))
        out = np.full(self.total, -1, np.int64)
        same = (tag[order][1:] == tag[order][:-1]) & (sentence[order][1:] == sentence[order][:-1])
        out[order[1:][same]] = place[order[:-1][same]]
        return out

    def steps(self):
        """(sentence, i, j) arrays of pairs i < j and the number of words of their sentences, at most some PAIRS at a time."""
        for n in np.unique(self.sizes).tolist():
            if n < 2:
                continue
            which = np.flatnonzero(self.sizes == n)
            if n <= SHORT:
                i, j = np.triu_indices(n, 1)
                at_once = max(1, PAIRS // len(i))
                for s in range(0, len(which), at_once):
                    some = which[s : s + at_once]
                    yield np.repeat(some, len(i)), np.tile(i, len(some)), np.tile(j, len(some)), n
            else:
                for one in which:
                    first = 0
                    while first < n - 1:
                        last = min(n - 1, first + max(1, PAIRS // (n - first)))
                        lengths = n - 1 - np.arange(first, last)
                        i = np.repeat(np.arange(first, last), lengths)
                        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                        yield np.full(len(i), one), i, j, n
                        first = last

    def features(self, sentence: np.ndarray, i: np.ndarray, j: np.ndarray, n: int):
        """Of one step: (candidate, h1, h2) of every feature; candidate 2 k is pair k to the left, 2 k + 1 to the right."""
        at = self.starts[sentence]
        gi, gj, touch = at + i, at + j, j == i + 1
        f, rows = self.fixed, {}
        for k in "ts":
            b = self.base[k]
            rows |= {
                f"i{k}p": np.where(i == 0, f["-S-"], b + gi - 1), f"j{k}n": np.where(j == n - 1, f["-E-"], b + gj + 1),
                f"i{k}n": np.where(touch, f["-M-"], b + gi + 1), f"j{k}p": np.where(touch, f["-M-"], b + gj - 1),
            }
        rows |= {f"{x}{k}": self.base[k] + g for k in "wts" for x, g in (("i", gi), ("j", gj))}
        rows["dist"] = f["0"] + np.minimum(j - i - 1, 5)
        pair = np.arange(len(i))
        out = []
        for way, right in (("L", 0), ("R", 1)):
            head, child = ("i", "j") if right else ("j", "i")
            here = rows | {"dir": np.full(len(i), f[way])} | {f"{a}{k}": rows[f"{x}{k}"] for k in "wts" for a, x in (("h", head), ("c", child))}
            for k, t in enumerate(self.templates):
                out.append((2 * pair + right, *_numbered(self.prefix, k, self.parts.joined([here[x] for x in t.split()]))))
        out += self._of_between(sentence, i, j, n, rows)
        return tuple(map(np.concatenate, zip(*out)))

    def _of_between(self, sentence, i, j, n, rows):
        """Features of the distinct tags between: of each, the first place after i that has it."""
        out, f = [], self.fixed
        # where the pairs of each (sentence, i) begin: a step has all j of its i
        begins = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (sentence[1:] != sentence[:-1])]))
        begin = np.repeat(begins, np.diff(np.append(begins, len(i))))
        for kind in "ts":
            base = "plain" if kind == "s" else "t"
            first = np.flatnonzero((self.previous[base][self.starts[sentence] + j] <= i) & (j < n - 1))
            times = n - 1 - j[first]
            ends = np.cumsum(times)
            step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - times, times)
            source = np.repeat(first, times)
            # the pair (i, j2) for j2 = j + 1, j + 2, ... comes that many rows after (i, j)
            pair = source + 1 + step
            tag = self.base[base] + self.starts[sentence[source]] + j[source]
            for k, (of, more) in enumerate(self.between, len(self.templates)):
                if of != kind:
                    continue
                start, end, dist = rows[f"i{kind}"][pair], rows[f"j{kind}"][pair], rows["dist"][pair]
                for way, right in (("L", 0), ("R", 1)):
                    joined = [start, tag, end, *([np.full(len(pair), f[way]), dist] if more else [])]
                    out.append((2 * pair + right, *_numbered(self.prefix, k, self.parts.joined(joined))))
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def begins(known: np.ndarray) -> np.ndarray:
    """Where sorted digests of equal leading bits begin, so that a look-up reads a run of a few neighbours."""
    bits = min(int(len(known)).bit_length() + 1, 24)
    return np.searchsorted(known, np.arange(1 << bits, dtype=U) << U(64 - bits))


def found(known: np.ndarray, asked: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which asked, its row of sorted known) for all equal pairs; known may repeat a value a few times. starts: begins(known)."""
    if not len(known) or not len(asked):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = begins(known) if starts is None else starts
    bits = len(starts).bit_length() - 1
    at = starts[asked >> U(64 - bits)]
    which, rows, left = [], [], np.arange(len(asked))
    while len(left):
        left = left[at[left] < len(known)]
        seen, wanted = known[at[left]], asked[left]
        hit = left[seen == wanted]
        which.append(hit)
        rows.append(at[hit])
        left = left[seen <= wanted]
        at[left] += 1
    return np.concatenate(which), np.concatenate(rows)
