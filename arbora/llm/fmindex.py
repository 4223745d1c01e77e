"""A bidirectional FM-index over a sorted set of words, in numpy, and a search for words one edit away.

Each word is a circle $w of its own, where the delimiter $ is below every letter. Its rotations are
ordered by their letters up to $, and equal ones by their words. With sorted words this is the order
that steps to the left need, and row i of the rows that start with $ stands for word i. A second
transform holds the reversed words. A pattern's rows are n rows from `a` in one transform and n rows
from `b` in the other. A step asks one of them for its new rows and shifts the other's by the rows of
smaller letters, so patterns grow on both sides.

The search scheme has two searches for a word split into halves: match the first half exactly from
its last letter to its delimiter, then grow to the right with one edit; and the mirror image. A word
one edit away agrees with one half or the other, so both together find all.
"""

from __future__ import annotations

import numpy as np

#: Letters of the transform between two stored rows of counts.
BLOCK = 64
#: Words that are looked up at a time.
BATCH = 2048


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in one array, and each word's number of them."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.fromiter(map(len, words), np.int64, len(words))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class Transform:
    """The transform of words in sorted order, with the number of smaller letters before each place."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, n_codes: int):
        """letters: codes 1 to n_codes - 1 of the words, one after the other; sizes: letters of each."""
        n, total = len(sizes), int(sizes.sum()) + len(sizes)
        heads = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
        text = np.zeros(total, np.int64)
        inner = np.ones(total, bool)
        inner[heads] = False
        text[inner] = letters
        left = np.repeat(heads + sizes + 1, sizes + 1) - np.arange(total)  # letters to the end of the word, one more with the delimiter
        left[heads] = 1
        rank, reach, longest = text.copy(), 1, int(left.max(initial=1))
        while reach < longest + 1:
            ahead = np.zeros(total, np.int64)
            inside = np.flatnonzero(left > reach)
            ahead[inside] = rank[inside + reach]
            rank = np.unique(rank * (total + 1) + ahead, return_inverse=True)[1]
            reach *= 2
        order = np.argsort(rank, kind="stable")
        before = np.concatenate([[0], text[:-1]])
        before[heads] = text[heads + sizes]
        self.n_words, self.n_codes, self.total = n, n_codes, total
        bwt = before[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_codes))])
        blocks = total // BLOCK + 1
        counts = np.bincount(np.arange(total) // BLOCK * n_codes + bwt, minlength=blocks * n_codes).reshape(blocks, n_codes)
        less = np.zeros((blocks, n_codes + 1), np.int64)
        less[:, 1:] = np.cumsum(np.cumsum(counts, axis=0) - counts, axis=1)
        self.less = less.astype(np.int32)
        padded = np.full(blocks * BLOCK, n_codes, np.uint8 if n_codes < 256 else np.uint32)
        padded[:total] = bwt
        self.blocks = padded.reshape(blocks, BLOCK)

    def _block(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        block = at // BLOCK
        return block, self.blocks[block], np.arange(BLOCK) < (at % BLOCK)[:, None]

    def counts(self, at: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters equal to code, and smaller ones, before each place."""
        block, letters, before = self._block(at)
        base = self.less[block, code].astype(np.int64)
        same = self.less[block, code + 1] - base + (before & (letters == code[:, None])).sum(axis=1)
        return same, base + (before & (letters < code[:, None])).sum(axis=1)

    def all_less(self, at: np.ndarray) -> np.ndarray:
        """For each place and each code, the smaller letters before it: one row of n_codes + 1 numbers a place."""
        block, letters, before = self._block(at)
        out = self.less[block].astype(np.int64)
        key = (np.arange(len(at))[:, None] * self.n_codes + letters)[before]
        out[:, 1:] += np.cumsum(np.bincount(key, minlength=len(at) * self.n_codes).reshape(len(at), self.n_codes), axis=1)
        return out

    def step(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, code: np.ndarray):
        """Rows of the patterns with one more letter; those that no word holds have n = 0. Code -1 is in no word."""
        known = np.maximum(code, 0)
        same, less = self.counts(a, known)
        same2, less2 = self.counts(a + n, known)
        return self.first[known] + same, b + less2 - less, np.where(code < 0, 0, same2 - same)

    def branches(self, a: np.ndarray, b: np.ndarray, n: np.ndarray):
        """All letters that follow: (which pattern, code, a, b, n), none of them the delimiter."""
        low, high = self.all_less(a), self.all_less(a + n)
        more = np.diff(high, axis=1) - np.diff(low, axis=1)
        more[:, 0] = 0
        of, code = np.nonzero(more)
        same = low[of, code + 1] - low[of, code]
        return of, code, self.first[code] + same, b[of] + high[of, code] - low[of, code], more[of, code]


class Index:
    def __init__(self, words: list[str]):
        """words: distinct, of at least one letter, in code-point order."""
        points, sizes = _letters(words)
        self.alphabet = np.unique(points)
        codes = np.searchsorted(self.alphabet, points) + 1
        starts = np.cumsum(sizes) - sizes
        self.forward = Transform(codes, sizes, len(self.alphabet) + 1)
        turned = [w[::-1] for w in words]
        order = np.array(sorted(range(len(words)), key=turned.__getitem__), np.int64)
        back = codes[::-1]  # the words backwards, from the last to the first
        at = len(codes) - (starts + sizes)
        self.backward = Transform(back[_ranges(at[order], sizes[order])], sizes[order], len(self.alphabet) + 1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, sizes = _letters(words)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, -1), sizes

    def near(self, words: list[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(number of a looked-up word, number of an indexed one) for words that differ by one letter
        inserted, deleted or replaced, found by the search that matches the first half (or the second) exactly.

        words: of at least two letters."""
        if not self.forward.n_words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = []
        for s in range(0, len(words), BATCH):
            of, row = self._search(words[s : s + BATCH], first_half)
            pairs = np.unique(np.stack([of + s, row]), axis=1)
            found.append(pairs)
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _search(self, words: list[str], first_half: bool):
        codes, sizes = self.encode(words)
        starts, half = np.cumsum(sizes) - sizes, sizes // 2
        inner, outer = (self.forward, self.backward) if first_half else (self.backward, self.forward)
        # letters of the exact half and of the rest, from the middle outwards
        n_exact, n_rest = (half, sizes - half) if first_half else (sizes - half, half)
        middle = starts + half
        exact = (lambda q, t: codes[middle[q] - 1 - t]) if first_half else (lambda q, t: codes[middle[q] + t])
        rest = (lambda q, t: codes[middle[q] + t]) if first_half else (lambda q, t: codes[middle[q] - 1 - t])

        q = np.arange(len(words))
        a = b = np.zeros(len(q), np.int64)
        n = np.full(len(q), inner.total, np.int64)
        for t in range(int(n_exact.max(initial=0)) + 1):
            going = t <= n_exact[q]
            at_end = t == n_exact[q]
            code = np.where(at_end, 0, exact(q, np.minimum(t, n_exact[q] - 1)))
            a2, b2, n2 = inner.step(a, b, n, code)
            a, b, n = np.where(going, a2, a), np.where(going, b2, b), np.where(going, n2, n)
            alive = n > 0
            q, a, b, n = q[alive], a[alive], b[alive], n[alive]
        a, b = b, a  # from here on the other transform steps

        none = (np.zeros(0, np.int64),) * 4
        edited, out_q, out_row = none, [], []
        for t in range(int(n_rest[q].max(initial=-1)) + 1):
            here = n_rest[q] >= t
            q, a, b, n = q[here], a[here], b[here], n[here]
            last = n_rest[q] == t
            wanted = np.where(last, 0, rest(q, np.minimum(t, n_rest[q] - 1)))
            of, code, a2, b2, n2 = outer.branches(a, b, n)
            other = code != wanted[of]
            child = (q[of], a2, b2, n2)
            # between the halves only one of the two searches inserts
            inserted = tuple(x[other] for x in child) if t or first_half else none
            replaced = tuple(x[other & ~last[of]] for x in child)
            deleted = tuple(x[~last] for x in (q, a, b, n))
            edited = tuple(map(np.concatenate, zip(edited, inserted)))
            ends = n_rest[edited[0]] == t
            code = np.where(ends, 0, rest(edited[0], np.minimum(t, n_rest[edited[0]] - 1)))
            a2, b2, n2 = outer.step(*edited[1:], code)
            done, on = ends & (n2 > 0), ~ends & (n2 > 0)
            out_q.append(edited[0][done])
            out_row.append((b2 if first_half else a2)[done])
            edited = tuple(map(np.concatenate, zip((edited[0][on], a2[on], b2[on], n2[on]), replaced, deleted)))
            a, b, n = outer.step(a, b, n, wanted)
            on = (n > 0) & ~last
            q, a, b, n = q[on], a[on], b[on], n[on]
            if not len(q) and not len(edited[0]):
                break
        return (np.concatenate(out_q), np.concatenate(out_row)) if out_q else none[:2]
