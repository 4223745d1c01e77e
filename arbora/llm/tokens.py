r"""Token ids of many texts at once, equal to those of a byte-level BPE file of the `tokenizers` library.

The tokenizer cuts a text into pieces (words, numbers, signs, white space) and encodes each on its
own, so a piece always has the same ids. A batch is cut in numpy, equal pieces are found by hash,
and the library encodes only pieces that this worker has not met; a bounded cache keeps the rest.

Texts that hold the string of an added token, or a character that Unicode versions may class
differently, go through the library whole.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
import unicodedata

import numpy as np

from . import textvec as tv

#: Pieces that a worker remembers.
CACHE = 600_000
#: Bytes of text that are encoded at a time.
STEP_BYTES = 1 << 19
#: Pieces that the library gets in one call: its results take about a kilobyte each until they are copied.
_CALL = 4096
_SPACE, _LETTER, _NUMBER, _OTHER, _UNSURE = 0, 1, 2, 3, 4
_kinds: list[np.ndarray] = []
_made: dict[str, "Encoder"] = {}
_STEP = np.uint64(0x9E3779B97F4A7C15)

# The white space of Unicode's White_Space property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def kinds() -> np.ndarray:
    if not _kinds:
        by = {"L": _LETTER, "N": _NUMBER}
        out = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))
            out[c] = _UNSURE if k in ("Cn", "Cs") else by.get(k[0], _OTHER)
        out[0x1C:0x20] = _UNSURE
        out[_WHITE] = _SPACE
        _kinds.append(out)
    return _kinds[0]


def piece_starts(code: np.ndarray, kind: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Where pieces start: doc_start are the places of the texts' first characters."""
    n = len(code)
    first = np.zeros(n + 1, bool)
    first[doc_start] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last white space before a word is a piece of its own, or part of the word if it is a blank
    r = np.flatnonzero(run & (kind != _SPACE) & ~first[:n])
    r = r[kind[r - 1] == _SPACE]
    start[r - 1] = True
    start[r[code[r - 1] == 32]] = False
    # 's 't 'm 'd 're 've 'll where the apostrophe starts a piece
    q = np.flatnonzero(start & (code == 39) & (kind == _OTHER))
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    a = code[q + 1]
    one = q[np.isin(a, [ord(c) for c in "stmd"])]
    start[one + 1] = False
    end = one + 2
    q = q[(q + 2 < n)]
    q = q[~first[q + 2]]
    a, b = code[q + 1], code[q + 2]
    r_, v, e, ell = (ord(c) for c in "rvel")
    two = q[((a == r_) & (b == e)) | ((a == v) & (b == e)) | ((a == ell) & (b == ell))]
    start[two + 1] = False
    end = np.concatenate([end, two + 3])
    start[end[end < n]] = True
    return np.flatnonzero(start)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) + len(keys) > CACHE:
            self.clear()
        sizes, new = np.empty(len(pieces), np.int64), [self.ids]
        for s in range(0, len(pieces), _CALL):
            ids = [e.ids for e in self.tok.encode_batch(pieces[s : s + _CALL], add_special_tokens=False)]
            sizes[s : s + _CALL] = [len(x) for x in ids]
            new.append(np.fromiter((i for x in ids for i in x), np.uint32))
        at = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(pieces))
        self.ids = np.concatenate(new)
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        keys_all, at_all = np.concatenate([self.keys, keys]), np.concatenate([self.at, at])
        o = np.argsort(keys_all)
        self.keys, self.at = keys_all[o], at_all[o]

    def _numbers(self, keys: np.ndarray, pieces) -> np.ndarray:
        """Piece numbers of sorted distinct keys, encoding those not met before."""
        place = np.searchsorted(self.keys, keys)
        new = (place == len(self.keys)) | (self.keys[np.minimum(place, len(self.keys) - 1)] != keys) if len(self.keys) else np.ones(len(keys), bool)
        if new.any():
            if len(self.keys) + new.sum() > CACHE:
                new[:] = True
                self.clear()
            self._learn(keys[new], [pieces(k) for k in np.flatnonzero(new)])
        return self.at[np.searchsorted(self.keys, keys)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as tok.encode(text, add_special_tokens=False) gives them."""
        out: list = [None] * len(texts)
        todo = []
        for k, t in enumerate(texts):
            if not t:
                out[k] = np.empty(0, np.uint32)
            elif self.added and self.added.search(t):
                out[k] = self._whole(t)
            else:
                todo.append(k)
        if not todo:
            return out
        joined = "".join(texts[k] for k in todo)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[code]
        size = np.fromiter((len(texts[k]) for k in todo), np.int64, len(todo))
        doc_start = np.concatenate([[0], np.cumsum(size)])
        starts = piece_starts(code, kind, doc_start[:-1])
        ends = np.append(starts[1:], len(code))
        p, q = tv.powers(len(code))
        c = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(tv.mix(code.astype(np.uint64) * _STEP + np.uint64(1)) * p, out=c[1:])
        key = tv.mix((c[ends] - c[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        number = self._numbers(unique, lambda k: joined[starts[where[k]] : ends[where[k]]])[inverse]
        n = self.ends[number + 1] - self.ends[number]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.repeat(self.ends[number] - total[:-1], n) + np.arange(total[-1])]
        first = total[np.searchsorted(starts, doc_start[:-1])]
        last = np.append(first[1:], total[-1])
        unsure = kind == _UNSURE
        odd = np.add.reduceat(unsure, doc_start[:-1]) if unsure.any() else np.zeros(len(todo))
        for k, a, b, x in zip(todo, first, last, odd):
            out[k] = self._whole(texts[k]) if x else ids[a:b]
        return out


def encoder(path: str) -> Encoder:
    """One for each worker process and path. A Spark task has one core, so the library gets one thread."""
    if path not in _made:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _made[path] = Encoder(path)
    return _made[path]


def version(path: str) -> str:
    """Digest of the tokenizer file: what a stored count depends on besides the text."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()
