r"""Language ID: multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of code points of the lower-cased text, runs of anything but letters
and marks counted as one space, each hashed to 2**FEATURE_BITS. Training counts them by language;
the model is the matrix of log P(feature | language) with add-ALPHA smoothing and the log priors. Its
size is languages x 2**FEATURE_BITS x 4 bytes whatever the corpus (asserted, MAX_LANGUAGES). It goes
to the tasks as a broadcast; a batch of texts is scored by gathering the rows of its n-grams and
summing them per text, as a sparse matrix times the model.

The fit uses some MAX_TRAIN rows at most: every language gets the same quota, those with fewer rows all
of theirs. Rows are chosen by a hash of text and doc_id. A language without a chosen row is no class.
Every row is predicted.

score is the posterior probability of lang_pred. Null texts and texts without a letter are `und` with
score 0. With no training rows every text is `und`. Rows are independent: repeated or null ids and
further columns change nothing. Equal scores go to the first language in alphabetical order.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, steps, trimmed

FEATURE_BITS = 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
#: Bound on the training sample, in rows.
MAX_TRAIN = 60_000
MAX_LANGUAGES = 1000
#: Bytes of text of one numpy step; an n-gram takes some 60 bytes meanwhile.
STEP_BYTES = 1 << 18
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: 2 letter, 1 mark, 0 other."""
    if not _letters:
        kinds = {"L": 2, "M": 1}
        _letters.append(np.fromiter((kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1))
    return _letters[0]


class Grams:
    """Hashed n-grams of some texts: for each order the features of all texts and each text's range of them."""

    def __init__(self, texts: list[str]):
        lower = [t.lower() for t in texts]
        code = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = letters()[code]
        size = np.fromiter(map(len, lower), np.int64, len(lower))
        start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        word = kind > 0
        self.known = np.array([bool((kind[s : s + n] == 2).any()) for s, n in zip(start, size)], bool)
        # one space for a run of others, none at a text's start: drop an other whose left neighbour is one
        drop = np.zeros(len(code), bool)
        drop[1:] = ~word[1:] & ~word[:-1]
        drop[start[start < len(code)]] |= ~word[start[start < len(code)]]
        code = np.where(word, code, 32)[~drop].astype(np.uint64)
        gone = np.concatenate([[0], np.cumsum(drop)])
        self.lo = start - gone[np.minimum(start, len(gone) - 1)]
        end = np.minimum(start + size, len(gone) - 1)
        self.hi = end - gone[end]
        self.n = len(code)
        self.features = []
        h = np.zeros(len(code), np.uint64)
        for k in range(max(ORDERS)):
            h = h[: max(0, self.n - k)] * _STEP + code[k:] + np.uint64(1)
            if k + 1 in ORDERS:
                x = (h + np.uint64(k)) * _STEP
                x ^= x >> np.uint64(29)
                self.features.append((k + 1, ((x * _STEP) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)))


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}
    size = 1 << FEATURE_BITS

    def run(batches):
        total = np.zeros((len(languages), size), np.int64)
        rows = np.zeros(len(languages), np.int64)
        for b in batches:
            langs = b.column("lang").to_pylist()
            for s, e, texts in steps(b.column("text"), STEP_BYTES):
                g = Grams(texts)
                lang = np.array([number[x] for x in langs[s:e]])
                rows += np.bincount(lang, minlength=len(languages))
                for n, f in g.features:
                    last = np.maximum(g.hi - n + 1, g.lo)
                    for i in np.unique(lang):
                        own = lang == i
                        edge = np.bincount(g.lo[own], minlength=g.n + 1) - np.bincount(last[own], minlength=g.n + 1)
                        total[i] += np.bincount(f[np.cumsum(edge)[: len(f)] > 0], minlength=size)
        for i in np.flatnonzero(rows):
            at = np.flatnonzero(total[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([languages[i]] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[i][at], rows[i]))], names=["lang", "feature", "n"]
            )

    return run


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray):
        self.languages = languages
        p = counts + ALPHA
        self.matrix = np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32)
        self.prior = np.log((rows + 1) / (rows + 1).sum())

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log joint probability of each text and language, and whether the text has a letter."""
        g = Grams(texts)
        out = np.tile(self.prior, (len(texts), 1))
        for n, f in g.features:
            last = np.maximum(g.hi - n + 1, g.lo)
            for k, row in enumerate(self.matrix):
                c = np.zeros(len(f) + 1)
                np.cumsum(row[f], dtype=np.float64, out=c[1:])
                out[:, k] += c[np.minimum(last, len(f))] - c[np.minimum(g.lo, len(f))]
        return out, g.known


def quota(sizes: list[int], total: int) -> int:
    """The greatest q with sum(min(n, q) for n in sizes) <= total, at least 1."""
    left, todo = total, sorted(sizes)
    for k, n in enumerate(todo):
        if n * (len(todo) - k) > left:
            return max(1, left // (len(todo) - k))
        left -= n
    return max([1, *todo])


def train(labelled: DataFrame, max_rows: int = MAX_TRAIN) -> Model:
    """Fit on the rows of labelled (text, lang, and doc_id if there) with text and lang, a sample of about max_rows of them at most."""
    small_batches(labelled.sparkSession)
    key = F.xxhash64("text", *(["doc_id"] if "doc_id" in labelled.columns else []), F.lit("train"))
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", key.alias("key"))
    seen = rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(seen) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, sizes = [r[0] for r in seen], [r[1] for r in seen]
    counts, docs = np.zeros((len(languages), 1 << FEATURE_BITS)), np.zeros(len(languages))
    if languages:
        q = quota(sizes, max_rows)
        if max(sizes) > q:
            share = F.create_map(*(F.lit(x) for lang, n in zip(languages, sizes) for x in (lang, min(1 << 30, (1 << 30) * q // n))))
            rows = rows.where(F.pmod("key", F.lit(1 << 30)) < share[F.col("lang")])
        number = {x: i for i, x in enumerate(languages)}
        part = rows.select("text", "lang").mapInArrow(trimmed(_count(languages)), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
        for lang, feature, k in part.toLocalIterator():
            if feature < 0:
                docs[number[lang]] = k
            else:
                counts[number[lang], feature] = k
    have = np.flatnonzero(docs)
    return Model([languages[i] for i in have], counts[have], docs[have])


def _predict(model):
    def run(batches):
        for b in batches:
            m = model.value
            lang, score = [], []
            for s, e, texts in steps(b.column("text"), STEP_BYTES):
                if not m.languages:
                    lang += [UNKNOWN] * (e - s)
                    score += [0.0] * (e - s)
                    continue
                x, known = m.scores(texts)
                best = x.argmax(axis=1)
                p = 1 / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)
                lang += [m.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                score += np.where(known, p, 0.0).tolist()
            own = b.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*own.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' doc_id and held_out columns, if any, with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = [c for c in ("doc_id", "held_out", "row") if c in docs.columns]
    schema = ", ".join(f"{c} {dict(docs.dtypes)[c]}" for c in own)
    return docs.select(*own, "text").mapInArrow(trimmed(_predict(sent)), f"{schema}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that training never sees: crc32(doc_id as text) mod 4 is 2. Null ids are in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; trained on the rows that are not held out."""
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(rows, train(rows.where("not held_out")))


def accepted(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """docs whose text has a letter and whose predicted language has a posterior of min_score or more.

    Only texts go to Python and only verdicts come back; rows are filtered in the JVM."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    predict_batch = _predict(sent)

    @F.arrow_udf("boolean")
    def keep(text: pa.Array) -> pa.Array:
        (out,) = predict_batch([pa.RecordBatch.from_arrays([text], names=["text"])])
        return pc.and_(pc.not_equal(out.column("lang_pred"), UNKNOWN), pc.greater_equal(out.column("score"), min_score))

    return docs.where(keep("text"))
