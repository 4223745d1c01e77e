r"""Substring dedup by difference-cover anchors.

Words are `[^\x20\x09-\x0D]+`. A window is WINDOW consecutive words of one document; a word is
removed when a window that covers it also starts in a document with a smaller doc_id.

Anchors are 7-word hashes at word places whose remainder modulo 7 is in {0, 1, 3}. The differences
of that set are all remainders modulo 7, so two equal windows of 13 words, wherever they start,
share an anchor at the same distance (0 to 6) from their starts:

1. anchors   hash words at cover places; keep places whose hash occurs in two documents.
2. extend    hash the whole windows (128 bits) around kept anchors; a window is marked where its
             smallest document is another one.
3. apply     remove the words under marked windows.

Steps 1 and 2 send one packed row per (chunk of documents, bucket of hashes), not a row per hash.
A chunk settles repeats among its own documents before it sends anything, so a passage that very
many documents share costs one entry per chunk, and no task gets all places of a hot passage. The
number of buckets follows the bytes of the texts, so that a bucket, which is what a task holds in
memory, stays at some BUCKET_BYTES.

Null text has no words. Rows of null doc_id come last in the order of documents. Rows that repeat
a doc_id don't remove each other's words (neither id is smaller); rows that repeat id and text get
equal results. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import textvec as tv
from .common import int64, materialize, remove, row_key, small_batches, steps, trimmed
from .packed import bucket_count, by_bucket, by_number, gathered, joined, new_run, runs

WINDOW = 13
PERIOD, COVER = 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

_ENTRY = ("keys", "keys2", "docs", "rows", "places", "many")
_KNOWN = ("docs", "rows", "places")
_SENT = "known boolean, bucket int, " + ", ".join(f"{c} binary" for c in _ENTRY)
_SENT_ARROW = pa.schema([("known", pa.bool_()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in _ENTRY])
_FOUND = "bucket int, docs binary, rows binary, places binary"
_FOUND_ARROW = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary()), ("places", pa.binary())])
_GATHERED = "known_doc long, known_row long, places binary"


def _found(buckets: int, doc: np.ndarray, row: np.ndarray, place: np.ndarray) -> list[pa.Array]:
    """Places packed by document row."""
    bucket, blobs = by_bucket((row.view(np.uint64) % np.uint64(buckets)).astype(np.int32), doc, row, place.astype(np.int32))
    return [pa.array(bucket), *(pa.array(x, pa.binary()) for x in blobs)]


def _settle(doc, row, place, k1, k2, buckets: int, by_smaller: bool):
    """One chunk's entries -> (rows to send, places already known).

    by_smaller: a place is known where the chunk has its key in a smaller document. Else: where the
    chunk has its key in two documents."""
    o = np.lexsort((place, row, doc, k2, k1)) if by_smaller else np.lexsort((row, k1))
    doc, row, place, k1, k2 = doc[o], row[o], place[o], k1[o], k2[o]
    new = new_run(k1, k2)
    group = np.cumsum(new) - 1
    if by_smaller:
        known = doc > doc[new][group]
        send, many = ~known, np.zeros(len(doc), bool)
    else:
        changes = np.zeros(len(doc), np.int64)
        changes[1:] = (row[1:] != row[:-1]) & ~new[1:]
        known = (np.bincount(group, weights=changes) > 0)[group] if len(group) else np.zeros(0, bool)
        send, many = ~known | new, known
    bucket, blobs = by_bucket(((k1[send] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32), *(x[send] for x in (k1, k2, doc, row, place.astype(np.int32), many)))
    none = pa.nulls(len(bucket), pa.binary())
    cols = [none if not by_smaller and c in ("keys2", "docs") else pa.array(x, pa.binary()) for c, x in zip(_ENTRY, blobs)]
    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(bucket), bool)), pa.array(bucket), *cols], schema=_SENT_ARROW)
    bucket, *cols = _found(buckets, doc[known], row[known], place[known])
    none = pa.nulls(len(bucket), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(bucket), bool)), bucket, none, none, *cols, none], schema=_SENT_ARROW)


def _meet(buckets: int, by_smaller: bool):
    """Entries of whole buckets -> places to keep (repeated, or repeated from a smaller document)."""

    def run(batches):
        entries = []
        for b in batches:
            known = b.filter(b.column("known")).select(["bucket", *_KNOWN])
            if len(known):
                yield known
            entries.append(b.filter(pc.invert(b.column("known"))))
        k1, k2, doc, row, place, many = joined(entries, _ENTRY, (np.uint64, np.uint64, np.int64, np.int64, np.int32, bool))
        entries.clear()
        if not len(k1):
            return
        if by_smaller:
            o = np.lexsort((doc, k2, k1))
            new = new_run(k1[o], k2[o])
            o = o[doc[o] > doc[o][new][np.cumsum(new) - 1]]
        else:
            o = np.lexsort((row, k1))
            k, r = k1[o], row[o]
            new = new_run(k)
            group = np.cumsum(new) - 1
            other = many[o].astype(np.int64)
            other[1:] += (r[1:] != r[:-1]) & ~new[1:]
            o = o[(np.bincount(group, weights=other) > 0)[group] & ~many[o]]
            doc = np.zeros(len(row), np.int64)
        if len(o):
            yield pa.RecordBatch.from_arrays(_found(buckets, doc[o], row[o], place[o]), schema=_FOUND_ARROW)

    return run


def _gather(by_doc: bool):
    """All places of each document row, in one row."""

    def run(batches):
        doc, row, place = joined(batches, _KNOWN, (np.int64, np.int64, np.int32))
        if not by_doc:
            doc = np.zeros(len(row), np.int64)
        o = np.lexsort((row, doc))
        doc, row, place = doc[o], row[o], place[o]
        at = np.flatnonzero(new_run(doc, row)) if len(row) else np.empty(0, np.int64)
        _, (blobs,) = runs(np.cumsum(new_run(doc, row)), place) if len(row) else (None, ([],))
        for s in range(0, len(at), 10_000):
            k = at[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(row[k]), pa.array(blobs[s : s + 10_000], pa.binary())], names=["known_doc", "known_row", "places"])

    return run


def exchange(rows: DataFrame, n: int, emit, by_smaller: bool) -> DataFrame:
    """Bring the entries that emit makes of rows together in n buckets; one row per document row with its kept places."""
    met = by_number(rows.mapInArrow(trimmed(emit(n)), _SENT), n).mapInArrow(trimmed(_meet(n, by_smaller)), _FOUND)
    return by_number(met, n).mapInArrow(trimmed(_gather(by_smaller)), _GATHERED)


def _places(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int32).astype(np.int64) if x else np.empty(0, np.int64) for x in column.to_pylist()]


def _anchors(buckets: int):
    def parts(batches):
        for b in batches:
            doc, row = int64(b.column("doc_id")), int64(b.column("row"))
            for s, e, texts in steps(b.column("text"), as_bytes=True):
                w = tv.Words(texts, tv.NON_SPACE)
                at, left = w.index(), w.left()
                ok = (left >= ANCHOR) & np.isin(at % PERIOD, COVER) & (w.count[w.doc] >= WINDOW)
                keys = tv.window_hashes(w.hashes(tv.TABLES[0]), ANCHOR, 1)[ok]
                d = w.doc[ok]
                yield doc[s:e][d], row[s:e][d], at[ok], keys, np.zeros(len(keys), np.uint64)

    return lambda batches: gathered(parts(batches), lambda *entries: _settle(*entries, buckets, False))


def _windows(buckets: int):
    def parts(batches):
        for b in batches:
            doc, row = int64(b.column("doc_id")), int64(b.column("row"))
            places = _places(b.column("places"))
            for s, e, texts in steps(b.column("text"), as_bytes=True):
                w = tv.Words(texts, tv.NON_SPACE)
                anchors = np.concatenate([p + f for p, f in zip(places[s:e], w.first)])
                # a window holds the anchor if it starts at most WINDOW - ANCHOR words before it
                near = np.zeros(len(w.starts) + 1, np.int64)
                lo = np.maximum(anchors - (WINDOW - ANCHOR), w.first[w.doc[anchors]])
                near += np.bincount(lo, minlength=len(near)) - np.bincount(anchors + 1, minlength=len(near))
                ok = (np.cumsum(near[:-1]) > 0) & (w.left() >= WINDOW)
                k1 = tv.window_hashes(w.hashes(tv.TABLES[0]), WINDOW, 2)[ok]
                k2 = tv.window_hashes(w.hashes(tv.TABLES[1]), WINDOW, 3)[ok]
                d = w.doc[ok]
                yield doc[s:e][d], row[s:e][d], w.index()[ok], k1, k2

    return lambda batches: gathered(parts(batches), lambda *entries: _settle(*entries, buckets, True))


def duplicate_windows(docs: DataFrame) -> DataFrame:
    """(known_doc, known_row, places): starts of windows that a smaller document has too."""
    rows = docs.select("doc_id", "text", row_key().alias("row"))
    # an entry of 21 bytes (anchors) or 37 (windows) for some of the words
    n = bucket_count(rows, 1.2)
    anchors = materialize(exchange(rows, n, _anchors, by_smaller=False), "op10-anchors")
    some = rows.join(anchors, rows["row"] == anchors["known_row"]).select("doc_id", "text", "row", "places")
    marked = materialize(exchange(some, n, _windows, by_smaller=True), "op10-marked")
    remove(anchors)
    return marked


def _left(texts: list[bytes], places: list[np.ndarray]):
    """For each text its number of words, and those that are left of them."""
    w = tv.Words(texts, tv.NON_SPACE)
    for k, (text, p) in enumerate(zip(texts, places)):
        words = text.split()
        if len(words) != w.count[k]:
            raise AssertionError("two readings of the words of a text differ")
        gone = tv.covered(p, WINDOW, len(words)) if len(p) else np.zeros(len(words), bool)
        yield len(words), [x for x, g in zip(words, gone) if not g] if len(p) else words


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            places = _places(b.column("places"))
            n_words, n_removed, kept = [], [], []
            for s, e, texts in steps(b.column("text"), as_bytes=True):
                for n, words in _left(texts, places[s:e]):
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    rest = b" ".join(words)
                    kept.append(rest.decode("utf-8", "replace") if with_text else hashlib.sha256(rest).hexdigest())
            own = b.drop_columns(["places", "text"])
            out = own.columns + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*own.schema.names, "n_words", "n_removed", "kept_text" if with_text else "kept_sha256"])

    return run


@F.arrow_udf(StringType())
def _cut(text: pa.Array, places: pa.Array) -> pa.Array:
    """What is left of texts with places; null without."""
    kept = []
    for s, e, texts in steps(text, as_bytes=True):
        kept += [b" ".join(words).decode("utf-8", "replace") for _, words in _left(texts, _places(places.slice(s, e - s)))]
    return pc.if_else(pc.is_null(places), None, pa.array(kept, pa.string()))


def _marked(docs: DataFrame) -> DataFrame:
    """docs with places (null without any)."""
    small_batches(docs.sparkSession)
    marked = duplicate_windows(docs)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1))
    return docs.withColumn("row", row_key()).join(marked, (key == marked["known_doc"]) & (F.col("row") == marked["known_row"]), "left").drop("known_doc", "known_row", "row")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: what is left of each document, words joined by a space."""
    rows = _marked(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(trimmed(_apply(True)), "doc_id long, n_words long, n_removed long, kept_text string")


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of the same decisions."""
    rows = _marked(docs.select(F.col("doc_id").cast("long"), "text"))
    return rows.mapInArrow(trimmed(_apply(False)), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text and n_chars (if there) of what is left; documents that lose all their words go.

    Only texts that lose words go to Python, and only what is left of them comes back."""
    rows = _marked(docs.select("doc_id", "text", F.struct(*docs.columns).alias("own")))
    asked = F.when(F.col("places").isNotNull(), F.col("text"))
    rows = rows.select("own", _cut(asked, F.col("places")).alias("left")).where("left is null or left <> ''")
    new = {c: F.col(f"own.`{c}`") for c in docs.columns} | {"text": F.coalesce("left", "own.text")}
    if "n_chars" in new:
        new["n_chars"] = F.coalesce(F.char_length("left").cast("long"), new["n_chars"])
    return rows.select(*(new[c].alias(c) for c in docs.columns))
