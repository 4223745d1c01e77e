r"""Suffix-array dedup of byte strings: every byte under a 200-byte string that also starts elsewhere goes.

The collection is cut up by content, so that each task can order its own part of it:

1. anchors   of each 200-byte window the 24-byte gram of smallest hash (the leftmost of equals) is
             its anchor. The choice depends on the window's bytes only, so equal windows have equal
             anchors at the same distance. An anchor's context is the 376 bytes (less at text ends)
             that hold all windows with that anchor.
2. meet      anchors meet by gram, as packed rows (chunk, bucket). Equal contexts are one string with
             a count; all windows of a context found twice are repeated. A gram with two or more
             different contexts needs the suffix order of those.
3. order     contexts are dealt by gram. A task builds the transform of its strings by columns, from
             the last to the first: each round inserts one symbol of every string, moves the strings
             to the order of the suffixes that start in that column (a stable sort by the new
             symbol of the order before: a string's rank is the number of smaller symbols and of equal ones
             before it), and updates the common prefixes of neighbours (one more than
             the least prefix between them in the round before; 0 where symbols differ). Strings
             are aligned at their anchors, and equal windows start in the same column, so only the current
             column of the transform is kept. Where a neighbour has 200 bytes in common, the window
             that starts in that column is repeated.
             Symbols are in external files of GROUP columns each, which are written while strings arrive and
             read from the last to the first, each in sequence. In memory are the order, the common prefixes
             and one group of columns: some 60 bytes a string.
4. apply     bytes under repeated windows are cut out.

Null text is empty. Rows count as different documents even if they are equal (then all but short ones
go whole). Ids may be null or repeat; further columns play no part.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import int64, materialize, remove, remove_folder, row_key, scratch_path, small_batches, steps, trimmed, utf8, width
from .packed import bucket_count, by_bucket, by_number, joined, new_run, runs

LENGTH = 200
GRAM = 24
SPAN = LENGTH - GRAM  # an anchor starts at most this far into its windows
CONTEXT = LENGTH + SPAN
STARTS = SPAN + 1
BITS = (STARTS + 7) // 8
#: Columns of one external file.
GROUP = 16
#: Bytes of contexts that one task orders, as far as grams can be dealt so.
ORDER_BYTES = 32 << 20
_BLOCK = 1 << 20

_ENTRY = ("grams", "contexts", "rows", "places", "many")
_MET = ("whole_rows", "whole", "asked_rows", "asked")
_SENT = "met boolean, bucket int, " + ", ".join(f"{c} binary" for c in (*_ENTRY, *_MET))
_SENT_ARROW = pa.schema([("met", pa.bool_()), ("bucket", pa.int32())] + [(c, pa.binary()) for c in (*_ENTRY, *_MET)])
_OUT = "bucket int, " + ", ".join(f"{c} binary" for c in _MET)
_OUT_ARROW = pa.schema([("bucket", pa.int32())] + [(c, pa.binary()) for c in _MET])
_ASKED = np.dtype([("place", "<i4"), ("many", "?"), ("gram", "<u8")])


def anchors(hashes: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Distinct anchors of the windows that start at valid places. hashes[i]: gram at i, for all i < len(valid) + SPAN."""
    out, n = [], len(valid)
    for a in range(0, n, _BLOCK):
        b = min(n, a + _BLOCK)
        h = hashes[a : b + SPAN]
        pad = -len(h) % STARTS
        key = np.full(len(h) + pad, ~np.uint64(0))
        key[: len(h)] = (h & ~np.uint64((1 << 23) - 1)) | np.arange(len(h), dtype=np.uint64)
        key = key.reshape(-1, STARTS)
        after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(key, axis=1).ravel()
        at = np.flatnonzero(valid[a:b])
        best = np.minimum(after[at], before[at + SPAN])
        out.append((best & np.uint64((1 << 23) - 1)).astype(np.int64) + a)
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.int64)


def contexts_of(texts: list[bytes]):
    """For each anchor of some texts: its text, place, gram hash and context hash."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.concatenate([[0], np.cumsum(lens)])
    n = int(first[-1])
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    p, q = tv.powers(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(tv.TABLES[0][data] * p, out=c[1:])
    grams = (c[GRAM:] - c[:-GRAM]) * q[: n - GRAM + 1]
    # windows that lie within one text
    edge = np.zeros(n - LENGTH + 2, np.int32)
    long = lens >= LENGTH
    np.add.at(edge, first[:-1][long], 1)
    np.add.at(edge, np.minimum(first[1:][long] - LENGTH + 1, n - LENGTH + 1), -1)
    at = anchors(grams, np.cumsum(edge[:-1]) > 0)
    text = np.searchsorted(first, at, "right") - 1
    lo = np.maximum(at - SPAN, first[text])
    hi = np.minimum(at + LENGTH, first[text + 1])
    shape = (at - lo).astype(np.uint64) * np.uint64(1 << 20) + (hi - lo).astype(np.uint64)
    return text, at - first[text], tv.mix(grams[at]), tv.mix((c[hi] - c[lo]) * q[lo] + tv.mix(shape + np.uint64(1)))


def _by_row(buckets: int, row: np.ndarray, what: np.ndarray, asked: bool) -> pa.RecordBatch:
    """Places of whole contexts, or requests, packed by document row."""
    bucket, blobs = by_bucket((row.view(np.uint64) % np.uint64(buckets)).astype(np.int32), row, what)
    none = [pa.nulls(len(bucket), pa.binary())] * 2
    cols = [pa.array(x, pa.binary()) for x in blobs]
    return pa.RecordBatch.from_arrays([pa.array(bucket), *(none + cols if asked else cols + none)], schema=_OUT_ARROW)


def _anchors(buckets: int):
    def run(batches):
        for b in batches:
            rows = int64(b.column("row"))
            for s, e, texts in steps(b.column("text"), 1 << 20, as_bytes=True):
                text, place, gram, context = contexts_of(texts)
                row, place = rows[s:e][text], place.astype(np.int32)
                o = np.lexsort((context, gram))
                gram, context, row, place = gram[o], context[o], row[o], place[o]
                new = new_run(gram, context)
                group = np.cumsum(new) - 1
                many = (np.bincount(group) > 1)[group] if len(group) else np.empty(0, bool)
                settled = _by_row(buckets, row[many], place[many], False)
                n = len(settled)
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), settled.column("bucket"), *[pa.nulls(n, pa.binary())] * len(_ENTRY), *settled.columns[1:]], schema=_SENT_ARROW)
                bucket = ((gram[new] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)
                bucket, blobs = by_bucket(bucket, *(x[new] for x in (gram, context, row, place, many)))
                n = len(bucket)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), pa.array(bucket), *(pa.array(x, pa.binary()) for x in blobs), *[pa.nulls(n, pa.binary())] * len(_MET)], schema=_SENT_ARROW)

    return run


def _meet(buckets: int):
    def run(batches):
        entries = []
        for b in batches:
            met = b.filter(b.column("met")).select(["bucket", *_MET])
            if len(met):
                yield met
            entries.append(b.filter(pc.invert(b.column("met"))))
        gram, context, row, place, many = joined(entries, _ENTRY, (np.uint64, np.uint64, np.int64, np.int32, bool))
        entries.clear()
        if not len(gram):
            return
        o = np.lexsort((context, gram))
        gram, context, row, place, many = gram[o], context[o], row[o], place[o], many[o]
        new, first = new_run(gram, context), new_run(gram)
        string, group = np.cumsum(new) - 1, np.cumsum(first) - 1
        found = (np.bincount(string, weights=1 + many) > 1)[string]
        twice = found & ~many
        if twice.any():
            yield _by_row(buckets, row[twice], place[twice], False)
        ask = new & (np.bincount(group, weights=new)[group] > 1)
        if ask.any():
            what = np.zeros(int(ask.sum()), _ASKED)
            what["place"], what["many"], what["gram"] = place[ask], found[ask], gram[ask]
            yield _by_row(buckets, row[ask], what, True)

    return run


def _gather(batches):
    """Whole contexts and requests of each document row, in one row."""
    row, whole, ask_row, asked = joined(batches, _MET, (np.int64, np.int32, np.int64, _ASKED))
    out: dict[int, list] = {}
    for k, (r, what) in enumerate(((row, whole), (ask_row, asked))):
        o = np.argsort(r, kind="stable")
        key, (blobs,) = runs(r[o], what[o])
        for x, y in zip(key.tolist(), blobs):
            out.setdefault(x, [None, None])[k] = y
    rows = list(out)
    for s in range(0, len(rows), 10_000):
        k = rows[s : s + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array([out[x][i] for x in k], pa.binary()) for i in (0, 1))], names=["row", "whole", "asked"])


def _contexts(batches):
    for b in batches:
        rows = b.column("row").to_pylist()
        out: list[list] = [[] for _ in range(6)]
        for row, text, asked in zip(rows, utf8(b.column("text")), b.column("asked").to_pylist()):
            seen = set()
            for place, many, gram in np.frombuffer(asked, _ASKED).tolist():
                if place in seen:
                    continue
                seen.add(place)
                lo = max(0, place - SPAN)
                for col, v in zip(out, (gram - (1 << 64) if gram >> 63 else gram, row, place, place - lo, many, text[lo : place + LENGTH])):
                    col.append(v)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["gram", "row", "place", "left", "many", "context"])


class Columns:
    """The strings of a task by columns, in external files of GROUP columns."""

    def __init__(self, folder: str):
        self.fs, root = pafs.FileSystem.from_uri(folder)
        self.root, self.sizes, self.out = f"{root}/{uuid.uuid4().hex}", [], []

    def add(self, block: np.ndarray) -> None:
        """block: columns x strings."""
        if not self.out:
            self.fs.create_dir(self.root, recursive=True)
            self.out = [self.fs.open_output_stream(f"{self.root}/{g}", compression=None) for g in range(0, CONTEXT, GROUP)]
        for f, g in zip(self.out, range(0, CONTEXT, GROUP)):
            f.write(block[g : g + GROUP].tobytes())
        self.sizes.append(block.shape[1])

    def backwards(self):
        """(number, symbols) of the columns, from the last to the first."""
        for f in self.out:
            f.close()
        for g in reversed(range(0, CONTEXT, GROUP)):
            with self.fs.open_input_stream(f"{self.root}/{g}", compression=None) as f:
                data = np.frombuffer(f.read(), np.uint8)
            width_ = min(GROUP, CONTEXT - g)
            blocks = [x.reshape(width_, n) for x, n in zip(np.split(data, np.cumsum(self.sizes)[:-1] * width_), self.sizes)]
            for j in reversed(range(width_)):
                yield g + j, np.concatenate([x[j] for x in blocks])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for f in self.out:
            f.close()
        if self.out:
            self.fs.delete_dir(self.root)


def _range_min(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least of d[a..b], ends included, for each pair."""
    size = b - a + 1
    level = np.frexp(size)[1] - 1
    out = np.empty(len(a), d.dtype)
    table, k = d, 0
    top = int(level.max()) if len(level) else -1
    while k <= top:
        own = np.flatnonzero(level == k)
        out[own] = np.minimum(table[a[own]], table[b[own] - (1 << k) + 1])
        k += 1
        if k <= top:
            h = 1 << (k - 1)
            table = np.minimum(table[:-h], table[h:])
    return out


def repeated_starts(columns, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits (strings x BITS): windows of LENGTH symbols that another string has in the same columns.

    columns: (j, symbols of column j) from the last to the first. String i has symbols in columns lo[i] to hi[i] - 1."""
    n = len(lo)
    out = np.zeros((n, BITS), np.uint8)
    order, common = np.arange(n), np.zeros(n, np.uint16)
    for j, symbols in columns:
        there = (lo <= j) & (j < hi)
        symbol = np.where(there, symbols.astype(np.uint16), np.uint16(256))[order]
        move = np.argsort(symbol, kind="stable")
        order, symbol = order[move], symbol[move]
        same = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] < 256)) + 1
        longer = _range_min(common, move[same - 1] + 1, move[same]) + np.uint16(1)
        common = np.zeros(n, np.uint16)
        common[same] = longer
        if j < STARTS:
            enough = common >= LENGTH
            hit = enough.copy()
            hit[:-1] |= enough[1:]
            out[order[hit], j >> 3] |= np.uint8(1 << (j & 7))
    return out


def _order(folder: str):
    def run(batches):
        with Columns(folder) as columns:
            meta = []
            for b in batches:
                if not len(b):
                    continue
                left = b.column("left").to_numpy()
                text = b.column("context").to_pylist()
                size = np.fromiter(map(len, text), np.int64, len(text))
                lo = SPAN - left
                flat = np.frombuffer(b"".join(text), np.uint8)
                place = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(flat))
                block = np.zeros((len(text), CONTEXT), np.uint8)
                block[np.repeat(np.arange(len(text)), size), place] = flat
                columns.add(np.ascontiguousarray(block.T))
                meta.append((lo, lo + size, b.column("row").to_numpy(), b.column("place").to_numpy(), b.column("many").to_numpy(zero_copy_only=False)))
            if not meta:
                return
            lo, hi, row, place, many = (np.concatenate(x) for x in zip(*meta))
            bits = repeated_starts(columns.backwards(), lo, hi)
        hit = np.flatnonzero(bits.any(axis=1) & ~many)
        for s in range(0, len(hit), 50_000):
            h = hit[s : s + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(row[h]), pa.array(place[h].astype(np.int32)), pa.array([x.tobytes() for x in bits[h]], pa.binary())], names=["row", "place", "bits"])

    return run


def _repeats(docs: DataFrame) -> DataFrame:
    """row, whole (places of contexts that are repeated whole), parts (place and bits of the others)."""
    spark = docs.sparkSession
    rows = docs.select("text", row_key().alias("row"))
    # an anchor has 29 bytes, and there is about one for each 88 bytes of text
    n = bucket_count(rows, 0.4)
    met = by_number(rows.mapInArrow(trimmed(_anchors(n)), _SENT), n).mapInArrow(trimmed(_meet(n)), _OUT)
    met = materialize(by_number(met, n).mapInArrow(trimmed(_gather), "row long, whole binary, asked binary"), "op3-met")
    asked = met.where("asked is not null").select("row", "asked")
    found = rows.join(asked, "row").select("row", "text", "asked").mapInArrow(trimmed(_contexts), "gram long, row long, place int, left int, many boolean, context binary")
    folder = scratch_path(spark, "op3-columns")
    strings = asked.agg(F.coalesce(F.sum(F.octet_length("asked")), F.lit(0))).first()[0] // _ASKED.itemsize
    found = found.repartition(max(width(spark), strings * CONTEXT // ORDER_BYTES + 1), "gram")
    parts = materialize(found.mapInArrow(trimmed(_order(folder)), "row long, place int, bits binary"), "op3-parts")
    remove_folder(spark, folder)
    by_row = parts.groupBy("row").agg(F.collect_list(F.struct("place", "bits")).alias("parts"))
    whole = met.where("whole is not null").select("row", "whole")
    out = materialize(whole.join(by_row, "row", "full"), "op3-repeats")
    remove(met, parts)
    return out


def removed_bytes(size: int, whole: bytes | None, parts: list[dict]) -> np.ndarray:
    """Which bytes of a text lie under repeated windows."""
    starts = []
    if whole:
        p = np.frombuffer(whole, np.int32).astype(np.int64)
        lo, hi = np.maximum(p - SPAN, 0), np.minimum(p + LENGTH, size)
        edge = np.bincount(lo, minlength=size + 1) - np.bincount(hi, minlength=size + 1)
        covered = np.cumsum(edge[:size]) > 0
    else:
        covered = np.zeros(size, bool)
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part["bits"], np.uint8), bitorder="little")
        starts.append(np.flatnonzero(bits) + part["place"] - SPAN)
    if starts:
        covered |= tv.covered(np.concatenate(starts), LENGTH, size)
    return covered


def _apply(with_text: bool):
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, whole, parts in zip(utf8(b.column("text")), b.column("whole").to_pylist(), b.column("parts").to_pylist()):
                gone = removed_bytes(len(text), whole, parts or []) if whole or parts else np.zeros(len(text), bool)
                rest = np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))
                for col, v in zip(out, (len(text), len(text) - len(rest), spans, rest.decode("utf-8", "replace") if with_text else hashlib.sha256(rest).hexdigest())):
                    col.append(v)
            cols = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256"])

    return run


def _applied(docs: DataFrame, with_text: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = docs.withColumn("row", row_key()).join(_repeats(docs), "row", "left").select("doc_id", "text", "whole", "parts")
    return rows.mapInArrow(trimmed(_apply(with_text)), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_text' if with_text else 'kept_sha256'} string")


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text of every document. A character that is cut in two shows as U+FFFD."""
    return _applied(docs, True)


def dedup_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that are left) of every document."""
    return _applied(docs, False)
