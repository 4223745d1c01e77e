"""Packed rows: many small entries travel as one row per (chunk or partition, bucket), a run of bytes a column."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import width

#: Packed bytes of one bucket, which is a partition and the unit that a task holds in memory.
BUCKET_BYTES = 16 << 20
#: Entries that a task gathers, over chunks of documents, before it packs them.
FLUSH = 400_000


def bucket_count(texts: DataFrame, share: float) -> int:
    """Buckets for entries of `share` bytes for each byte of column text: as many as the session's shuffles have, or more by size."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(width(texts.sparkSession), int(size * share) // BUCKET_BYTES + 1)


def by_number(rows: DataFrame, n: int) -> DataFrame:
    """Rows dealt by column bucket, one bucket a partition."""
    return rows.repartitionById(n, "bucket")


def gathered(parts, emit):
    """Arrays of several chunks joined until there are FLUSH entries, then emitted."""
    held, n = [], 0
    for arrays in parts:
        held.append(arrays)
        n += len(arrays[0])
        if n >= FLUSH:
            yield from emit(*(np.concatenate(x) for x in zip(*held)))
            held, n = [], 0
    if n:
        yield from emit(*(np.concatenate(x) for x in zip(*held)))


def new_run(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def runs(key: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Distinct keys of sorted rows, and the bytes of each key's run of each column."""
    if not len(key):
        return key, [[] for _ in cols]
    at = np.flatnonzero(new_run(key))
    ends = np.append(at[1:], len(key)).tolist()
    out = []
    for c in cols:
        size, whole = c.dtype.itemsize, c.tobytes()
        out.append([whole[size * a : size * b] for a, b in zip(at.tolist(), ends)])
    return key[at], out


def by_bucket(bucket: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    o = np.argsort(bucket, kind="stable")
    key, blobs = runs(bucket[o], *(c[o] for c in cols))
    return key.astype(np.int32), blobs


def joined(batches, names: tuple[str, ...], types: tuple) -> list[np.ndarray]:
    """All entries of some packed batches, one array a column."""
    parts: list[list[bytes]] = [[] for _ in names]
    for b in batches:
        for p, c in zip(parts, names):
            p += b.column(c).drop_null().to_pylist()
    return [np.frombuffer(b"".join(p), t) for p, t in zip(parts, types)]
