"""Hierarchical best-fit packing of token sequences.

Each document is tokenized and ends with id END. One longer than SIZE is cut into SIZE-token pieces,
of which the first may be shorter; a piece of SIZE tokens is a sequence of its own. The rest are
items of 1 to SIZE - 1 tokens.

Level 0 deals the items at random over partitions of some PER_TASK items and packs each partition
best-fit, longest items first. Bins with fewer than SLACK free tokens are final. All other bins are
items of the next level, dealt anew over as many partitions as their number asks for, until one
partition holds them all, or a round merges less than one in LEAST of its items: as items are dealt at
random, each partition sees the mix of sizes of the whole table, and what it cannot fill, others can
hardly fill either. No bin is left out of a round, and no task gets much more than PER_TASK items.

Only lengths move: ids are encoded once, in the first step.

Null text is empty: one END token. Ids may repeat or be null: pieces belong to the document's row.
Further columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, steps, trimmed
from .tokens import STEP_BYTES, encoder

SIZE, END = 2048, 0
SLACK = 8
#: Items of one task, and the share of items (one in so many) that a round must merge for another to follow.
PER_TASK, LEAST = 50_000, 100

_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, size: int):
    def run(batches):
        enc = encoder(path)
        for b in batches:
            doc, row = b.column("doc_id").to_pylist(), b.column("row").to_pylist()
            out: list[list] = [[] for _ in range(6)]
            for s, e, texts in steps(b.column("text"), STEP_BYTES):
                for d, r, ids in zip(doc[s:e], row[s:e], enc.encode(texts)):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    n = len(ids)
                    cuts = [0, *range(n % size or size, n + 1, size)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                        for col, v in zip(out, (d, r, k, x, y - x, zlib.crc32(ids[x:y].tobytes()))):
                            col.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, row, piece, start, length, ids_crc32 of every piece of every document."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), "text")
    return rows.mapInArrow(trimmed(_pieces(tokenizer, size)), _PIECES)


def best_fit(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, longest first: (bin, offset) of each item and the tokens in each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    free: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free tokens
    some = 0  # bit f: free[f] is not empty
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = some >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                some &= ~(1 << f)
        else:
            f, b = size, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free[f - n].append(b)
        some |= 1 << (f - n)
    return bins, offsets, np.array(fill, np.int64)


def _level(level: int, size: int, slack: int):
    """Packs one partition's items; a bin's id is made of level, partition and number."""

    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["length", "item"], ascending=[False, True], ignore_index=True)
        bins, offsets, fill = best_fit(items["length"].to_numpy(), size)
        base = (level << 58) + (int(items["part"].iloc[0]) << 28)
        return pd.DataFrame({"item": items["item"], "bin": base + bins, "at": offsets, "fill": fill[bins], "open": (fill <= size - slack)[bins]})

    return run


def pack(items: DataFrame, parts: int, size: int = SIZE, slack: int = SLACK, per_task: int = PER_TASK) -> DataFrame:
    """items: item (long, distinct), length (1..size) -> item, sequence_id, offset. parts: partitions of the first round."""
    schema = "item long, bin long, at long, fill long, open boolean"
    levels: list[DataFrame] = []
    items = items.select("item", "length")
    while True:
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item", F.lit(len(levels))), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInPandas(_level(len(levels), size, slack), schema), f"op6-level{len(levels)}")
        levels.append(packed)
        bins = packed.where("open").groupBy(F.col("bin").alias("item")).agg(F.first("fill").alias("length"))
        n, n_bins, n_open = packed.agg(F.count("*"), F.count_if(F.col("at") == 0), F.count_if((F.col("at") == 0) & F.col("open"))).first()  # each bin has one item at 0
        if parts == 1 or not n_open or len(levels) > 1 and (n - n_bins) * LEAST < n:
            break
        parts, items = -(-n_open // per_task), bins
    out = levels[0].select("item", "bin", F.col("at").alias("offset"), "open")
    for up in levels[1:]:
        up = up.select(F.col("item").alias("bin"), F.col("bin").alias("up"), F.col("at").alias("up_at"), F.col("open").alias("up_open"))
        out = out.join(up, "bin", "left").select("item", F.coalesce("up", "bin").alias("bin"), (F.col("offset") + F.coalesce("up_at", F.lit(0))).alias("offset"), F.coalesce("up_open", F.lit(False)).alias("open"))
    return out.select("item", F.col("bin").alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(docs, tokenizer, size).withColumn("item", F.monotonically_increasing_id()), "op6-pieces")
    placed = pack(cut.select("item", "length"), max(1, -(-cut.count() // PER_TASK)), size)
    return cut.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
