r"""Benchmark decontamination by a distributed positional inverted index.

Terms are words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased. The index is a stored
table of postings, cut into blocks of documents: one row (block, term, n, places) for each term of a
block, where a place is the word's number in the block, and one row per document (block, doc_id,
first place, words). Lists of the hottest terms are thus split by block.

A search takes windows of WINDOW consecutive words of each test item (a shorter item is one window),
orders each window's terms by their count in the whole index, rarest first, and in each block starts
from the rarest term's places, shifted back by its offset in the window, and keeps those that the
next terms' shifted lists hold too. With slop = 0 the matches are exact phrases. With slop = s each
further term may lie up to s places from where the phrase would have it (proximity).

Test items are read in groups of at most GROUP_BYTES of text, a pass over the postings for each; the
windows of a group go to the tasks as a broadcast, whose size is bounded by that. Only postings of a
group's terms leave the index.

Null text and null items have no words. Rows of documents stay apart even if they repeat a doc_id.
Items that repeat an item_id count once, under all their texts. Null item_id is the item "". Further
columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize, remove, row_key, small_batches, steps, trimmed, width

WINDOW = 10
GROUP_BYTES = 8 << 20
#: Text of one block of documents: the larger, the fewer rows for a term.
BLOCK_BYTES = 3 << 19
_TABLE = tv.folded(tv.TABLES[0])

_INDEX = "block long, term long, n long, places binary, doc_id long, first long, n_words long"


def _terms(words: tv.Words) -> np.ndarray:
    return words.hashes(_TABLE).view(np.int64)


def _index(batches):
    task, block = TaskContext.get().partitionId(), 0
    for b in batches:
        doc = b.column("doc_id").cast(pa.int64())
        for s, e, texts in steps(b.column("text"), BLOCK_BYTES, as_bytes=True):
            w = tv.Words(texts, tv.ALNUM)
            key = (task << 32) + block
            block += 1
            term = _terms(w)
            o = np.argsort(term, kind="stable").astype(np.int32)
            at = np.flatnonzero(np.diff(term[o], prepend=~term[o[:1]] if len(o) else 0) != 0) if len(o) else np.empty(0, np.int64)
            ends = np.append(at[1:], len(o))
            whole = o.tobytes()
            places = [whole[4 * x : 4 * y] for x, y in zip(at.tolist(), ends.tolist())]
            n, m = len(at), e - s
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, key)), pa.array(term[o[at]]), pa.array(ends - at), pa.array(places, pa.binary()), *(pa.nulls(n, pa.int64()) for _ in range(3))],
                names=["block", "term", "n", "places", "doc_id", "first", "n_words"],
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, key)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), doc[s:e], pa.array(w.first[:-1]), pa.array(w.count)],
                names=["block", "term", "n", "places", "doc_id", "first", "n_words"],
            )


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that build_index() wrote to path."""
    return spark.read.schema(_INDEX).parquet(path)


def build_index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The stored index of docs (doc_id, text); at path it stays for later searches."""
    if path is not None:
        small_batches(docs.sparkSession)
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_index), _INDEX).write.option("compression", "zstd").parquet(path)
        return open_index(docs.sparkSession, path)
    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(trimmed(_index), _INDEX), "op9-index")


class Query:
    """Windows of one group of items: terms (window x offset, padded), sizes and items."""

    def __init__(self, items: list[tuple[str, bytes]]):
        rows, sizes, owner = [], [], []
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        for item, text in items:
            t = _terms(tv.Words([text], tv.ALNUM))
            n = min(WINDOW, len(t))
            for k in range(len(t) - n + 1 if n else 0):
                rows.append(np.pad(t[k : k + n], (0, WINDOW - n)))
                sizes.append(n)
                owner.append(number[item])
        self.terms = np.array(rows, np.int64).reshape(-1, WINDOW)
        self.sizes, self.owner = np.array(sizes, np.int64), np.array(owner, np.int64)
        inside = np.arange(WINDOW)[None, :] < self.sizes[:, None]
        self.vocabulary = np.unique(self.terms[inside])

    def order(self, counts: dict[int, int]) -> None:
        """Offsets of each window, rarest term first. A window with a term that the index lacks goes."""
        n = np.array([counts.get(t, 0) for t in self.vocabulary.tolist()], np.int64)
        inside = np.arange(WINDOW)[None, :] < self.sizes[:, None]
        number = np.searchsorted(self.vocabulary, np.where(inside, self.terms, self.vocabulary[0] if len(self.vocabulary) else 0))
        freq = np.where(inside, n[number] if len(n) else 0, np.iinfo(np.int64).max)
        ok = (freq > 0).all(axis=1)
        self.number, self.sizes, self.owner = number[ok].astype(np.int32), self.sizes[ok], self.owner[ok]
        self.offsets = np.argsort(freq[ok], axis=1, kind="stable").astype(np.int8)
        self.terms = None


def _search(query, slop: int):
    """All windows against one block -> (doc row, window item, words hit)."""

    def run(table: pa.Table) -> pa.Table:
        q = query.value
        is_doc = table.column("term").is_null().to_numpy()
        # documents without words share their place with the next one, which must come last of them
        docs = table.filter(pa.array(is_doc)).sort_by([("first", "ascending"), ("n_words", "ascending")])
        first, n_words = docs.column("first").to_numpy(), docs.column("n_words").to_numpy()
        posts = table.filter(pa.array(~is_doc))
        number = np.searchsorted(q.vocabulary, posts.column("term").to_numpy())
        lists: list = [None] * len(q.vocabulary)
        for k, p in zip(number.tolist(), posts.column("places").to_pylist()):
            lists[k] = np.frombuffer(p, np.int32)
        have = np.array([x is not None for x in lists], bool)
        inside = np.arange(WINDOW)[None, :] < q.sizes[:, None]
        alive = np.flatnonzero((have[q.number] | ~inside).all(axis=1)) if len(q.sizes) else []
        found: dict[int, tuple[list, set]] = {}
        ends = first + n_words
        for w in alive:
            size, start = int(q.sizes[w]), None
            for off in q.offsets[w][:size].tolist():
                there = lists[q.number[w, off]]
                if start is None:
                    start = there - off
                    doc = np.searchsorted(first, there, "right") - 1
                    ok = (start >= first[doc]) & (start + size <= ends[doc])
                    start, doc = start[ok], doc[ok]
                else:
                    at = np.searchsorted(there, np.maximum(start + off - slop, first[doc]))
                    near = there[np.minimum(at, len(there) - 1)]
                    ok = (at < len(there)) & (near <= np.minimum(start + off + slop, ends[doc] - 1))
                    start, doc = start[ok], doc[ok]
                if not len(start):
                    break
            for s, d in zip(start.tolist(), doc.tolist()):
                hits, items = found.setdefault(d, ([], set()))
                hits.append((s - int(first[d]), size))
                items.add(int(q.owner[w]))
        rows = sorted(found)
        words = []
        for d in rows:
            cover = np.zeros(int(n_words[d]) + 1, np.int32)
            for s, size in found[d][0]:
                cover[s] += 1
                cover[s + size] -= 1
            words.append(np.flatnonzero(np.cumsum(cover[:-1]) > 0).astype(np.int32).tolist())
        return pa.table(
            {
                "block": pa.array(np.full(len(rows), table.column("block")[0].as_py(), np.int64)),
                "first": pa.array(first[rows] if rows else np.empty(0, np.int64)),
                "doc_id": docs.column("doc_id").take(pa.array(rows, pa.int64())).combine_chunks(),
                "n_words": pa.array(n_words[rows] if rows else np.empty(0, np.int64)),
                "words": pa.array(words, pa.list_(pa.int32())),
                "items": pa.array([[q.items[i] for i in sorted(found[d][1])] for d in rows], pa.list_(pa.string())),
            }
        )

    return run


def matches(index: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """block, first, doc_id, n_words, words (array of hit word places), items (array), for documents with matches."""
    spark = index.sparkSession
    items = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    groups = max(1, math.ceil(size / GROUP_BYTES))
    out = None
    for g in range(groups):
        part = items if groups == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        query = Query([(r.item, r.text.encode()) for r in part.toLocalIterator()])
        vocabulary = F.broadcast(spark.createDataFrame([(t,) for t in query.vocabulary.tolist()], "term long"))
        posts = index.where("term is not null").join(vocabulary, "term", "left_semi").select(*index.columns)
        query.order({r.term: r.n for r in posts.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()})
        sent = spark.sparkContext.broadcast(query)
        rows = posts.unionByName(index.where("term is null")).repartition(width(spark), "block")
        found = rows.groupBy("block").applyInArrow(_search(sent, slop), "block long, first long, doc_id long, n_words long, words array<int>, items array<string>")
        out = found if out is None else out.unionByName(found)
    if groups == 1:
        return out
    same = ["block", "first", "doc_id", "n_words"]
    return out.groupBy(*same).agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    index = build_index(docs)
    found = materialize(matches(index, items), "op9-found").where("size(words) > 0")
    all_docs = index.where("term is null").select("block", "first", "doc_id", "n_words")
    # a block and its first word name a document, but documents without words share that place
    clean = all_docs.join(found.select("block", "first"), ["block", "first"], "left_anti").unionByName(all_docs.where("n_words = 0").join(found.select("block", "first"), ["block", "first"], "left_semi"))
    none = clean.select("doc_id", "n_words", F.lit(None).cast("array<int>").alias("words"), F.lit(None).cast("array<string>").alias("items"))
    both = found.select("doc_id", "n_words", "words", "items").unionByName(none)
    ids = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    return both.select(
        "doc_id",
        "n_words",
        F.when(F.col("words").isNull(), F.lit(0)).otherwise(F.size("words")).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("words").isNotNull().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold a window of an item."""
    index = build_index(docs.select(row_key().alias("doc_id"), "text"))
    found = materialize(matches(index, items).where("size(words) > 0").select(F.col("doc_id").alias("row")).distinct(), "op9-found")
    remove(index)
    return docs.withColumn("row", row_key()).join(found, "row", "left_anti").select(*docs.columns)
