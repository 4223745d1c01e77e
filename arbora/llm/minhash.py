r"""Near-duplicate documents by b-bit MinHash.

A document's set: the distinct 5-word shingles of its words (`[^\x20\x09-\x0D]+`, A-Z lower-cased);
a shorter text is one shingle; a text without words has the empty set. Two documents are linked when
100 * |intersection| >= 75 * |union|.

1. sign      256 minima of each set under 256 hash functions. The first 128, whole, make the keys of
             32 bands of 4; of each minimum the low 2 bits are kept, packed into 8 longs.
2. collapse  documents with equal sets are one class, named by its smallest doc_id.
3. stars     in each bucket, every class is a candidate with the bucket's pivot: the class that shares
             most buckets (an original shares more than its changed copies do). A second round takes
             the next pivots, only where a bucket is not connected yet.
4. estimate  m matching 2-bit cells of 256 give J ~ (m/256 - 1/4) / (3/4); candidates whose estimate is
             five and a half standard deviations under 0.75 go.
5. confirm   the rest are compared on their full shingle sets.
6. the rest  classes of buckets that are still not connected are joined by prefix: with shingles in
             order of their number of classes, two sets of similarity 0.75 share one of the rarest
             n - ceil(0.75 n) + 1 of each. Pairs of different components that do, of near sizes, and whose shingles from
             there on are enough, are candidates, estimated and confirmed the same way. So texts that only share common
             lines meet nowhere, connected ones don't meet again, and no link between two components is
             left out.
7. components of the confirmed links.

A pair at similarity 0.75 shares no bucket with probability (1 - 0.75**4)**32 = 5e-6.

Null text has the empty set. A doc_id names a vertex: texts that share a doc_id and are the smallest
of their class are one vertex. Null doc_id is one vertex that comes last. Further columns play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .common import chunks, materialize, remove, row_key, steps, trimmed, utf8
from .graph import components

SHINGLE = 5
BANDS, ROWS = 32, 4
PERMS = 256
STARS = 2
LAST = 2**63 - 1
#: 0.75 less 5.5 standard deviations of the estimate (0.0325 at 256 cells of 2 bits), in matching cells.
LEAST_MATCHES = int(PERMS * (0.25 + 0.75 * (0.75 - 5.5 * 0.0325)))

_rng = np.random.default_rng(8)
_A = _rng.integers(1, 1 << 63, PERMS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_M = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_TABLES = tuple(tv.folded(t) for t in tv.TABLES)

_SIGNED = "id long, row long, n_shingles long, k1 long, k2 long, sig array<long>, bands array<long>"


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    out = []
    for s, e in chunks([len(t) for t in texts]):
        w = tv.Words(texts[s:e], tv.NON_SPACE)
        words = w.hashes(_TABLES[0])
        full = tv.window_hashes(words, SHINGLE, 4)
        for k in range(e - s):
            a, b = w.first[k], w.first[k + 1]
            if b - a >= SHINGLE:
                out.append(np.unique(full[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(tv.window_hashes(words[a:b], b - a, 5)[:1])
            else:
                out.append(np.empty(0, np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, ~np.uint64(0))
    for s in range(0, len(shingles), 512):  # 1 MB at a time
        x = shingles[s : s + 512]
        np.minimum(out, (x[None, :] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """Low 2 bits of the minima, 32 to a long. The minima's own low bits are not mixed well, so mix first."""
    cells = (tv.mix(m) & np.uint64(3)).reshape(-1, 32)
    return (cells << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64)


def _sign(batches):
    for b in batches:
        keys, sigs, bands, n = [], [], [], []
        for x in (x for _, _, texts in steps(b.column("text"), as_bytes=True) for x in shingle_sets(texts)):
            n.append(len(x))
            d = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
            keys.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
            if len(x):
                m = minima(x)
                sigs.append(pack(m).view(np.int64))
                bands.append(tv.mix((m[: BANDS * ROWS].reshape(BANDS, ROWS) * _M).sum(axis=1, dtype=np.uint64)).view(np.int64))
            else:
                sigs.append([])
                bands.append([])
        k1, k2 = ([k[i] for k in keys] for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("row"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))],
            names=["id", "row", "n_shingles", "k1", "k2", "sig", "bands"],
        )


def matches(a: Column, b: Column) -> Column:
    """Cells of 2 bits that agree in two packed signatures."""
    differ = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda acc, x: acc + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))),
    )
    return F.lit(PERMS) - differ


def _confirm(batches):
    for b in batches:
        pair = [b.column(c) for c in ("text_a", "text_b")]
        va, vb = b.column("a").to_pylist(), b.column("b").to_pylist()
        keep = []
        sizes = sum(pc.fill_null(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(np.int64) for t in pair)
        for s, e in chunks(sizes.tolist(), 3 << 18):
            ta, tb = (utf8(t.slice(s, e - s)) for t in pair)
            place = {}
            for t in (*ta, *tb):
                place.setdefault(t, len(place))
            sets = shingle_sets(list(place))
            for x, y in zip(ta, tb):
                p, q = sets[place[x]], sets[place[y]]
                both = len(p) + len(q) - len(np.union1d(p, q)) if len(p) and len(q) else 0
                keep.append(both > 0 and 100 * both >= 75 * (len(p) + len(q) - both))
        keep = np.array(keep, bool)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)[keep]) for v in (va, vb)], names=["u", "v"])


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links among candidate pairs (a, b): estimate on signatures, then compare full sets."""
    sig = classes.select("node", "row", "sig")
    p = pairs.join(sig.select(F.col("node").alias("a"), F.col("row").alias("row_a"), F.col("sig").alias("sig_a")), "a")
    p = p.join(sig.select(F.col("node").alias("b"), F.col("row").alias("row_b"), F.col("sig").alias("sig_b")), "b")
    estimated = [p := materialize(p.where(matches(F.col("sig_a"), F.col("sig_b")) >= LEAST_MATCHES).select("a", "b", "row_a", "row_b"), "op8-pairs")]
    used = p.select(F.col("row_a").alias("row")).unionByName(p.select(F.col("row_b").alias("row"))).distinct()
    texts = materialize(docs.select(row_key().alias("row"), "text").join(used, "row").dropDuplicates(["row"]), "op8-texts")
    p = p.join(texts.select(F.col("row").alias("row_b"), F.col("text").alias("text_b")), "row_b")
    p = p.join(texts.select(F.col("row").alias("row_a"), F.col("text").alias("text_a")), "row_a")
    links = materialize(p.select("a", "b", "text_a", "text_b").mapInArrow(trimmed(_confirm), "u long, v long").distinct(), "op8-links")
    remove(pairs, *estimated, texts)
    return links


def _shingles(batches):
    for b in batches:
        nodes, comps = (b.column(c).to_numpy() for c in ("node", "component"))
        for s, e, texts in steps(b.column("text"), as_bytes=True):
            sets = shingle_sets(texts)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            node, comp = np.repeat(nodes[s:e], n), np.repeat(comps[s:e], n)
            every = np.concatenate(sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp), pa.array(np.repeat(n, n)), pa.array(every)], names=["node", "component", "n", "shingle"])


def _by_prefix(left: DataFrame, docs: DataFrame) -> DataFrame:
    """A stored table of pairs (a, b) of different components among left (node, component, row) that share a prefix shingle."""
    texts = docs.select(row_key().alias("row"), "text").join(left, "row").dropDuplicates(["node", "row"])
    every = materialize(texts.select("node", "component", "text").mapInArrow(trimmed(_shingles), "node long, component long, n long, shingle long"), "op8-shingles")
    # stored, so that Spark is free to split a hot shingle where it is joined
    common = materialize(every.groupBy("shingle").agg(F.count("*").alias("classes")).where("classes > 1"), "op8-common")
    shared = every.join(common, "shingle")
    # those that no other class has come first in the order, but can't be shared
    alone = F.col("n") - F.count("*").over(W.partitionBy("node"))
    place = F.row_number().over(W.partitionBy("node").orderBy("classes", "shingle"))
    prefix = F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1
    heads = head = materialize(shared.select("node", "component", "n", "shingle", (place + alone).alias("place"), prefix.alias("prefix")).where("place <= prefix").drop("prefix"), "op8-prefixes")
    mixed = materialize(head.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("shingle"), "op8-mixed")
    # sets of similarity 0.75 differ in size by a third at most, so by one band of sizes; within a shingle, only near bands meet
    head = head.join(mixed, "shingle").withColumn("band", F.floor(F.log("n") / math.log(4 / 3)))
    a, b = (head.select("shingle", F.col("node").alias(k), F.col("component").alias(f"c{k}"), F.col("n").alias(f"n{k}"), (F.col("n") - F.col("place") + 1).alias(f"rest{k}"), "band") for k in "ab")
    b = b.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    # from the first common shingle on, the sets can share no more than the smaller rest; 0.75 takes 3/7 of both sizes
    fits = (F.col("ca") < F.col("cb")) & (7 * F.least("resta", "restb") >= 3 * (F.col("na") + F.col("nb")))
    pairs = materialize(a.join(b, ["shingle", "band"]).where(fits).select("a", "b").distinct(), "op8-prefix-pairs")
    remove(every, heads, common, mixed)
    return pairs


def near_duplicates(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """(row_key of the document first, if asked for,) doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), row_key().alias("row"), "text")
    signed = materialize(rows.mapInArrow(trimmed(_sign), _SIGNED), "op8-signed")
    names = signed.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("id").alias("node"))
    names = materialize(names, "op8-names")
    classes = signed.join(names.withColumnRenamed("node", "id"), ["k1", "k2", "id"]).select(F.col("id").alias("node"), "row", "sig", "bands")
    classes = materialize(classes.dropDuplicates(["node", "row"]), "op8-classes")
    keys = materialize(signed.select("id", "row", "n_shingles", "k1", "k2"), "op8-keys")
    remove(signed)

    in_bucket = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    members = materialize(in_bucket.join(shared.select("bucket", "size"), "bucket"), "op8-members")
    weight = members.groupBy("node").agg(F.sum("size").alias("weight"))
    unranked, members = members, materialize(members.select("bucket", "node").join(weight, "node").select("bucket", F.struct("weight", "node").alias("rank")), "op8-ranked")
    remove(unranked)

    comp = links = spark.createDataFrame([], "u long, v long")
    comp = comp.select(F.col("u").alias("node"), F.col("v").alias("component"))
    last = None  # pivots of the round before
    for _ in range(STARS):
        open_ = members if last is None else members.join(last, "bucket").where("rank < pivot").drop("pivot")
        last = open_.groupBy("bucket").agg(F.max("rank").alias("pivot"))
        star = members.join(last, "bucket").where("rank <> pivot").select(F.col("pivot.node").alias("a"), F.col("rank.node").alias("b")).distinct()
        star = star.join(comp.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left").join(comp.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
        star = star.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        old = [links, comp, members, last]
        new = _confirmed(star, classes, docs)
        links = materialize(links.unionByName(new), "op8-links")
        comp = components(links)
        placed = members.select("bucket", "rank", F.col("rank.node").alias("node")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
        members = materialize(placed.join(mixed, "bucket").select("bucket", "rank"), "op8-members")
        last = materialize(last.join(mixed, "bucket"), "op8-pivots")
        remove(new, *old)

    left = members.select(F.col("rank.node").alias("node")).distinct().join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = _confirmed(_by_prefix(left.join(classes.select("node", "row"), "node"), docs), classes, docs)
    if not more.isEmpty():
        old, comp = comp, components(links.unionByName(more))
        remove(old)
    remove(classes, members, last, links, more)

    of_class = materialize(names.join(comp.withColumnRenamed("component", "c"), "node", "left").select("k1", "k2", F.coalesce("c", "node").alias("component")), "op8-of-class")
    remove(names, comp)
    out = keys.join(of_class, ["k1", "k2"], "left")
    component = F.coalesce("component", "id")
    return out.select(
        *(["row"] if with_row else []),
        F.nullif("id", F.lit(LAST)).alias("doc_id"),
        "n_shingles",
        F.nullif(component, F.lit(LAST)).alias("component_id"),
        (component == F.col("id")).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs, of each group of linked documents the one of smallest doc_id, and of equal rows one."""
    kept = near_duplicates(docs, with_row=True).where("kept").select("row").distinct()
    return docs.withColumn("row", row_key()).join(kept, "row").dropDuplicates(["row"]).select(*docs.columns)
