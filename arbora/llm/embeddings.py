r"""Embedding near-dedup with hierarchical navigable small-world graphs, one for each shard.

1. classes    vectors with equal label and equal components are one class, so copies cost one node.
2. shards     the classes of one label and dimension are dealt by hash to shards of at most some SHARD vectors or
              SHARD_BYTES. Each shard gets a graph (hnsw.py). An audit then widens its beam: AUDIT of its own
              vectors, and as many at the limit's angle from them, are looked up and held against all its vectors,
              until RECALL of the links are found. Beams that reach the shard's size scan it.
3. query      every shard is queried with every vector of its label: of two shards one queries the other, in turns,
              so that work is even. A query whose beam is full of links is held against the whole shard, so groups
              of any size lose no links. Candidates are decided by their cosine in double precision.
4. union      a task sends each vector's number of links and a spanning forest of what it linked, never all pairs;
              components are joins (graph.py).

Work grows with the square of a label's vectors over SHARD, as every shard is queried. A task holds two
shards. Counts of links are sums of copies, so copies count each other and each other's links.

Vectors that are null, empty, zero or hold null or non-finite components, and those with null label or
null vec_id, link with nothing: no links, their own component, kept. Vectors of unequal length are not
compared. Each row is a vector of its own, also where it repeats a vec_id: rows that are equal throughout
are copies. An empty table gives no rows. Columns besides vec_id, embedding and label play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hnsw
from .common import materialize, remove, sized, small_batches, trimmed
from .graph import components

LINK = 0.93
SHARD, SHARD_BYTES = 8192, 16 << 20
RECALL, AUDIT, BEAM = 0.99, 128, 16
#: Single-precision similarities this far below the limit are decided in double precision.
SLACK = 1e-4

_ROWS = "vec_id long, label string, digest binary, dim int, vector binary"
_ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("digest", pa.binary()), ("dim", pa.int32()), ("vector", pa.binary())])


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _vectors(batches):
    for batch in batches:
        rows = batch.column("embedding")
        values, offsets = rows.values, rows.offsets.to_numpy()
        holes = values.is_null().to_numpy(zero_copy_only=False)
        flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # no -0.0
        present = rows.is_valid().to_numpy(zero_copy_only=False)
        named = batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False) & batch.column("label").is_valid().to_numpy(zero_copy_only=False)
        digests, dims, blobs = [], [], []
        for i in range(len(batch)):
            x = flat[offsets[i] : offsets[i + 1]]
            good = present[i] and named[i] and x.any() and np.isfinite(x).all() and not holes[offsets[i] : offsets[i + 1]].any()
            blob = x.tobytes() if good else None
            blobs.append(blob)
            digests.append(hashlib.blake2b(blob, digest_size=16).digest() if good else None)
            dims.append(len(x) if good else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], schema=_ROWS_ARROW)


_SHARD = "label string, dim int, shard int, shards int, cids binary, copies binary, vectors binary, links array<binary>, beam int"
_SHARD_ARROW = pa.schema(
    [("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), ("shards", pa.int32()), ("cids", pa.binary()), ("copies", pa.binary()), ("vectors", pa.binary()), ("links", pa.list_(pa.binary())), ("beam", pa.int32())]
)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = _scaled(x)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _audited_beam(graph: hnsw.Graph, link: float, recall: float) -> int:
    """The narrowest beam, doubled from BEAM, that finds enough of the links of sampled and turned vectors; the shard's size if none does."""
    n, dim = graph.vectors.shape
    own = graph.vectors[np.linspace(0, n - 1, min(n, AUDIT)).astype(int)]
    turn = np.random.default_rng(7).normal(size=own.shape)
    turn -= np.einsum("nd,nd->n", turn, own)[:, None] * own
    norm = np.sqrt(np.einsum("nd,nd->n", turn, turn))
    turned = own[norm > 1e-9]
    turned = link * turned + np.sqrt(1 - link**2) * turn[norm > 1e-9] / norm[norm > 1e-9, None]
    asked = np.concatenate([own, turned]).astype(np.float32)
    wanted = (asked @ graph.vectors.T >= link - SLACK).sum(axis=1)
    beam = BEAM
    while beam < n:
        near = (graph.search(asked, beam)[1] >= link - SLACK).sum(axis=1)
        found = np.where(near == beam, wanted, np.minimum(near, wanted))  # a full beam means a scan
        if found.sum() >= recall * wanted.sum():
            return beam
        beam *= 2
    return n


def _build(link: float, recall: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("digest")  # digests are hashes: a random order, the same on every run
        first = {c: group.column(c)[0].as_py() for c in ("label", "dim", "shard", "shards")}
        vectors = np.frombuffer(b"".join(group.column("vector").to_pylist()), np.float64).reshape(len(group), first["dim"])
        graph = hnsw.Graph.build(_unit(vectors).astype(np.float32))
        cids, copies = (group.column(c).to_numpy().astype(np.int64).tobytes() for c in ("cid", "copies"))
        links = [x.tobytes() for x in graph.links]
        row = {**first, "cids": cids, "copies": copies, "vectors": vectors.tobytes(), "links": links, "beam": _audited_beam(graph, link, recall)}
        return pa.Table.from_pylist([row], schema=_SHARD_ARROW)

    return run


class _Forest:
    """Components of a task's nodes; each label is the smallest node joined so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while (self.label != self.label[self.label]).any():
                self.label = self.label[self.label]


def _links(queries: np.ndarray, targets: np.ndarray, graph: hnsw.Graph, beam: int, link: float, same: bool):
    """(a query, a target) arrays of links, in parts; with same, each pair of a shard with itself once.

    queries, targets: unit vectors in double precision."""
    n = len(targets)
    dense = np.ones(len(queries), bool)
    if beam < n:
        ids, sims = graph.search(queries.astype(np.float32), beam)
        dense = sims[:, -1] >= link - SLACK
        q, at = np.nonzero((sims >= link - SLACK) & ~dense[:, None])
        t = ids[q, at].astype(np.int64)
        if same:
            free = (q != t) & ~dense[t]  # links of dense ones come with their scans
            key = np.unique(np.minimum(q, t)[free] * n + np.maximum(q, t)[free])
            q, t = key // n, key % n
        sure = np.einsum("pd,pd->p", queries[q], targets[t]) >= link
        yield q[sure], t[sure]
    scanned = np.flatnonzero(dense)
    for s in range(0, len(scanned), hnsw.BATCH):
        some = scanned[s : s + hnsw.BATCH]
        q, t = np.nonzero(queries[some] @ targets.T >= link)
        q = some[q]
        if same:
            once = (t > q) | ((t < q) & ~dense[t])
            q, t = q[once], t[once]
        yield q, t


_FOUND = "u long, v long, n long"
_FOUND_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])


def _query(link: float):
    def run(batches):
        for batch in batches:
            for row in range(len(batch)):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                ints = {c: np.frombuffer(r[c], np.int64) for c in ("cids", "copies", "q_cids", "q_copies")}
                stored, asked = (np.frombuffer(r[c], np.float64).reshape(-1, r["dim"]) for c in ("vectors", "q_vectors"))
                targets, queries = _unit(stored), _unit(asked)
                degrees = [hnsw.BASE_DEGREE] + [hnsw.DEGREE] * (len(r["links"]) - 1)
                graph = hnsw.Graph(targets.astype(np.float32), [np.frombuffer(x, np.int32).reshape(-1, k) for x, k in zip(r["links"], degrees)])
                same, n = r["shard"] == r["q_shard"], len(targets)
                # nodes of the task: targets, then queries
                shift = 0 if same else n
                forest, count = _Forest(n + (0 if same else len(queries))), np.zeros(n + (0 if same else len(queries)), np.int64)
                for q, t in _links(queries, targets, graph, r["beam"], link, same):
                    forest.join(q + shift, t)
                    np.add.at(count, q + shift, ints["copies"][t])
                    np.add.at(count, t, ints["q_copies"][q])
                cids = ints["cids"] if same else np.concatenate([ints["cids"], ints["q_cids"]])
                some, joined = np.flatnonzero(count), np.flatnonzero(forest.label != np.arange(len(cids)))
                u, v = np.concatenate([cids[some], cids[joined]]), cids[forest.label[joined]]
                nulls = pa.nulls(len(some), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.concat_arrays([nulls, pa.array(v)]), pa.array(np.concatenate([count[some], np.zeros(len(joined), np.int64)]))], schema=_FOUND_ARROW)

    return trimmed(run)


def _shards(classes: DataFrame, link: float, recall: float) -> DataFrame:
    """A row for each shard of labels with two classes and more, stored."""
    size = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where("n > 1")
    by_bytes = F.ceil(F.col("n") * F.col("dim") * 8 / SHARD_BYTES)
    size = materialize(size.select("label", "dim", F.greatest(F.ceil(F.col("n") / SHARD), by_bytes).cast("int").alias("shards")), "embedding-sizes")
    dealt = classes.join(sized(size), ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("digest"), "shards").cast("int"))
    out = materialize(dealt.groupBy("label", "dim", "shard").applyInArrow(_build(link, recall), _SHARD), "embedding-shards")
    remove(size)
    return out


def _found(shards: DataFrame, link: float) -> DataFrame:
    """u, null, links of u; and u, v, 0 for the edges of spanning forests. Stored."""
    # of shards i and j, i queries j where j is at most half a turn ahead
    k, ahead = F.col("shards"), F.col("ahead")
    asked = shards.select("label", "dim", F.col("shard").alias("q_shard"), "shards", *(F.col(c).alias(f"q_{c}") for c in ("cids", "copies", "vectors")))
    asked = asked.withColumn("ahead", F.explode(F.sequence(F.lit(0), F.floor(k / 2).cast("int")))).where((2 * ahead < k) | (F.col("q_shard") < ahead))
    asked = asked.withColumn("shard", ((F.col("q_shard") + ahead) % k).cast("int")).drop("shards", "ahead")
    pairs = shards.drop("shards").hint("merge").join(asked, ["label", "dim", "shard"])
    return materialize(pairs.mapInArrow(_query(link), _FOUND), "embedding-links")


def near_embeddings(vectors: DataFrame, link: float = LINK, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row for each row of vectors (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    picked = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("string").alias("label"))
    rows = materialize(picked.mapInArrow(trimmed(_vectors), _ROWS), "embedding-rows")
    classes = rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    # ids are stored with their rows, so no later run gives others
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "embedding-classes")
    shards = _shards(classes, link, recall)
    found = _found(shards, link)
    remove(shards)
    counts = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("n").alias("links"))
    joined = components(found.where("v IS NOT NULL").select("u", "v"))
    named = joined.select(F.col("node").alias("cid"), "component")
    leasts = named.join(classes.select("cid", "least"), "cid").groupBy("component").agg(F.min("least").alias("component_id"))
    whole = classes.select("cid", "label", "digest", "least", "copies").join(counts, "cid", "left").join(named.join(leasts, "component"), "cid", "left")
    linked = whole.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = materialize(linked, "embedding-linked")
    remove(found, joined, classes)
    plain = rows.select("vec_id", "label", "digest")
    own = plain.where("digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    known = plain.where("digest IS NOT NULL").join(linked, ["label", "digest"])
    return known.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).unionByName(own)
