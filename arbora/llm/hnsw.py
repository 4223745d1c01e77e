"""A hierarchical navigable small-world graph of unit vectors in numpy, built and searched in batches.

Nodes are numbered so that those of higher levels come first: level k holds nodes 0 to sizes[k] - 1,
one in RATIO of the level below. Levels are built from the top. A batch of nodes is inserted by beam
searches in the graph so far and by comparing the batch with itself; neighbours are chosen by the
rule that a candidate nearer to a chosen neighbour than to the node is left out, and links back are
cut to the level's degree by the same rule.
"""

from __future__ import annotations

import numpy as np

RATIO = 16
#: Links of a node on upper levels and on the lowest, beam width while building, nodes inserted at a time.
DEGREE, BASE_DEGREE, BUILD_BEAM, INSERT = 12, 24, 40, 512
#: Nodes that a beam expands at a time.
EXPAND = 4
#: Queries that are searched at a time.
BATCH = 512


def level_sizes(n: int) -> list[int]:
    out = [n]
    while out[-1] > RATIO:
        out.append(-(-out[-1] // RATIO))
    return out


def _top(sims: np.ndarray, ids: np.ndarray, extra: np.ndarray, k: int):
    """The k best of each row, best first."""
    if sims.shape[1] > k:
        keep = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        sims, ids, extra = (np.take_along_axis(x, keep, 1) for x in (sims, ids, extra))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(x, order, 1) for x in (sims, ids, extra))


def beam_search(vectors: np.ndarray, links: np.ndarray, size: int, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the best `width` nodes that beams reach from each query's entries, best first; -1 and -inf fill up.

    links: rows of neighbours, -1 for none. size: nodes of the level that are in the graph. entries: one row a query."""
    n = len(queries)
    out_ids, out_sims = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    active = np.arange(n)
    seen = np.zeros((n, size), bool)
    ids = entries.astype(np.int32)
    np.put_along_axis(seen, ids.astype(np.int64), True, 1)
    sims = np.einsum("qd,qed->qe", queries, vectors[ids])
    if ids.shape[1] < width:
        fill = ((0, 0), (0, width - ids.shape[1]))
        ids, sims = np.pad(ids, fill, constant_values=-1), np.pad(sims, fill, constant_values=-np.inf)
    sims, ids, done = _top(sims, ids, ids < 0, width)
    while True:
        waiting = ~done
        going = waiting.any(axis=1)
        if not going.all():
            stop = active[~going]
            out_ids[stop], out_sims[stop] = ids[~going], sims[~going]
            active, ids, sims, done, waiting = active[going], ids[going], sims[going], done[going], waiting[going]
        if not len(active):
            return out_ids, out_sims
        chosen = waiting & (np.cumsum(waiting, axis=1) <= EXPAND)
        done = done | chosen
        row, col = np.nonzero(chosen)
        ahead = links[ids[row, col]]
        of = np.repeat(row, ahead.shape[1])
        ahead = ahead.ravel()
        new = ahead >= 0
        of, ahead = of[new], ahead[new]
        new = ~seen[active[of], ahead]
        key = np.unique(of[new] * np.int64(size) + ahead[new])
        of, ahead = key // size, key % size
        seen[active[of], ahead] = True
        near = np.einsum("pd,pd->p", queries[active[of]], vectors[ahead])
        better = near > sims[of, -1]
        of, ahead, near = of[better], ahead[better], near[better]
        if not len(of):
            continue
        per = np.bincount(of, minlength=len(active))
        place = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
        more = int(per.max())
        more_ids, more_sims = np.full((len(active), more), -1, np.int32), np.full((len(active), more), -np.inf, np.float32)
        more_ids[of, place], more_sims[of, place] = ahead, near
        sims, ids, done = _top(np.concatenate([sims, more_sims], 1), np.concatenate([ids, more_ids], 1), np.concatenate([done, more_ids < 0], 1), width)


def _diverse(vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours of nodes among candidates (best first): those nearer to the node than to any chosen before,
    then, where links are left, the best of the others. -1 fills up."""
    rows, width = ids.shape
    of = vectors[np.maximum(ids, 0)]
    between = of @ of.transpose(0, 2, 1)
    chosen = np.zeros((rows, width), bool)
    worst = np.full((rows, width), -np.inf, np.float32)  # similarity of each candidate to the nearest chosen one
    valid = (ids >= 0) & (ids != own[:, None])
    for k in range(width):
        take = valid[:, k] & (sims[:, k] > worst[:, k]) & (chosen.sum(axis=1) < degree)
        chosen[:, k] = take
        worst = np.where(take[:, None], np.maximum(worst, between[:, k]), worst)
    # chosen ones first, then the others, each in order; then as many as there are links
    order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)) * width + np.arange(width), axis=1)[:, :degree]
    out = np.where(np.take_along_axis(valid, order, 1), np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1) if out.shape[1] < degree else out


class Graph:
    def __init__(self, vectors: np.ndarray, links: list[np.ndarray]):
        """vectors: unit, float32, in the order of nodes; links: of each level, the lowest first."""
        self.vectors, self.links = vectors, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        sizes = level_sizes(len(vectors))
        graph = cls(vectors, [np.full((m, BASE_DEGREE if not k else DEGREE), -1, np.int32) for k, m in enumerate(sizes)])
        for level in reversed(range(len(sizes))):
            s = 0
            while s < sizes[level]:
                e = min(sizes[level], s + max(RATIO, min(INSERT, s)))
                graph._insert(level, s, e)
                s = e
        return graph

    def _entries(self, queries: np.ndarray, level: int) -> np.ndarray:
        """The node of the level above where a greedy descent from the top ends, one column."""
        at = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.links) - 1, level, -1):
            at = beam_search(self.vectors, self.links[k], len(self.links[k]), queries, at, 1)[0].astype(np.int64)
        return at

    def _insert(self, level: int, s: int, e: int) -> None:
        links, new = self.links[level], self.vectors[s:e]
        ids, sims = np.zeros((e - s, 0), np.int32), np.zeros((e - s, 0), np.float32)
        if s:
            entries = np.minimum(self._entries(new, level), s - 1)
            ids, sims = beam_search(self.vectors, links, s, new, entries, min(BUILD_BEAM, s))
        within = new @ new.T
        np.fill_diagonal(within, -np.inf)
        k = min(BUILD_BEAM, e - s)
        near = np.argpartition(-within, k - 1, axis=1)[:, :k]
        sims = np.concatenate([sims, np.take_along_axis(within, near, 1)], 1)
        ids = np.concatenate([ids, (near + s).astype(np.int32)], 1)
        sims, ids, _ = _top(sims, ids, ids, min(BUILD_BEAM, ids.shape[1]))
        own = np.arange(s, e)
        links[s:e] = _diverse(self.vectors, own, ids, sims, links.shape[1])
        self._link_back(links, own)

    def _link_back(self, links: np.ndarray, own: np.ndarray) -> None:
        to, of = links[own].ravel(), np.repeat(own, links.shape[1])
        to, of = to[to >= 0], of[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        more = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32)
        row = np.repeat(np.arange(len(nodes)), count)
        more[row, np.arange(len(to)) - first[row]] = of
        old = links[nodes]
        more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        both = np.concatenate([old, more], 1)
        for s in range(0, len(nodes), BATCH):
            ids, own_ = both[s : s + BATCH], nodes[s : s + BATCH]
            sims = np.where(ids >= 0, np.einsum("nd,nkd->nk", self.vectors[own_], self.vectors[np.maximum(ids, 0)]), -np.inf).astype(np.float32)
            sims, ids, _ = _top(sims, ids, ids, ids.shape[1])
            used = int((ids >= 0).sum(axis=1).max(initial=1))
            links[own_] = _diverse(self.vectors, own_, ids[:, :used], sims[:, :used], links.shape[1])

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the nodes in each query's beam on the lowest level."""
        parts = []
        for s in range(0, len(queries), BATCH):
            q = queries[s : s + BATCH]
            parts.append(beam_search(self.vectors, self.links[0], len(self.vectors), q, self._entries(q, 0), min(width, len(self.vectors))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
