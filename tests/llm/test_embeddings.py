import numpy as np
import pytest

from arbora.llm import embeddings, hnsw

SCHEMA = "vec_id long, embedding array<double>, label int, n_links int, kept string"


def brute(rows, link=0.93):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    good = [i for i, r in enumerate(rows) if usable(r)]
    units = {}
    for i in good:
        x = np.array(rows[i][1], np.float64)
        x = x / np.abs(x).max()
        units[i] = x / np.sqrt((x * x).sum())
    near = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and units[i] @ units[j] >= link:
                near[i].add(j)
    out = []
    for i, r in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        least = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((r[0], len(near[i]), least, r[0] == least))
    return sorted(out, key=repr)


def turned(r, x, cosine):
    y = r.normal(size=x.shape)
    y -= (y @ x) / (x @ x) * x
    return cosine * x / np.sqrt(x @ x) + np.sqrt(1 - cosine**2) * y / np.sqrt(y @ y)


def fixture(n=260, dim=16):
    r = np.random.default_rng(3)
    base = [r.normal(size=dim) for _ in range(n)]
    labels = [int(x) for x in r.choice([1, 1, 1, 2, 3], n)]
    vectors = list(zip(base, labels))
    vectors += [(turned(r, base[i], c), labels[i]) for i in range(0, 60) for c in (0.99, 0.94, 0.92)]
    vectors += [(turned(r, base[7], 0.985), labels[7]) for _ in range(120)]  # a group larger than a beam
    chain = base[100]
    for _ in range(8):
        chain = turned(r, chain, 0.95)
        vectors.append((chain, labels[100]))
    vectors += [(base[i] * s, labels[i]) for i in range(9) for s in (1, 3.5, 1e200, 1e-200, -1)] + [(base[0], 9)]
    rows = [(int(i), v.tolist(), lab) for i, (v, lab) in zip(r.permutation(len(vectors)), vectors)]
    rows += [rows[0]] * 3 + [(-1, rows[5][1], rows[5][2]), (2, rows[9][1], rows[9][2])]
    rows += [(9000, None, 1), (9001, [], 1), (9002, [0.0] * dim, 1), (9003, [float("nan")] * dim, 1), (9004, [None, *rows[0][1][1:]], 1), (9005, [float("inf"), *rows[0][1][1:]], 1)]
    rows += [(9006, rows[0][1], None), (None, rows[0][1], rows[0][2]), (9007, rows[0][1][:5], rows[0][2]), (9008, [0.0, *[-0.0] * (dim - 1)], 1), (9009, [1.0] * 3, 7)]
    return [(*x, 5, "x") for x in rows]


@pytest.mark.parametrize("shard", [8192, 40])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    rows = fixture()
    got = embeddings.near_embeddings(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    found, want = sorted(map(tuple, got.collect()), key=repr), brute(rows)
    unnamed = [x for x in want if x[0] is None]
    assert [x for x in found if x[0] is not None] == [x for x in want if x[0] is not None]
    assert [x[:3] for x in found if x[0] is None] == [x[:3] for x in unnamed]


def test_empty_and_unlabelled(spark):
    assert embeddings.near_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = embeddings.near_embeddings(spark.createDataFrame([(5, [1.0], None, 1, "x"), (4, None, 1, 1, "x")], SCHEMA)).collect()
    assert sorted(map(tuple, rows)) == [(4, 0, 4, True), (5, 0, 5, True)]


def test_graph_finds_links_at_the_limit():
    r = np.random.default_rng(1)
    v = r.normal(size=(3000, 48))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.Graph.build(v.astype(np.float32))
    assert [len(x) for x in graph.links] == hnsw.level_sizes(3000)
    beam = embeddings._audited_beam(graph, 0.93, 0.99)
    asked = np.stack([turned(r, x, 0.931) for x in v])
    q, t = map(np.concatenate, zip(*embeddings._links(asked, v, graph, beam, 0.93, False)))
    truth = asked @ v.T >= 0.93
    assert truth[q, t].all() and len(q) >= 0.98 * truth.sum()
    # every node is reached by its own vector
    assert (graph.search(v.astype(np.float32), beam)[0] == np.arange(3000)[:, None]).any(axis=1).mean() > 0.99


def test_audit_widens_beams_of_a_broken_graph():
    r = np.random.default_rng(2)
    v = r.normal(size=(600, 24))
    v /= np.linalg.norm(v, axis=1)[:, None]
    graph = hnsw.Graph.build(v.astype(np.float32))
    graph.links[0][:, 2:] = -1
    beam = embeddings._audited_beam(graph, 0.93, 0.99)
    assert beam > embeddings.BEAM
    graph.links[0][:] = -1
    assert embeddings._audited_beam(graph, 0.93, 0.99) == 600


def test_dense_groups_are_counted_whole():
    r = np.random.default_rng(5)
    centre = r.normal(size=32)
    v = np.stack([turned(r, centre, 0.98) for _ in range(500)] + [x / np.linalg.norm(x) for x in r.normal(size=(700, 32))])
    v = v[r.permutation(len(v))]
    graph = hnsw.Graph.build(v.astype(np.float32))
    truth = v @ v.T >= 0.93
    q, t = map(np.concatenate, zip(*embeddings._links(v, v, graph, 16, 0.93, True)))
    assert len(q) == (truth.sum() - len(v)) // 2 and len(set(zip(np.minimum(q, t), np.maximum(q, t)))) == len(q)
