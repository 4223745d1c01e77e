import hashlib
import random

import numpy as np
import pytest

from arbora.llm import suffix

SCHEMA = "doc_id long, text string"


def brute(rows):
    count = {}
    texts = [(t or "").encode() for _, t in rows]
    for t in texts:
        for i in range(len(t) - 199):
            w = t[i : i + 200]
            count[w] = count.get(w, 0) + 1
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        rest = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=40):
    r = random.Random(seed)
    letters = "ab éc" if seed % 2 else "abcdefghijklmnopqrstuvwxyz   "
    passages = ["".join(r.choice(letters) for _ in range(r.randint(150, 900))) for _ in range(6)]
    rows = []
    for d in range(n):
        t = ""
        for _ in range(r.randint(0, 4)):
            t += "".join(r.choice(letters) for _ in range(r.randint(0, 120)))
            p = r.choice(passages)
            a = r.randint(0, 100)
            t += p[a : a + r.randint(100, 800)]
            if r.random() < 0.3 and t:  # a changed letter in a copy
                k = r.randrange(len(t))
                t = t[:k] + "#" + t[k + 1 :]
        rows.append((d, t))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    rows += [(100, None), (101, ""), (102, "z" * 1500), (103, "xy" * 350), (None, rows[1][1]), (5, rows[5][1]), (104, "q" * 199), (105, "k" * 200), (106, "k" * 200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted((tuple(r) for r in suffix.dedup_digests(df).collect()), key=str) == brute(rows)


def test_external_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = rng.integers(97, 99, (60, suffix.CONTEXT)).astype(np.uint8)
    base[30:, 50:300] = base[:30, 50:300]
    lo, hi = np.zeros(60, int), np.full(60, suffix.CONTEXT)
    lo[3], hi[7] = 60, 240
    inside = suffix.repeated_starts(((j, base[:, j]) for j in reversed(range(suffix.CONTEXT))), lo, hi)
    with suffix.Columns(f"file://{tmp_path}/spool") as c:
        for k in range(0, 60, 7):
            c.add(np.ascontiguousarray(base[k : k + 7].T))
        assert len(list((tmp_path / "spool").iterdir())) == 1
        assert (suffix.repeated_starts(c.backwards(), lo, hi) == inside).all()
    assert not list((tmp_path / "spool").iterdir())
    want = np.zeros((60, suffix.STARTS), bool)
    for j in range(suffix.STARTS):
        seen = {}
        for i in range(60):
            if lo[i] <= j and j + 200 <= hi[i]:
                seen.setdefault(base[i, j : j + 200].tobytes(), []).append(i)
        for v in seen.values():
            want[v, j] = len(v) > 1
    assert (np.unpackbits(inside, axis=1, bitorder="little")[:, : suffix.STARTS].astype(bool) == want).all()


def test_text_and_empty(spark):
    p = "0123456789" * 3 + "passage that is long enough " * 9
    got = {r.doc_id: r.kept_text for r in suffix.dedup_bytes(spark.createDataFrame([(1, "head " + p), (2, p + " tail")], SCHEMA)).collect()}
    assert got == {1: "head ", 2: " tail"}
    assert suffix.dedup_digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_text_and_clashing_columns(spark):
    p = "".join(chr(97 + k * k % 26) for k in range(3000))
    rows = [(1, "x" * 40 + p * 60, 5, "a", b"b", 1), (2, p[100:900], 6, "c", b"d", 2), (3, "short", 7, "e", b"f", 3), (3, "short", 7, "e", b"f", 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", row long, whole string, parts binary, bucket int")
    assert sorted((tuple(r) for r in suffix.dedup_digests(df).collect()), key=str) == brute([r[:2] for r in rows])
