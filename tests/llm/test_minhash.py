import random

import numpy as np

from arbora.llm import minhash

SCHEMA = "doc_id long, text string"


def sets(rows):
    out = []
    for _, t in rows:
        raw = (t or "").encode()
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def brute(rows):
    s = sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 10**18), d)
    return sorted((d, len(s[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"W{i}" for i in range(300)]
    rows, d = [], 0
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.randint(1, 200))]
        for _ in range(r.randint(1, 9)):
            t = list(base)
            for _ in range(r.randint(0, 1 + len(t) // 40)):
                t[r.randrange(len(t))] = r.choice(vocab)
            rows.append((d, r.choice([" ", "\n"]).join(x.lower() if r.random() < 0.5 else x for x in t)))
            d += r.randint(1, 3)
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in range(2):
        rows = corpus(seed) + [(9001, None), (9002, ""), (9003, "a b"), (9004, "A  b"), (9005, " \n ")]
        got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
        assert got == brute(rows)


def test_chain_through_one_bucket(spark):
    """Links that the star of a bucket does not show are found afterwards."""
    base = [f"v{i}" for i in range(60)]
    rows = []
    for k in range(14):  # each is near the next one, far ones are not linked directly
        t = list(base)
        for i in range(0, 3 * k, 3):
            t[i % 60] = f"x{i}"
        rows.append((100 - k, " ".join(t)))
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows)


def test_empty_table_and_nulls(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (None, None), (5, "a b c d e f")]
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (None, 0, None, True)], key=str)


def test_signature_estimate():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.sort(x[:3000]), np.sort(x[1000:])  # similarity 0.5
    pa_, pb = minhash.pack(minhash.minima(a)), minhash.pack(minhash.minima(b))
    d = pa_ ^ pb
    m = 256 - sum(bin(int((v | v >> np.uint64(1)) & np.uint64(0x5555555555555555))).count("1") for v in d)
    assert abs((m / 256 - 0.25) / 0.75 - 0.5) < 0.2


def test_long_text_and_clashing_columns(spark):
    long = " ".join(f"w{k * k % 9973}" for k in range(120_000))
    rows = [(1, long), (2, long + " more words at the end"), (3, "other words that are not in it at all"), (4, long[:2000])]
    df = spark.createDataFrame([(*r, 9, 8, "s", 7) for r in rows], SCHEMA + ", row long, id long, sig string, node long")
    assert sorted(tuple(r) for r in minhash.near_duplicates(df).collect()) == brute(rows)
