import hashlib
import random

import pytest
from pyspark.sql import types as T

from arbora.llm import substring

SCHEMA = "doc_id long, text string"


def brute(rows):
    seen = {}
    words = {}
    for k, (d, t) in enumerate(rows):
        words[k] = (t or "").encode().split()
        key = float("inf") if d is None else d
        for i in range(len(words[k]) - 12):
            w = tuple(words[k][i : i + 13])
            seen[w] = min(seen.get(w, float("inf")), key)
    out = []
    for k, (d, t) in enumerate(rows):
        w, key = words[k], float("inf") if d is None else d
        gone = set()
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < key:
                gone |= set(range(i, i + 13))
        rest = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(rest)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passages = [[r.choice(vocab) for _ in range(r.randint(8, 40))] for _ in range(8)]
    rows = []
    for d in range(n):
        t = []
        for _ in range(r.randint(0, 5)):
            t += [r.choice(vocab) for _ in range(r.randint(0, 15))]
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            t += p[a : a + r.randint(1, 40)]
        rows.append((d * 3, r.choice([" ", "  ", "\n", "\t "]).join(t)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    rows += [(rows[5][0] + 1, rows[5][1]), (None, rows[7][1]), (rows[3][0], rows[4][1]), (9999, None), (10000, ""), (10001, "é " * 30 + "ü"), (10002, "é " * 40)]
    assert rows_of(substring.substring_digests(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_small_chunks_and_text(spark, monkeypatch):
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.doc_id: r.kept_text for r in substring.substring_dedup(df).collect()}
    want = {d: h for d, _, _, h in brute(rows)}
    assert {d: hashlib.sha256(t.encode()).hexdigest() for d, t in got.items()} == want


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring.substring_digests(empty).count() == 0
    rows = [(1, "a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m n"), (2, "x a b c d e f g h i j k l m n")]
    wide = spark.createDataFrame([(*r, 1, "k", "p") for r in rows], T._parse_datatype_string(SCHEMA + ", row int, known_row string, places string"))
    assert rows_of(substring.substring_digests(wide)) == brute(rows)


def test_long_text(spark):
    long = " ".join(f"w{k}" for k in range(150_000))
    rows = [(1, long), (2, "x " + long[500:400_000] + " y"), (3, "a b c")]
    assert rows_of(substring.substring_digests(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
