import itertools
import random

import numpy as np

from arbora.llm import interaction, transducer

DOCS = "doc_id long, text string, source string, n_words int, good int"
LABELS = "doc_id long, quality int, toxic int, text string"
SPACE = " \t\n\v\f\r"


def words(t):
    for c in SPACE[1:]:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def counts(t):
    w = words(t)
    return len(w), len(set(w)), sum("A" <= c <= "Z" for c in t), len(t), sum(c in interaction.SYMBOLS for c in t)


def brute(docs, labels):
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    rows = []
    for i, t, s, *_ in docs:
        t = t or ""
        n, d, cap, pts, sym = counts(t)
        copied = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in docs)
        rows.append((s or "", [n < 50, 100 * d < 65 * n, 100 * cap > 5 * pts, sym > 0, copied], i is not None and i in good, i is not None and i in toxic))
    out = set()
    for part in {r[0] for r in rows}:
        mine, total = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                k = "ABCDE".index(x)
                gone = [r for r in left if r[1][k]]
                left = [r for r in left if not r[1][k]]
                total[x] += len(gone)
                failing = [r for r in mine if r[1][k]]
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(sum(r[1]) == 1 for r in failing), sum(r[2] for r in gone), sum(r[3] for r in gone)))
        out |= {(*r, total[r[1][r[2] - 1]]) for r in found}
    return out


def fixture():
    r = random.Random(4)
    vocabulary = ["word", "Word", "WORD", "é", "日本", "a#b", "50%", "x" * 9, "y" * 70, "y" * 69 + "z", " ", " q", "\0n", "b|"]
    texts = ["", None, " \t\n", "A", "é" * 5, "one\x1cword\x85too", " ".join(["same"] * 80), "".join(chr(97 + i % 26) for i in range(5000))]
    texts += [r.choice(SPACE).join(r.choice(vocabulary[: r.randint(2, 14)]) for _ in range(r.randint(1, 130))) for _ in range(60)]
    texts += [" ".join(f"w{i}" for i in range(n)) + end for n in (49, 50, 51) for end in ("", " &", " AAAAAAAAAAAAAAAAAA")]
    docs = [(i - 5, t, r.choice(["web", "wiki", "", None])) for i, t in enumerate(texts)]
    docs += [(i + 100, r.choice(texts[:12]), "copies") for i in range(40)] + [(None, "", "web"), (None, "", "web"), (3, "twice the id", "web"), (3, "twice the id", "wiki"), (200, "twice the id", None)]
    docs = [(*d, 1, 7) for d in docs]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for i in range(-5, 160) if i % 3] + [(4, 1, 0, None), (4, 0, 1, None), (None, 1, 1, "x")]
    return docs, labels


def test_equals_brute_force(spark):
    docs, labels = fixture()
    got = interaction.interaction_audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in got.collect()]
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, labels)


def test_facts_equal_direct_counts(spark):
    docs, _ = fixture()
    got = interaction.facts(spark.createDataFrame(docs, DOCS)).drop("digest").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, s or "", *counts(t or "")) for i, t, s, *_ in docs), key=repr)


def test_empty_tables(spark):
    none, nothing = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert interaction.interaction_audit(none, nothing).count() == 0
    rows = interaction.interaction_audit(spark.createDataFrame([(1, None, None, 1, 1)], DOCS), nothing).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.removed for r in rows) == 120


def test_hash_table_compares_bytes():
    texts = [b"aa bb aa cc bb", b"aa", b"x" * 1000 + b" " + b"x" * 999 + b"y " + b"x" * 1000]
    seen = transducer.Pass(texts, transducer.byte_classes("#"))
    doc = np.repeat(np.arange(3), seen.n_words)
    for hashes in (None, np.zeros(len(seen.starts), np.uint64), np.full(len(seen.starts), 2**64 - 1, np.uint64)):
        first = transducer.distinct(seen.data, seen.starts, seen.ends, doc, hashes)
        assert np.bincount(doc[first]).tolist() == [3, 1, 2] == seen.n_distinct.tolist()


def test_tables_say_what_a_byte_by_byte_run_says():
    r = random.Random(1)
    classes = transducer.byte_classes(interaction.SYMBOLS)
    texts = ["".join(r.choice("aB# \n\té日\U0001f600$") for _ in range(r.randint(0, 40))).encode() for _ in range(200)]
    seen = transducer.Pass(texts, classes)
    for i, t in enumerate(texts):
        state, n = transducer.OUTSIDE, dict.fromkeys((transducer.STARTS, transducer.ENDS, transducer.POINT, transducer.CAP, transducer.SYM), 0)
        for k in [*classes[list(t)], transducer.END]:
            for mark in n:
                n[mark] += bool(transducer.OUTPUT[state, k] & mark)
            state = transducer.NEXT[state, k]
        assert (n[transducer.STARTS], n[transducer.CAP], n[transducer.POINT], n[transducer.SYM]) == (seen.n_words[i], seen.n_capitals[i], seen.n_points[i], seen.n_symbols[i])
        assert n[transducer.STARTS] == n[transducer.ENDS]
