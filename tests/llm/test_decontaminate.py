import hashlib
import random
import re

from pyspark.sql import functions as F

from arbora.llm import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    return WORD.findall(raw)


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, s in items:
            q = words(s)
            n = min(10, len(q))
            for k in range(len(q) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[k : k + n]:
                        hit |= set(range(p, p + n))
                        ids.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    vocab = [f"V{i}é" if i % 5 == 0 else f"v{i}" for i in range(40)]
    text = lambda n: r.choice([" ", "-", ", "]).join(r.choice(vocab) for _ in range(n))
    items = [(k, text(r.choice([0, 1, 4, 12, 30]))) for k in range(20)] + [(20, None), (None, text(15)), (3, text(14))]
    docs = []
    for d in range(80):
        t = text(r.randint(0, 40))
        for _ in range(r.randint(0, 2)):
            s = (r.choice(items)[1] or "").upper()
            t += " " + s + " " + text(r.randint(0, 20))
        docs.append((d, t))
    docs += [(80, None), (81, ""), (80, docs[0][1]), (None, docs[1][1]), (82, "!!!"), (82, None)]
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, items)
    assert sorted((tuple(x) for x in decontaminate.contamination(a, b).collect()), key=str) == want
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 500)
    assert sorted((tuple(x) for x in decontaminate.contamination(a.repartition(3), b).collect()), key=str) == want


def test_empty_tables(spark):
    a, b = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], ITEMS)
    assert [tuple(r)[:4] for r in decontaminate.contamination(a, b).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.contamination(a.limit(0), b).count() == 0


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(10))
    docs = [(1, "x " + item), (2, item.replace("t4 t5", "t4 z t5")), (3, item.replace("t4 t5", "t4 z z z t5"))]
    index = decontaminate.build_index(spark.createDataFrame(docs, DOCS))
    items = spark.createDataFrame([(7, item)], ITEMS)
    assert {r.doc_id for r in decontaminate.matches(index, items).collect()} == {1}
    assert {r.doc_id for r in decontaminate.matches(index, items, slop=1).collect()} == {1, 2}


def test_documents_without_words_hide_no_hit(spark):
    """Rows of a block come in any order: a text after empty ones is found whichever row is first."""
    item = " ".join(f"t{i}" for i in range(12))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = [(1, ""), (2, f"x {item} y"), (3, None), (4, "..."), (5, item)]
    for order in (rows, rows[::-1], [rows[1], rows[0], rows[4], rows[3], rows[2]]):
        docs = spark.createDataFrame(order, "doc_id long, text string").coalesce(1)
        index = decontaminate.build_index(docs)
        shuffled = index.orderBy(F.desc("n_words"), F.desc("doc_id"))
        found = decontaminate.matches(shuffled, items).where("size(words) > 0")
        assert sorted((r.doc_id, len(r.words)) for r in found.collect()) == [(2, 12), (5, 12)]
        got = {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()}
        assert got == {1: 0, 2: 12, 3: 0, 4: 0, 5: 12}


def test_long_text_and_clashing_columns(spark):
    item = " ".join(f"t{i}" for i in range(15))
    long = " ".join(f"w{k}" for k in range(150_000)) + f" {item} tail"
    rows, items = [(1, long), (2, item + " x"), (2, item + " x"), (3, None)], [(5, item), (5, "short one"), (6, None)]
    docs = spark.createDataFrame([(*r, 1, 2, "b") for r in rows], DOCS + ", block long, first long, places string")
    tests = spark.createDataFrame([(*r, "q", 3) for r in items], ITEMS + ", item string, term long")
    assert sorted((tuple(x) for x in decontaminate.contamination(docs, tests).collect()), key=str) == brute(rows, items)


def test_index_serves_later_searches(spark, tmp_path):
    item = " ".join(f"t{i}" for i in range(12))
    path = f"file://{tmp_path}/index"
    decontaminate.build_index(spark.createDataFrame([(1, f"a {item}"), (2, "b")], DOCS), path)
    index = decontaminate.open_index(spark, path)
    for k in (3, 4):
        found = decontaminate.matches(index, spark.createDataFrame([(k, item)], ITEMS)).where("size(words) > 0").collect()
        assert [(r.doc_id, list(r["items"])) for r in found] == [(1, [str(k)])]
