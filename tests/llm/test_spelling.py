import random
import re
import zlib
from collections import Counter

import pytest

from arbora.llm import fmindex, spelling

SCHEMA = "doc_id long, text string, word string, n int"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    lower = str.maketrans(spelling._UPPER, spelling._LOWER)
    n = Counter()
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def corpus():
    r = random.Random(8)
    words = ["".join(r.choice("abÀéÿ×"[: r.randint(1, 6)]) for _ in range(r.randint(3, 8))) for _ in range(250)] + ["theatre", "Theater", "theaters", "aaaaa", "aaaaaa", "aaaaaaa", "ab" * 3000, "ab" * 3000 + "a"]
    weight = [r.choice([1, 2, 5, 40]) for _ in words]
    docs = [(i - 3, r.choice([" ", "\n", ", ", "7"]).join(r.choices(words, weight, k=r.randint(0, 120))), "x", 1) for i in range(60)]
    docs += [(70 + k, word, "x", 1) for word, n in (("stonexy", 3), ("stonex", 9), ("stone", 30)) for k in range(n)]
    return docs + [(None, "theatre theatre theatre theatre", "x", 2), (100, None, None, 0), (101, "", None, 0), (102, "... 12 Āİ", None, 0)] + docs[:3] * 2


@pytest.mark.parametrize("shard,queries", [(1 << 15, 1 << 18), (20, 7)])
def test_equals_brute_force(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "QUERIES", queries)
    docs = corpus()
    got = spelling.variants(spark.createDataFrame(docs, SCHEMA).repartition(4))
    rows = [tuple(r) for r in got.collect()]
    want = brute(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[2] not in (r[0], r[1]) for r in want), "the fixture has a chain of forms"


def test_empty(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "a", 1), (2, "a b c", "a", 1)], SCHEMA)).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abc", "abcdefé日\U0001f600"])
def test_index_finds_all_and_only_words_one_edit_away(alphabet):
    r = random.Random(len(alphabet))
    for _ in range(25):
        words = sorted({"".join(r.choice(alphabet) for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 120))})
        asked = ["".join(r.choice(alphabet + "z") for _ in range(r.randint(2, 9))) for _ in range(30)] + [w for w in words if len(w) > 1]
        index = fmindex.Index(words)
        found = set().union(*(set(zip(*(x.tolist() for x in index.near(asked, half)))) for half in (True, False)))
        assert found == {(i, j) for i, a in enumerate(asked) for j, w in enumerate(words) if one_edit(a, w)}


def test_each_search_keeps_its_half():
    words = sorted({"".join(w) for w in zip("abcdefgh", "bcdefghi", "aaaaaaaa", "cccccccc", "dddddddd", "eeeeeeee")})
    asked = ["abacdx", "xbacde", "abxcde"]
    index = fmindex.Index(words)
    pairs = lambda half: {(asked[i], words[j]) for i, j in zip(*index.near(asked, half))}
    assert pairs(True) == {("abacdx", "abacde")}
    assert pairs(False) == {("xbacde", "abacde"), ("abxcde", "abacde")}
