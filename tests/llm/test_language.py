import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

from arbora.llm import language

SCHEMA = "doc_id long, text string, lang string"
LETTERS = {"en": "the of and ing tion", "de": "der und sch ung ß ü", "fr": "le que eau é ê ou"}


def corpus(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for d in range(n):
        lang = r.choice(list(LETTERS))
        parts = LETTERS[lang].split()
        rows.append((d, " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(2, 40))), lang))
    return rows


def test_held_out_accuracy_and_fold(spark):
    rows = corpus()
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in rows)
    held = [(got[d].lang_pred == lang) for d, _, lang in rows if got[d].held_out]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = corpus(60) + [(1000, None, "en"), (1001, "", "en"), (1002, "123 !? ´", "fr"), (None, "the and", None), (1003, "x" * 300000, None), (1003, "und sch", "de")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(rows)
    assert {(d, x, s) for d, x, s in got if d in (1000, 1001, 1002)} == {(1000, "und", 0.0), (1001, "und", 0.0), (1002, "und", 0.0)}
    assert all(x in LETTERS for d, x, _ in got if d is None)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], SCHEMA)
    assert [tuple(r) for r in language.identify(df).collect()] == [(1, False, "und", 0.0)]
    assert language.identify(df.limit(0)).count() == 0


def test_prediction_depends_on_own_text_only(spark):
    rows = corpus(80)
    model = language.train(spark.createDataFrame(rows, SCHEMA))
    texts = [t for _, t, _ in rows]
    whole, _ = model.scores(texts)
    for k in (0, 5, 79):
        alone, _ = model.scores([texts[k]])
        assert abs(alone[0] - whole[k]).max() < 1e-6


def test_features_by_hand():
    g = language.Grams(["Ab  !c", "", "  d"])
    assert list(g.hi - g.lo) == [4, 0, 1]
    assert list(g.known) == [True, False, True]


def grams(text):
    """Hashed 1-, 2- and 3-grams of a text, one at a time."""
    chars = []
    for c in text.lower():
        if unicodedata.category(c)[0] in "LM":
            chars.append(ord(c))
        elif chars and chars[-1] != 32:
            chars.append(32)
    step, out = 0x9E3779B97F4A7C15, []
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            h = 0
            for c in chars[i : i + n]:
                h = (h * step + c + 1) % 2**64
            x = (h + n - 1) * step % 2**64
            x ^= x >> 29
            out.append((n, (x * step % 2**64) >> 48))
    return out


def test_posterior_equals_direct_counts(spark):
    rows = corpus(120, seed=6) + [(500, "Überall, 12 Straßen!", "de"), (501, "  l'été où ", "fr"), (502, "x", None)]
    trained = [(t, lang) for d, t, lang in rows if lang and zlib.crc32(str(d).encode()) % 4 != 2]
    counts, docs = defaultdict(Counter), Counter()
    for t, lang in trained:
        docs[lang] += 1
        counts[lang].update(f for _, f in grams(t))
    size = 1 << language.FEATURE_BITS

    def joint(text, lang):
        total = sum(counts[lang].values()) + language.ALPHA * size
        prior = math.log((docs[lang] + 1) / (sum(docs.values()) + len(docs)))
        return prior + sum(math.log((counts[lang][f] + language.ALPHA) / total) for _, f in grams(text))

    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, t, _ in rows:
        x = {lang: joint(t, lang) for lang in sorted(docs)}
        best = max(x, key=x.get)
        assert got[d].lang_pred == best
        assert abs(got[d].score - 1 / sum(math.exp(v - x[best]) for v in x.values())) < 1e-3


def test_quota_and_small_languages(spark):
    assert language.quota([5, 100, 1000], 65) == 30 and language.quota([5, 6], 100) == 6 and language.quota([], 9) == 1
    r = random.Random(3)
    rows = [(k, "der und sch", "de") for k in range(3000)] + [(5000 + k, "the of " + r.choice("abc"), "en") for k in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.train(df, 200)
    # copies of one text are chosen one by one, and the small language is used whole
    assert model.languages == ["de", "en"]
    assert language.train(df.limit(0)).languages == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "the of and", "en", True, "x", 0.5), (2, None, "de", False, "y", 0.1)], SCHEMA + ", held_out boolean, lang_pred string, score double")
    assert sorted((r.doc_id, r.lang_pred) for r in language.identify(df).collect())[1] == (2, "und")
