import itertools
import json
import random

import pytest

from arbora.functions import scalars, tags
from arbora.operators import decode, evaluation, features, grammar, scoring, segment, trees
from arbora.sources import treebank
from pyspark.sql import functions as F

TOKENS = "sent_id long, tok_id int, word string, pos string, role string, head int"
#: 1: the dog saw a big cat; heads as in the comment column.
ROWS = [
    (1, 1, "the", "det", "det", 2),
    (1, 2, "dog", "ncn", "subj", 3),
    (1, 3, "saw", "vt", "root", 0),
    (1, 4, "a", "det", "det", 6),
    (1, 5, "big", "adj", "modr", 6),
    (1, 6, "cat", "ncn", "dobj", 3),
    (2, 1, "go", "vi", "root", 0),
]


@pytest.fixture(scope="module")
def toks(spark):
    return spark.createDataFrame(ROWS, TOKENS)


def values(spark, column, data):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(data)], "i int, x string").orderBy("i").select(column).collect()]


def test_scalars(spark):
    x = F.col("x")
    assert values(spark, scalars.simplify_pos(x), ["ncn", "vt", "prel", "advm3"]) == ["N", "V", "PREL", "ADVM"]
    assert values(spark, scalars.role_class(x), ["subj", "modp/x", "zzz"]) == ["complement", "adjunct", "unknown"]
    assert values(spark, scalars.decode_punc(scalars.encode_punc(x)), [",", "(", "a"]) == [",", "(", "a"]
    numbers = ["1", "1.", ".5", "1e5", "-3", "1_0", "nan", "1d", "1f", "", ".", "a", "1 2"]

    def is_float(s):
        try:
            float(s)
        except ValueError:
            return False
        return True

    assert values(spark, x.rlike(scalars.NUMBER), numbers) == [is_float(s) for s in numbers]
    assert len(tags.TAGS) == 51 and len(tags.COMPLEMENTS) == 13 and len(tags.ADJUNCTS) == 18


def test_thai_clusters_and_scripts(spark):
    x = F.col("x")
    # a cluster may not end the text, so the last pair is cut
    assert values(spark, scalars.char_clusters(x), ["กาก", "กา", "เกาะa", "ab"]) == [["กา", "ก"], ["ก", "า"], ["เก", "าะ"[0], "ะ", "a"], ["a", "b"]]
    assert values(spark, scalars.split_scripts(x), ["abกขc", "ก"]) == [["ab", "กข", "c"], ["ก"]]
    assert values(spark, scalars.is_number(x), ["1", "๓", ",", "1,2"]) == [True, True, False, True]
    assert values(spark, scalars.is_thai_word(x), ["กา", "a", "ก a"]) == [True, False, False]


def test_treebank_round_trip(spark, toks, tmp_path):
    path = f"file://{tmp_path}/t"
    treebank.write_treebank(toks.coalesce(1), path)
    back = trees.tokens(treebank.read_treebank(spark, path))
    strip = lambda rows: sorted(tuple(r)[1:] for r in rows)
    assert strip(back.select("sent_id", "tok_id", "word", "pos", "role", "head").collect()) == strip(toks.collect())
    (tmp_path / "three").write_text("a\tb\nx\ty\n2\t0\n\n\n\nc\nz\n0")
    three = treebank.read_treebank(spark, f"file://{tmp_path}/three").collect()
    assert sorted((r.words, r.roles, r.heads) for r in three) == [(["a", "b"], None, [2, 0]), (["c"], None, [0])]


def test_json_round_trip(toks):
    back = treebank.read_json_trees(treebank.to_json_tree(toks))
    assert sorted(map(tuple, back.select("sent_id", "tok_id", "word", "pos", "role", "head").collect())) == sorted(map(tuple, toks.collect()))
    tree = json.loads(treebank.to_json_tree(toks).where("sent_id = 1").first().tree)
    assert tree[0]["stree"] == [[6, 3]] and len(tree[0]["children"]) == 2


def test_tagged_and_lexicon(spark):
    x = F.col("x")
    assert values(spark, F.to_json(treebank.read_tagged(x)), ["a/b/N c/V"]) == ['[{"word":"a/b","pos":"N"},{"word":"c","pos":"V"}]']
    assert values(spark, F.to_json(treebank.read_tagged(x, "pairs")), ["a N c V"]) == ['[{"word":"a","pos":"N"},{"word":"c","pos":"V"}]']
    lines = spark.createDataFrame([("dog ncn vt",), ("กา ncn",), ("dog adj",)], "value string")
    assert {(r.word, *r.tags) for r in grammar.merge_lexicon(treebank.parse_lexicon(lines)).collect()} == {("dog", "adj", "ncn", "vt"), ("กา", "ncn")}


def test_grammar_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([("1:vt", "[vt] --> [ncn@subj]", 0.25), ("1:vt", "[vt] --> [ncn@dobj]", 0.75)], "key string, rule string, p double")
    orders = spark.createDataFrame([("1:[vt] --> [ncn@subj]", "0 --> -1", 1.0, 4, [7, 9])], "key string, word_order string, p double, id long, trees array<long>")
    treebank.write_grammar(rules, orders, f"file://{tmp_path}/g")
    got = {(r.section, r.key, r.outcome, r.p, r.id, tuple(r.trees or ())) for r in treebank.read_grammar(spark, f"file://{tmp_path}/g").collect()}
    assert got == {("m", "1:vt", "[vt] --> [ncn@subj]", 0.25, None, ()), ("m", "1:vt", "[vt] --> [ncn@dobj]", 0.75, None, ()), ("i", "1:[vt] --> [ncn@subj]", "0 --> -1", 1.0, 4, (7, 9))}


def test_blanks_and_spans(spark):
    rows = [(1, 1, "_", "x", "r", 3), (1, 2, "_", "x", "r", 3), (1, 3, "go", "x", "r", 0), (1, 4, "_", "x", "r", 3), (1, 5, "on", "x", "r", 4)]
    got = sorted(map(tuple, trees.drop_blank_tokens(spark.createDataFrame(rows, TOKENS)).collect()))
    assert [(r[1], r[2], r[5]) for r in got] == [(1, "go", 0), (2, "_", 1), (3, "on", 2)]


def test_subtrees_and_siblings(toks):
    spans = {(r.tok_id, r.span_start, r.span_end) for r in trees.subtree_span(toks).where("sent_id = 1").collect()}
    assert spans == {(1, 1, 1), (2, 1, 2), (3, 1, 6), (4, 4, 4), (5, 5, 5), (6, 4, 6)}
    s = {r.tok_id: r for r in trees.sibling_context(toks).where("sent_id = 1").collect()}
    assert s[2].right_word == "cat" and s[2].left_most and s[6].right_most and s[6].n_children == 2 and s[5].nearest_left and s[4].between_siblings


def test_arc_features_by_hand(toks):
    assert (len(features.MAXENT), len(features.LINEAR) + len(features.LINEAR_BETWEEN), len(features.LABEL)) == (184, 88, 46)
    c = features.arc_candidates(toks)
    assert c.where("sent_id = 1").count() == 6 * 7
    f = {(r.i, r.j, r.dir, r.label): r.features for r in features.maxent_arc_features(c.where("sent_id = 1")).collect()}
    x = f[3, 6, "R", "Yes"]  # saw -> cat
    for y in ("1-saw", "2-cat", "3-vt", "6-N", "7-saw/vt", "11-2", "12-R", "13-saw/2", "33-saw/2/R", "44-vt/ncn", "95-vt/det/adj/ncn", "175-vt/adj+det/ncn", "180-V/ADJ+DET/N"):
        assert y in x, y
    near = f[1, 2, "L", "Yes"]
    assert "95-det/-M-/-M-/ncn" in near and not [y for y in near if y.startswith("175-")]
    lin = {(r.i, r.j, r.dir): r.features for r in features.linear_arc_features(c.where("sent_id = 1 and label = 'Yes'")).collect()}[3, 6, "R"]
    assert {"0:saw", "10:saw/R/2", "21:vt/ncn", "84:vt/det/ncn", "84:vt/adj/ncn", "85:vt/adj/ncn/R/2", "86:V/ADJ/N"} <= set(lin)


def test_label_features_by_hand(toks):
    f = {r.tok_id: r.features for r in features.label_features(toks).where("sent_id = 1").collect()}
    assert set(f) == {1, 2, 4, 5, 6}
    assert {"1-dog/ncn/the/det/Yes/No/L", "9-ncn/det", "11-ncn/det/subj", "21-ncn/det/subj/adjunct", "31-det/No", "35-None/None/None/None", "39-Yes", "41-0"} <= set(f[1])


def test_rule_events_by_hand(toks):
    e = {(r.type, r.head_key, r.rule, r.word_order) for r in grammar.rule_events(toks).where("sent_id = 1").collect()}
    assert (1, "saw/vt", "saw[vt] --> [ncn@subj],[ncn@dobj]", "0 --> -1,1") in e
    assert (1, "vt", "[vt] --> [ncn@subj],[ncn@dobj]", "0 --> -1,1") in e
    assert (2, "det", "[ncn] --> [det@det]", "1 --> 0") in e and (2, "big/adj", "[ncn] --> big[adj@modr]", "1 --> 0") in e
    p = grammar.rule_probabilities(grammar.rule_events(toks)).groupBy("level", "type", "key").agg(F.sum("p").alias("s"))
    assert all(abs(r.s - 1) < 1e-9 for r in p.collect())
    ids = grammar.rule_events(toks).groupBy("type", "rule", "word_order").agg(F.min("tok_id").alias("id"))
    keys = {tuple(r.demand) for r in scoring.attach_keys(ids.where("not rule like 'saw%'")).collect()}
    assert ("subj:>-c-ncn-L", "dobj:>-c-ncn-R") in keys and ("det:<-a-ncn-R",) in keys


def projective(heads):
    n = len(heads)
    return all(not (min(i, h) < j < max(i, h)) or min(i, h) <= heads[j - 1] <= max(i, h) for i, h in enumerate(heads, 1) for j in range(1, n + 1) if j != i)


def is_tree(heads):
    for i in range(1, len(heads) + 1):
        seen = set()
        while i:
            if i in seen:
                return False
            seen.add(i)
            i = heads[i - 1]
    return heads.count(0) == 1


def test_decoder_equals_enumeration(spark):
    r = random.Random(1)
    rows, best = [], {}
    for s in range(12):
        n = r.randint(1, 5)
        score = {(h, c): float(r.randint(-9, 9)) for c in range(1, n + 1) for h in range(n + 1) if h != c}
        rows += [(s, h, c, v) for (h, c), v in score.items()]
        all_ = [sum(score[h, c] for c, h in enumerate(t, 1)) for t in itertools.product(range(n + 1), repeat=n) if all(h != c for c, h in enumerate(t, 1)) and is_tree(list(t)) and projective(list(t))]
        best[s] = sorted(all_, reverse=True)[:3]
    got = decode.decode_trees(spark.createDataFrame(rows, "sent_id long, head int, tok_id int, score double"), 3).select("sent_id", "rank", "tree_score").distinct().collect()
    for s, want in best.items():
        assert [x.tree_score for x in sorted((g for g in got if g.sent_id == s), key=lambda g: g.rank)] == want


def test_lattice_steps(spark):
    edges = [(1, 0, 2), (1, 2, 4), (1, 0, 1), (1, 3, 4), (1, 0, 4)]
    lat = spark.createDataFrame(edges, "doc_id long, s int, t int")
    n = spark.createDataFrame([(1, 4)], "doc_id long, n int")
    assert {(r.s, r.t) for r in segment.prune_lattice(lat, n).collect()} == {(0, 2), (2, 4), (0, 4)}
    w = lat.withColumn("is_word", F.col("t") != 4)
    got = segment.best_segmentation(segment.edge_weights(w), n, 2).orderBy("rank").collect()
    assert [(r.cost, r.nodes) for r in got] == [(2.5, [0, 4]), (3.0, [0, 2, 4])]
    text = spark.createDataFrame([(1, "abกขde"), (2, "")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 0, 2)], "doc_id long, s int, t int")
    assert {(r.s, r.t) for r in segment.expand_unknown(known, text).collect()} == {(0, 2), (2, 4), (4, 6)}
    seg = spark.createDataFrame([(1, 0, 1, "ก", False), (1, 1, 2, "ข", False), (1, 2, 3, "a", False), (1, 3, 4, "ค", True)], "doc_id long, s int, t int, word string, known boolean")
    assert [r.word for r in segment.merge_unknown_words(seg).orderBy("s").collect()] == ["กข", "a", "ค"]


def test_gold_against_itself(toks):
    g = trees.arc_texts(toks)
    r = evaluation.evaluate(g, g).first()
    assert (r.correct_over_gold, r.correct_over_test, r.f, r.root_pct, r.complete_pct, r.word_f) == (1.0, 1.0, 1.0, 100.0, 100.0, 1.0)
    by = {x.step: x for x in evaluation.evaluate_by_length(g, g).collect()}
    assert by["<=10"].sentences == 2 and by[">20"].f is None and by["all"].f == 1.0
    with pytest.raises(Exception):
        evaluation.evaluate(g, g.where("sent_id = 1")).collect()


def test_license_and_badness(spark, toks):
    arcs = trees.dependency_arcs(toks).select("sent_id", "head", "tok_id", "head_pos", "pos", F.lit(0.0).alias("score"))
    keys = spark.createDataFrame([(1, 3, "subj:>-c-ncn-L"), (1, 1, "det:<-a-ncn-R")], "sent_id long, tok_id int, demand string")
    got = {r.tok_id: (r.roles, r.badness) for r in scoring.license_arcs(arcs, keys, grammar.root_tags(toks)).collect()}
    assert got[2] == (["subj"], 0) and got[1] == (["det"], 0) and got[6] == ([], 1)
    t = spark.createDataFrame([(1, 1, 1.0, 2), (1, 2, 5.0, 3), (2, 1, 1.0, 0)], "sent_id long, tree_id int, score double, badness int")
    assert {(r.sent_id, r.tree_id) for r in scoring.filter_by_badness(t).collect()} == {(1, 1), (2, 1)}


def test_relative_order(spark):
    df = spark.createDataFrame([([3, -2, 1, -5, 1],)], "o array<int>")
    assert df.select(grammar.relative_order(F.col("o"))).first()[0] == [2, -1, 1, -2, 1]
