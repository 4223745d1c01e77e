"""Operators on rows of sentences: the same results as on rows of tokens, and no shuffle of tokens."""

import random

import pytest
from pyspark.sql import functions as F

from arbora.operators import evaluation, features, grammar, segment, trees
from arbora.plans import queries
from arbora.sources import treebank

SCHEMA = "sent_id long, tok_id int, word string, pos string, role string, head int, pred_head int"


@pytest.fixture(scope="module")
def toks(spark):
    rng, rows = random.Random(5), []
    for s in range(30):
        n = rng.randint(1, 9)
        for k in range(1, n + 1):
            # circles and heads that are no token too
            rows.append((s, k, rng.choice(["_", "a", "bb", "ccc"]), rng.choice(["ncn", "vi", "prel"]), rng.choice(["subj", "det", "modp"]), rng.randint(0, n + 1), rng.randint(0, n)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def rows(toks):
    return trees.grouped(toks).localCheckpoint()


def same(a, b):
    assert sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("f", [trees.dependency_arcs, trees.word_graph, trees.arc_texts, trees.subtree_span, trees.drop_blank_tokens, treebank.to_treebank])
def test_rows_do_not_move(f, toks, rows):
    same(f(toks), f(rows))
    assert exchanges(f(rows)) == 0


def test_offsets_and_edits(spark, toks, rows):
    same(trees.char_offsets(toks), trees.flat(trees.char_offsets(rows)))
    o = trees.char_offsets(toks).withColumn("id", F.concat("start", F.lit("-"), "end"))
    up = o.select("sent_id", F.col("tok_id").alias("pred_head"), F.col("id").alias("parent"))
    edits = o.join(up, ["sent_id", "pred_head"], "left").select("sent_id", "id", F.coalesce("parent", F.lit("root")).alias("parent"))
    by = edits.groupBy("sent_id").agg(F.collect_list(F.struct("id", "parent")).alias("edits"))
    got = trees.resolve_edit_rows(rows.join(F.broadcast(by), "sent_id"))
    same(got, toks.select("sent_id", F.col("pred_head").alias("head_id"), F.col("tok_id").alias("child_id")))
    same(got, trees.resolve_span_edits(edits, toks))


def test_pairs(toks, rows):
    pairs = trees.arc_rows(rows, {"g": "head", "t": "pred_head"})
    gold, test = trees.arc_texts(toks), trees.arc_texts(toks, "pred_head")
    same(evaluation.evaluate_pairs(pairs), evaluation.evaluate_sentences(gold, test))
    same(evaluation.evaluate(pairs), evaluation.evaluate(gold, test))
    same(evaluation.evaluate_by_length(pairs), evaluation.evaluate_by_length(gold, test))
    assert exchanges(evaluation.evaluate_pairs(pairs)) == 0


@pytest.mark.parametrize("name", ["candidate_graphs", "resolve_span_edits", "word_graph", "dependency_arcs", "drop_blank_tokens", "to_treebank"])
def test_queries_move_no_tokens(name, spark, tmp_path):
    spark.createDataFrame([(1, "a bb ccc . dd e f g h i j k l m"), (2, " "), (3, None)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    df = queries.QUERIES[name](spark, f"file://{tmp_path}")
    plan = df._jdf.queryExecution().executedPlan().toString()
    # at most the sums by sentence move
    assert not any("word" in line for line in plan.split("\n") if "Exchange " in line) and "Window" not in plan and "Join" not in plan
    assert df.count() > 0


def test_rules_do_not_move(toks, rows):
    same(grammar.rule_events(toks), grammar.rule_events(rows))
    assert exchanges(grammar.rule_events(rows)) == 0
    same(grammar.context_counts(toks), grammar.context_counts(rows))
    assert exchanges(grammar.context_counts(rows)) == 1  # of the counts


def test_lattice_edges_do_not_move(spark, tmp_path):
    spark.createDataFrame([(1, "a bb ccc . dd e f g h i j k l m")], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    lattice = queries._lattice(spark, f"file://{tmp_path}")
    assert exchanges(lattice) == 0
    assert {(r.doc_id, r.s, r.t, r.word) for r in lattice.where("tok_id = 0").collect()} == {(1000000, 0, 3, "abb"), (1000000, 6, 9, ".dd"), (1000000, 10, 12, "fg"), (1000000, 13, 15, "ij"), (1000001, 0, 2, "lm")}
    nodes = spark.createDataFrame([(1, 0, 2, "a"), (1, 2, 3, "b"), (1, 2, 4, "c"), (1, 3, 4, "d"), (2, 2, 3, "e")], "doc_id long, s int, t int, pos string")
    met = segment.adjacent(nodes)
    assert exchanges(met) == 1
    assert {tuple(r) for r in met.collect()} == {(1, 0, 2, "a", 3, "b"), (1, 0, 2, "a", 4, "c"), (1, 2, 3, "b", 4, "d")}


def test_json_trees_of_rows(toks, rows):
    straight = rows.withColumn("t", F.transform("t", lambda x: x.withField("head", (x["tok_id"] - 1).cast("int")))).localCheckpoint()
    got = treebank.to_json_tree(straight)
    assert exchanges(got) == 0
    same(got, treebank.to_json_tree(trees.flat(straight)))


def test_siblings_and_label_features_of_rows(toks, rows):
    got = trees.sibling_context(rows)
    assert exchanges(got) == 0
    same(trees.flat(got), trees.sibling_context(toks))
    labels = features.label_features(rows)
    assert exchanges(labels) == 0
    same(labels, features.label_features(toks))


def test_siblings_of_tokens_without_a_head(spark):
    toks = spark.createDataFrame([(1, k, "ab"[k % 2], "vi", "det", h, 0) for k, h in enumerate([None, 1, None, 1, 2, None], 1)], SCHEMA)
    same(trees.flat(trees.sibling_context(trees.grouped(toks))), trees.sibling_context(toks))
