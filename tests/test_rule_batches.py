"""Rule events of batches of sentences, and their counts: each is made once, and few of them move."""

import random

from pyspark.sql import functions as F

from arbora.operators import grammar, scoring
from arbora.plans import fixtures, queries

TEXTS = ["the big cat sees a dog on extraordinary roads and 12 birds sing loudly today", "we go home", "", None, "the big cat sees a dog on extraordinary roads and 12 birds"]


def trees(n):
    r = random.Random(7)
    for s in range(n):
        ids = sorted(r.sample(range(1, 15), r.randint(1, 9)))
        for k in ids:
            yield s, k, r.choice(["a", "b", "_", "é", None]), r.choice(["ncn", "vi-x", "a/b", None]), r.choice(["subj", "dobj", "det", "modp", "root", None, "subj/x"]), r.choice([0, None, 99, *ids, *ids])


def plain(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_groups_and_trees_are_those_of_the_events(spark):
    t = spark.createDataFrame(list(trees(200)), "sent_id long, tok_id int, word string, pos string, role string, head int")
    e, keys = grammar.rule_events(t), ["type", "head_key", "rule", "word_order"]
    want = e.groupBy(*keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("sent_id")).alias("trees"))
    got = grammar.rule_groups(t).groupBy(*keys).agg(F.sum("n").alias("n"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("trees")))).alias("trees"))
    assert plain(got) == plain(want) and len(plain(got)) > 100
    assert plain(grammar.rule_trees(t)) == plain(e.select(*keys[:3], "sent_id").distinct().groupBy(*keys[:3]).agg(F.count("*").alias("n")))


def test_ranks_are_those_of_relative_order(spark):
    df = spark.createDataFrame([(k, [random.Random(k * 10 + i).randint(-4, 4) for i in range(k % 6 + 1)]) for k in range(60)], "k int, o array<int>")
    rows = df.select("k", "o", grammar.relative_order(F.col("o")).alias("r")).collect()
    import numpy as np

    got = grammar._ranks(np.repeat([r.k for r in rows], [len(r.o) for r in rows]), np.concatenate([r.o for r in rows]))
    assert got.tolist() == [x for r in rows for x in r.r]


def test_events_are_made_once(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    for name in ("rule_probabilities", "top_rules", "rules_for_tokens", "read_grammar"):
        plan = queries.QUERIES[name](spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "text#" not in plan, name
    plan = queries.exclude_held_out(spark, f"file://{tmp_path}")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("LeftAnti")


def test_trees_left_out_before_or_after_their_rules(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    out = fixtures.sentences(spark, sf).where("sent_id < 1000000").select("sent_id")
    after = scoring.exclude_held_out(grammar.rule_evidence(grammar.rule_events(fixtures.rows(spark, sf))), out)
    before = grammar.rule_groups(fixtures.rows(spark, sf, lambda s: scoring.exclude_held_out(s, out))).select("type", "rule", "word_order").distinct()
    assert plain(after) == plain(before) != []
