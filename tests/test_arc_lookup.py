import pytest
from pyspark.sql import functions as F

from arbora.operators import digests, features

TOKENS = "sent_id long, tok_id int, word string, pos string, head int"


@pytest.fixture(scope="module")
def tokens(spark):
    words = ["a", "b/c", "a/b", "c", "", "é", "日本", "/", "<root>", "x" * 50, "\\comma", "&comma;"]
    tags = ["ncn", "vi", "a/b", "b", "-S-", "-M-", "punc", ""]
    rows = [(s, k + 1, words[(s * 7 + k * k) % len(words)], tags[(s + k * 3) % len(tags)], (s + k) % (n + 1)) for s, n in enumerate([1, 2, 3, 5, 8, 12, 12, 12]) for k in range(n)]
    rows += [(100, k + 1, words[k % 5], tags[k % 7], k) for k in range(160)]  # longer than digests.SHORT
    return spark.createDataFrame(rows, TOKENS)


def by_text(tokens, dictionary):
    return features.vectorise(features.linear_arc_features(features.arc_candidates(tokens)), dictionary)


def test_vectors_equal_those_by_text(spark, tokens):
    dictionary = features.feature_dictionary(features.linear_arc_features(features.arc_candidates(tokens)))
    known = dictionary.where("fid % 3 <> 1").unionByName(spark.createDataFrame([("no number", -1), ("3:", -2)], "feature string, fid long"))
    got = features.arc_vectors(tokens, known)
    pairs = lambda df: {(r[0], r[1], r[2], r[3], tuple(r[4])) for r in df.collect()}
    want = by_text(tokens, known).groupBy("sent_id", "i", "j", "dir").agg(F.array_sort(F.collect_list("fid")).alias("fid"))
    assert pairs(got.withColumn("fid", F.array_sort("fid")).where("size(fid) > 0")) == pairs(want)
    assert got.count() == features.arc_candidates(tokens).count()


def test_sums_equal_those_by_text(spark, tokens):
    weights = features.feature_dictionary(features.linear_arc_features(features.arc_candidates(tokens))).select("feature", (F.col("fid") % 7 - 3).cast("double").alias("w"), (F.col("fid") % 5).cast("double").alias("v"))
    got = {tuple(r[:4]): tuple(r[4:]) for r in features.arc_sums(tokens, weights).collect()}
    want = {tuple(r[:4]): tuple(r[4:]) for r in by_text(tokens, weights).groupBy("sent_id", "i", "j", "dir").agg(F.sum("w"), F.sum("v")).collect()}
    assert got == {k: want.get(k, (0.0, 0.0)) for k in got} and len(want) <= len(got)


def test_empty_inputs(spark, tokens):
    none = spark.createDataFrame([], "feature string, fid long")
    rows = features.arc_vectors(tokens.where("sent_id < 3"), none).collect()
    assert len(rows) == 2 + 6 + 12 and all(r["fid"] == [] for r in rows)
    assert features.arc_vectors(tokens.where("sent_id < 0"), none).count() == 0


def test_digest_of_a_join_is_that_of_the_text():
    import pyarrow as pa

    parts = ["a", "", "b/c", "日本", "x" * 40]
    table = digests.Parts(digests.Hashed(pa.array(parts)))
    import numpy as np

    rows = [np.array([0, 1, 2]), np.array([3, 4, 0]), np.array([2, 1, 1])]
    made = digests._numbered(digests.Hashed.of("7:"), 0, table.joined(rows))
    whole = digests.Hashed.of(*("7:" + "/".join(parts[r[k]] for r in rows) for k in range(3))).digests()
    assert all((a == b).all() for a, b in zip(made, whole))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_ids_are_dense_without_exchange_reuse(spark, adaptive):
    old = {k: spark.conf.get(k) for k in ("spark.sql.exchange.reuse", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        rows = spark.range(400_000).select(F.md5(F.col("id").cast("string")).alias("x")).distinct()
        ids = features.numbered_rows(rows, "x", "fid")
        got = ids.agg(F.count("*"), F.countDistinct("fid"), F.min("fid"), F.max("fid")).first()
        assert tuple(got) == (400_000, 400_000, 0, 399_999)
        first = ids.orderBy("fid").limit(50).collect()
        assert [r["x"] for r in first] == sorted(r["x"] for r in first)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
