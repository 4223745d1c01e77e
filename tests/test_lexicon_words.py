"""What the lexicon lists is worked out for its words, not for each token."""

from arbora.functions import tags
from arbora.operators import features


def test_arrays_are_made_before_the_join(spark):
    toks = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "a"), (2, 2, "c")], "sent_id long, tok_id int, word string")
    lexicon = spark.createDataFrame([("a", ["vi", "ncn"]), ("b", [])], "word string, tags array<string>")
    f = features.lexicon_features(toks, lexicon)
    above = f._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "array_contains" not in above
    got = {(r.sent_id, r.tok_id): r for r in f.collect()}
    assert {t for t, x in zip(tags.TAGS, got[1, 1].has_tag) if x} == {"vi", "ncn"} and got[2, 1].has_tag == got[1, 1].has_tag
    for key in ((1, 2), (2, 2)):
        assert len(got[key].has_tag) == len(tags.TAGS) and not any(got[key].has_tag) and not any(got[key].has_coarse)
    assert sum(got[1, 1].has_coarse) == len({tags.COARSE.get(t, t.upper()) for t in ("vi", "ncn")})
