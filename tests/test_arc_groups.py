from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arbora.operators import arc_lookup, features

TOKENS = "sent_id long, tok_id int, word string, pos string, head int"


def test_each_template_is_in_one_group():
    assert sorted(k for ks in arc_lookup.GROUPS.values() for k in ks) == list(range(len(features.LINEAR)))
    for (of, tail), ks in arc_lookup.GROUPS.items():
        assert all(("dist" in features.LINEAR[k].split()) == tail for k in ks) and len(of) <= 4


@pytest.mark.parametrize("dense", [1, 1 << 24])
def test_distinct_rows(monkeypatch, dense):
    monkeypatch.setattr(arc_lookup, "DENSE", dense)
    a, b = np.array([2, 0, 2, 1, 2]), np.array([1, 3, 1, 0, 3])
    rows, (x, y) = arc_lookup._codes([a, b], [3, 4])
    assert (x[rows] == a).all() and (y[rows] == b).all() and len(x) == 4


def test_a_chunk_asks_for_what_the_dictionary_may_have():
    words, tags = pa.array([["a", "b", "a"]]), pa.array([["ncn", "vi", "ncn"]])
    made = [h1 for slab in arc_lookup.Candidates(words, tags).slabs(100) for *_, digests in arc_lookup.Candidates(words, tags).groups(*slab) for h1, _ in digests]
    every = arc_lookup.distinct(np.concatenate(made))
    known, buckets, bits = every[::9], 4, 1 << 12
    filter_ = np.zeros(buckets * bits, bool)
    filter_[arc_lookup._bit(known, buckets, bits)] = True
    passed = arc_lookup._passed(np.packbits(filter_, bitorder="little"), buckets, every)
    assert set(known.tolist()) <= set(passed.tolist()) and len(passed) < len(every) / 4


def test_folds_see_the_features_of_vectors(spark):
    # a class of this function, as workers can't import this file
    class _Seen:
        """Lists what a fold is given."""

        SCHEMA = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("right", pa.bool_()), ("fid", pa.int64())])

        def __init__(self):
            self.held = []

        def add(self, i, j, right, fid):
            self.held.append((i, j, right, fid))

        def rows(self, schema):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*self.held)], schema=schema)

    rows = [(s, k + 1, f"w{(s + k * k) % 5}", ["ncn", "vi", "punc"][(s * k) % 3], k) for s, n in enumerate([1, 2, 6, 9]) for k in range(n)]
    tokens = spark.createDataFrame(rows, TOKENS)
    known = features.feature_dictionary(features.linear_arc_features(features.arc_candidates(tokens)))
    want = Counter((r.i, r.j, r.dir == "R", x) for r in features.arc_vectors(tokens, known).collect() for x in r.fid)
    got = Counter(map(tuple, features.fold_vectors(tokens, known, _Seen, _Seen.SCHEMA).collect()))
    assert got == want and sum(want.values()) > 1000
