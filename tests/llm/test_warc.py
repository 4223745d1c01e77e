import glob
import gzip
import hashlib
import re

import numpy as np
import pytest

from arbora.llm import warc

SCHEMA = "page_id long, url string, html string"
BIG = "<p>" + "x" * 200


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def digest(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


def test_round_trip_and_revisits(spark):
    rows = [(7, "http://a/", BIG), (3, "http://b/", BIG), (9, None, BIG), (4, "http://a/ x\n", "short"), (5, "http://c/é", "short"), (6, "u", None), (8, "u", ""), (None, "u", BIG), (11, "u", BIG + "é\r\n\r\nz")]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    want = [(i, len((h or "").encode()), digest(h), *(("revisit", 3) if h == BIG and i != 3 else ("response", None))) for i, _, h in rows]
    assert got == sorted(want, key=str)


def test_repeated_rows(spark):
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages(spark, [(1, "a", BIG)] * 3 + [(2, "b", "s")] * 2)).collect())
    assert got == [(1, "response", None), (1, "revisit", 1), (1, "revisit", 1), (2, "response", None), (2, "response", None)]


def test_same_bytes_from_any_partitioning(spark, tmp_path):
    rows = [(k * k, f"http://h{k % 7}/{k}", f"{k % 11} " * (50 + k)) for k in range(300)]
    folders = [f"{tmp_path}/{n}" for n in (1, 7)]
    for n, f in zip((1, 7), folders):
        m = warc.write(pages(spark, rows).repartition(n), f"file://{f}", shard_bytes=20_000, file_bytes=2_000).collect()
        assert len(m) > 10 and all(x.bytes == len(open(f"{f}/{x.name}", "rb").read()) and x.sha256 == hashlib.sha256(open(f"{f}/{x.name}", "rb").read()).hexdigest() for x in m)
    a, b = ({p.rsplit("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{f}/part-*")} for f in folders)
    assert a == b and not glob.glob(f"{folders[0]}/.part-*.gz.*")
    first = gzip.decompress(a[min(a)])
    assert first.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_commit_can_run_again_and_damage_is_seen(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    manifest = warc.write(pages(spark, [(k, "u", BIG + str(k)) for k in range(5)]), folder)
    assert manifest.mapInArrow(warc._commit(folder), warc._MANIFEST).count() == manifest.count()
    assert warc.read(spark, folder).count() == 5
    path = glob.glob(f"{tmp_path}/w/part-*")[0]
    whole = open(path, "rb").read()
    open(path, "wb").write(whole[:-30])
    with pytest.raises(Exception):
        warc.read(spark, folder).count()


def test_empty(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0


def shards_of(spark, rows, shard_bytes):
    """Shard of each row (key, tie, bytes, copies) of placed(), held against a running sum in Python."""
    df = spark.createDataFrame(rows, "key long, tie long, bytes long, copies long").repartition(5)
    keys, bounds = warc.placed(df, shard_bytes)
    got = {(r.key, r.tie): (r.first, r.last) for r in keys.collect()}
    total = 0
    for key, tie, n, copies in sorted(rows):
        first = total // shard_bytes
        assert got[key, tie] == (first, (total + n - 1) // shard_bytes if copies > 1 else first)
        total += n
        at = bounds.of(np.full(64, key), np.full(64, tie), np.arange(64)).tolist()
        assert set(at) == set(range(got[key, tie][0], got[key, tie][1] + 1))
    return got


def test_shards_of_dense_ids(spark):
    got = shards_of(spark, [(k, 5, 100, 1) for k in range(1000)] + [(10**15, 1, 100, 1), (warc.LAST, 1, 100, 1)], 10_000)
    assert max(last for _, last in got.values()) == 10


def test_shards_of_negative_repeated_and_null_ids(spark):
    rows = [(-(2**63), 0, 900, 1), (-5, 3, 100, 1), (-5, -7, 40_000, 50), (7, 1, 20_000, 1)]
    got = shards_of(spark, rows + [(warc.LAST, t * 1000 - 10**6, 300, 1) for t in range(500)], 10_000)
    assert got[-5, -7] == (0, 4) and max(last for _, last in got.values()) > 18


def test_negative_null_and_long(spark):
    long = "é<b>" * 300_000
    rows = [(-5, "a", BIG), (None, "b", BIG), (None, "b", "s"), (-(2**63), "c", long), (2**63 - 2, "d", long), (0, None, None)]
    got = sorted((tuple(r) for r in warc.round_trip(pages(spark, rows)).collect()), key=str)
    least = {BIG: -5, long: -(2**63)}
    want = [(i, len((h or "").encode()), digest(h), *(("revisit", least[h]) if h in least and i != least[h] else ("response", None))) for i, _, h in rows]
    assert got == sorted(want, key=str)


def test_equal_rows_over_many_shards(spark, tmp_path):
    rows = [(3, "u", BIG)] * 400 + [(None, "v", "small")] * 300 + [(9, "w", BIG)] * 5
    folder = f"{tmp_path}/w"
    m = warc.write(pages(spark, rows).repartition(7), f"file://{folder}", shard_bytes=20_000).collect()
    assert len({x.shard for x in m}) > 10
    ids = []
    for x in m:
        with gzip.open(f"{folder}/{x.name}") as f:
            heads = [h for h in f.read().decode().split("WARC/1.1\r\n") if h and "warcinfo" not in h]
        ids += [re.search("WARC-Record-ID: (.*)\r\n", h)[1] for h in heads]
    assert len(ids) == len(set(ids)) == 705
    back = warc.read(spark, f"file://{folder}")
    assert sorted((tuple(r) for r in back.groupBy("page_id", "record_type", "refers_to").count().collect()), key=str) == sorted([(3, "response", None, 1), (3, "revisit", 3, 399), (9, "revisit", 3, 5), (None, "response", None, 300)], key=str)
    at = back.where("page_id = 3 and record_type = 'response'").first()
    assert at.payload_bytes == len(BIG)
    to = {re.search("WARC-Refers-To: (.*)\r\n", h)[1] for x in m for h in gzip.open(f"{folder}/{x.name}").read().decode().split("WARC/1.1\r\n") if "WARC-Refers-To" in h}
    assert len(to) == 1 and to < set(ids)


def test_clashing_columns(spark):
    rows = [(1, "a", BIG, 7, "x", 1, 2), (2, "b", BIG, 8, "y", 3, 4)]
    df = spark.createDataFrame(rows, SCHEMA + ", shard int, digest string, key long, tie long")
    assert sorted((r.page_id, r.record_type) for r in warc.round_trip(df).collect()) == [(1, "response"), (2, "revisit")]
