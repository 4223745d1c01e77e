import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from arbora.llm.common import materialize  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, places string"


def step(spark, name, rows, sf_dir=""):
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1] or ""), 1, "p") for r in rows], SCHEMA)
    f = dict(corpus_pipeline.STAGES)[name]
    out = materialize(f(spark, docs, sf_dir), "test")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text, r.n_chars) for r in out.collect()), key=str)


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("abcdefgh") + r.choice("xyz") + str(r.randint(0, 99)) for _ in range(n))


def test_language_stage(spark):
    rows = [(1, "the words"), (2, None), (3, "123"), (None, "more"), (1, "the words")]
    assert [r[0] for r in step(spark, "language_id", rows)] == [1, 1, None]


def test_near_duplicate_stage(spark):
    a, b = words(1, 100), words(2, 100)
    rows = [(5, a), (3, a + " end"), (9, b), (9, b), (4, ""), (6, ""), (None, b)]
    assert [r[0] for r in step(spark, "near_duplicates", rows)] == [3, 4, 6, 9]


def test_substring_stage(spark):
    p, x, y = words(3, 20), words(4, 5), words(5, 5)
    rows = [(1, p), (2, f"{x}\n{p} {y}"), (3, p), (4, "short  text"), (5, None)]
    want = [(1, p, len(p)), (2, f"{x} {y}", len(f"{x} {y}")), (4, "short  text", 11), (5, None, 0)]
    assert step(spark, "substring_dedup", rows) == want


def test_decontamination_stage(spark, tmp_path):
    item = words(6, 12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, "a " + item.upper() + " b"), (2, " ".join(item.split()[:9])), (2, words(7, 30)), (None, item), (3, None)]
    assert [r[0] for r in step(spark, "decontamination", rows, str(tmp_path))] == [2, 2, 3]


def test_whole_run(spark, tmp_path):
    p = words(8, 30)
    rows = [(k, f"{words(k + 10, 20)} {p if k % 3 == 0 else ''}") for k in range(30)] + [(40, None)]
    spark.createDataFrame([(*r, "en" if r[1] else None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the repeated passage stays in document 0 only; what loses words is joined by single spaces
    kept = {k: text if k % 3 or k == 0 else words(k + 10, 20) for k, text in rows if k not in (7, 40)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {k: len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for k, text in kept.items()}
    assert {r.doc_id: r.length for r in out} == size
    assert {r.sequence_id: max(x.offset + x.length for x in out if x.sequence_id == r.sequence_id) for r in out} == {r.sequence_id: sum(x.length for x in out if x.sequence_id == r.sequence_id) for r in out}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, _ in corpus_pipeline.STAGES[:4]:
        assert step(spark, name, [], str(tmp_path)) == []
    empty = spark.createDataFrame([], SCHEMA)
    assert dict(corpus_pipeline.STAGES)["packing"](spark, empty, str(tmp_path)).count() == 0
