r"""Filter interaction audit: what each of five filters removes in every order of them.

1. facts    one finite-state pass over each text's bytes (transducer.py) counts words, distinct words,
            capitals, code points and symbols; rows go on with counts and a SHA-256 of the text.
2. verdicts each document's failures of A to E as five bits. Texts are identical where their digests are.
            E needs the smallest doc_id of each digest (a partial aggregate) and an equi-join on
            (digest, doc_id), so that a text copied into a third of all rows is no hot key.
3. cells    counts by (part, failure bits): at most 32 rows a part.
4. orders   all 120 orders by 5 steps over the cells; no document is read again.

Filters fail where: A fewer than 50 words; B 100 * distinct words < 65 * words; C 100 * [A-Z] > 5 * code
points; D any of `#$%&*|`; E the text is that of a smaller doc_id. Words are `[^\x20\x09-\x0D]+`.

Null text counts as empty (A and, beside another empty text, E). Null source is the part ''. A null
doc_id is neither smaller nor greater than another, so it never fails E, and has no label. Rows of one
doc_id don't make each other fail E. Labels of a repeated doc_id count if any of its rows has them;
null labels don't. An empty table gives no rows. Columns besides doc_id, text and source play no part.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, small_batches, steps, trimmed
from .transducer import Pass, byte_classes

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "#$%&*|"
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_points", "n_symbols")

_FACTS = "doc_id long, part string, digest binary, " + ", ".join(f"{c} long" for c in COUNTS)
_FACTS_ARROW = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary())] + [(c, pa.int64()) for c in COUNTS])


def _facts(symbols: str):
    classes = byte_classes(symbols)

    def run(batches):
        for batch in batches:
            for s, e, texts in steps(batch.column("text"), as_bytes=True):
                seen = Pass(texts, classes)
                digests = [hashlib.sha256(t).digest() for t in texts]
                columns = [pa.array(getattr(seen, c), pa.int64()) for c in COUNTS]
                ids = [batch.column(c).slice(s, e - s) for c in ("doc_id", "part")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(digests, pa.binary()), *columns], schema=_FACTS_ARROW)

    return trimmed(run)


def facts(docs: DataFrame, symbols: str = SYMBOLS) -> DataFrame:
    """doc_id, part (source, or ''), digest (SHA-256 of the text) and n_words, n_distinct, n_capitals, n_points, n_symbols."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("source", F.lit("")).alias("part"))
    return rows.mapInArrow(_facts(symbols), _FACTS)


def _bits(*failures: Column) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0))


def failures(seen: DataFrame) -> DataFrame:
    """facts() -> doc_id, part, fails: bit i is set if the document fails filter i of FILTERS."""
    firsts = seen.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    a = F.col("n_words") < MIN_WORDS
    b = 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words")
    c = 100 * F.col("n_capitals") > MAX_CAPITALS * F.col("n_points")
    return seen.join(firsts, ["doc_id", "digest"], "left").select("doc_id", "part", _bits(a, b, c, F.col("n_symbols") > 0, copied).alias("fails"))


def _labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    # rows without an id match no label: kept out of the join, where they would be one key
    with_id = failed.where("doc_id IS NOT NULL").join(known, "doc_id", "left")
    return with_id.unionByName(failed.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def _order_steps() -> Column:
    """The 600 (filter_order, step, own bit, bits of the filters before) as one constant array."""
    rows = []
    for order in itertools.permutations(FILTERS):
        bits = [1 << FILTERS.index(x) for x in order]
        rows += [{"filter_order": "".join(order), "step": i + 1, "own": bits[i], "before": sum(bits[:i])} for i in range(len(order))]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order string, step int, own int, before int>>")


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    seen = materialize(facts(docs), "filter-facts")
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    cells = _labelled(failures(seen), labels).groupBy("part", "fails").agg(F.count("*").alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))
    stored = materialize(cells, "filter-cells")
    remove(seen)
    each = stored.withColumn("o", F.explode(_order_steps())).select("part", "fails", "n", "good", "toxic", "o.*")
    fails = F.col("fails").bitwiseAND(F.col("own")) != 0
    gone = F.col("fails").bitwiseAND(F.col("before")) != 0
    passed = F.col("fails").bitwiseAND(F.col("before").bitwiseOR(F.col("own"))) == 0
    among = lambda condition, c="n": F.sum(F.when(condition, F.col(c)).otherwise(F.lit(0).cast("long")))
    # of the orders of all filters, those where this one comes first of a document's failing ones
    share = F.col("n") * F.expr("120 div bit_count(fails)")
    return each.groupBy("part", "filter_order", "step").agg(
        among(passed).alias("kept"),
        among(fails & ~gone).alias("removed"),
        among(fails & gone).alias("redundant"),
        among(F.col("fails") == F.col("own")).alias("unique_fails"),
        among(fails & ~gone, "good").alias("good_lost"),
        among(fails & ~gone, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, share).otherwise(F.lit(0).cast("long"))).alias("shapley"),
    )
