r"""Spelling variant grouping: words one edit apart, found with bidirectional FM-indexes of the vocabulary.

1. vocabulary  runs of RUN in whole texts, A-Z lower-cased. A run whose crc32 with its doc_id is divisible
               by ERROR loses one code point (planted errors of the contract). Words of MIN_LENGTH code points and MIN_COUNT
               occurrences stay. Counting is a partial aggregate, so that a word of a third of all rows is no hot key.
2. shards      two sets of shards of some SHARD words each, as ranges of the sorted words and of the sorted reversed
               words. Each shard gets an index (fmindex.py) over all its words.
3. search      a word's first half is a range of the first set and its second half one of the second, so a word visits
               the shards whose first and last word don't exclude the half, mostly one of each set. In the first set
               the search that matches the first half exactly runs, in the second set the other one. A shard that
               very many words visit is dealt to several tasks, QUERIES words each.
4. groups      pairs found twice are made one; each word's near words are counted and the one of largest n is its form.
5. roots       forms have at least twice the occurrences, so there are no circles; pointers are doubled in joins until
               none changes, at most some six rounds.

Only shard borders, cut to BORDER letters, and visits by shard reach the driver: one row for each SHARD words.

Null text has no words. A null doc_id counts as an empty string in the checksum. Rows that repeat a
document count again. An empty vocabulary gives no rows. Columns besides doc_id and text play no part.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, sized, small_batches, trimmed
from .fmindex import Index

RUN = "[A-Za-zÀ-ÿ]+"
ERROR, MIN_LENGTH, MIN_COUNT = 97, 5, 3
SHARD, QUERIES, BORDER = 1 << 15, 1 << 18, 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _with_error(doc_id: Column, run: Column) -> Column:
    """The run, less one code point where the checksum of doc_id and run says so."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    i = (h % F.char_length(run)).cast("int")
    return F.when(h % ERROR == 0, F.concat(F.substring(run, F.lit(1), i), F.substring(run, i + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.char_length("run") >= min_length)
    words = runs.select(_with_error(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _shards(words: DataFrame, n: int, first_half: bool) -> DataFrame:
    """side, shard, word, n: ranges of the words, or of the reversed words; stored, as a range sort may part rows otherwise when it runs again."""
    key = F.col("word") if first_half else F.reverse("word")
    parted = words.repartitionByRange(n, key).select(F.lit(first_half).alias("first_half"), F.spark_partition_id().alias("shard"), "word", "n")
    return materialize(parted, "spelling-shard")


def _borders(shards: DataFrame) -> dict[bool, tuple[list[int], list[str], list[str]]]:
    """By side: shards in order, and their first and last keys, cut to BORDER letters."""
    key = F.when(F.col("first_half"), F.col("word")).otherwise(F.reverse("word"))
    rows = shards.groupBy("first_half", "shard").agg(F.substring(F.min(key), 1, BORDER).alias("low"), F.substring(F.max(key), 1, BORDER).alias("high")).collect()
    out = {}
    for side in (True, False):
        mine = sorted((r for r in rows if r["first_half"] == side), key=lambda r: (r["low"], r["high"]))
        out[side] = tuple([r[c] for r in mine] for c in ("shard", "low", "high"))
    return out


_VISITS = "first_half boolean, shard int, word string"
_VISITS_ARROW = pa.schema([("first_half", pa.bool_()), ("shard", pa.int32()), ("word", pa.string())])


def _visits(borders):
    def run(batches):
        for batch in batches:
            sides, shards, words = [], [], []
            for word in batch.column("word").to_pylist():
                half = len(word) // 2
                for side, start in ((True, word[:half]), (False, word[half:][::-1])):
                    names, low, high = borders[side]
                    start = start[:BORDER]
                    # cut borders may let in a shard too many, never one too few
                    a, b = bisect_left(high, start), bisect_right(low, start + "\U0010ffff")
                    sides += [side] * max(0, b - a)
                    shards += names[a:b]
                    words += [word] * max(0, b - a)
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.bool_()), pa.array(shards, pa.int32()), pa.array(words, pa.string())], schema=_VISITS_ARROW)

    return trimmed(run)


_PAIRS = "word string, near string, near_n long"
_PAIRS_ARROW = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _search(members: pa.Table, visitors: pa.Table) -> pa.Table:
    """One shard's words and those that visit it -> pairs of a visitor and a word one edit away."""
    if not len(members) or not len(visitors):
        return _PAIRS_ARROW.empty_table()
    count = dict(zip(members.column("word").to_pylist(), members.column("n").to_pylist()))
    words, asked = sorted(count), visitors.column("word").to_pylist()
    of, at = Index(words).near(asked, bool(members.column("first_half")[0].as_py()))
    near = [words[i] for i in at.tolist()]
    return pa.table([[asked[i] for i in of.tolist()], near, [count[w] for w in near]], schema=_PAIRS_ARROW)


def near_pairs(words: DataFrame) -> DataFrame:
    """word, near, near_n: all pairs of words one edit apart, both ways round. words: a stored table of word, n."""
    spark = words.sparkSession
    small_batches(spark)
    n = max(1, -(-words.count() // SHARD))
    sides = [_shards(words, n, side) for side in (True, False)]
    shards = sides[0].unionByName(sides[1])
    visits = materialize(words.select("word").mapInArrow(_visits(_borders(shards)), _VISITS), "spelling-visits")
    parts = visits.groupBy("first_half", "shard").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
    parts = materialize(parts, "spelling-parts")
    key = ["first_half", "shard"]
    dealt = visits.join(sized(parts), key).withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    copies = shards.join(sized(parts), key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key.append("part")
    found = copies.drop("parts").groupBy(*key).cogroup(dealt.drop("parts").groupBy(*key)).applyInArrow(_search, _PAIRS)
    out = materialize(found.distinct(), "spelling-pairs")
    remove(*sides, visits, parts)
    return out


def forms(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n."""
    # largest n first, then the first word in order
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), "near"))
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.minus_n") >= 2 * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n")
    )


def _roots(formed: DataFrame) -> DataFrame:
    """word, root of the words that have a form: pointers are doubled until none moves."""
    now = materialize(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        remove(now)
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")
        now._arbora_path = after._arbora_path


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the vocabulary of docs (doc_id, text)."""
    words = materialize(vocabulary(docs), "spelling-words")
    pairs = near_pairs(words)
    formed = materialize(forms(words, pairs), "spelling-forms")
    remove(words, pairs)
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
