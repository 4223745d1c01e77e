r"""Quality rules with cross-document line frequency, all DataFrame expressions.

Base: counts over the words `[^\x20\x09-\x0D]+` of the whole text; a document fails with fewer than
MIN_WORDS words or more than 20 % of its words in repeated 5-word windows.

Line frequency: a line is normalised (A-Z lower-cased, digits as 0, white space runs as one blank,
trimmed) and hashed. For each host (the document's source) count the distinct texts that hold a line;
exact copies of a document count once. A line held by at least MIN_DOCS texts and by more than
MAX_SHARE of the host's texts is boilerplate and is removed. A document is depleted, and rejected,
when less than MIN_LEFT of its words are left.

Lines meet by (host, line hash) after each text's repeats of a line are folded, and counts are
pre-aggregated, so a line on every page costs a row a task. Texts don't move, only hashes.

Null text is empty: no words, so it fails. Null source is one host. Rows that repeat id, text and
source get equal results. Further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

MIN_WORDS, MAX_REPEAT = 10, 20
MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 2, 30  # texts, percent of a host's texts, percent of a text's words
_WHITE = " \t\n\x0b\x0c\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0000000000"


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPLIT))


def _base(rows: DataFrame) -> DataFrame:
    """Adds the base counts to rows (text not null) and drops the text."""
    ws, text = F.col("_w"), F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_WHITE)) != "")
    at = lambda i, k: F.get(ws, i + k)
    windows = F.transform(ws, lambda x, i: F.xxhash64(x, at(i, 1), at(i, 2), at(i, 3), at(i, 4)))
    n = F.size("_w")
    rows = rows.withColumn("_w", words(text)).withColumn("_lines", lines)
    rows = rows.withColumn("_h", F.when(n >= 5, F.slice(windows, 1, F.greatest(n - 4, F.lit(1)))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(
        *[c for c in rows.columns if c not in ("text", "_w", "_lines", "_h")],
        n.cast("long").alias("n_words"),
        F.char_length(F.concat_ws("", "_w")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_h") > F.size(F.array_distinct("_h")), F.col("_h")).alias("_h"),
    )
    # windows in order of hash: equal ones are neighbours; only for texts that repeat one
    rows = rows.withColumn("_s", F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    again = F.transform(
        "_s",
        lambda x, i: F.when(
            F.coalesce(x["h"] == F.get(F.col("_s"), i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(F.col("_s"), i + 1)["h"], F.lit(False)),
            x["i"],
        ),
    )
    rows = rows.withColumn("_p", F.array_sort(F.array_compact(again)))
    step = F.transform("_p", lambda p, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_p"), i + 1) - p, F.lit(5))))
    repeat = F.coalesce(F.aggregate(step, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", repeat).drop("_h", "_s", "_p")


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), _SPLIT, " "), F.lit(" "))


def _rows(docs: DataFrame) -> DataFrame:
    text, host = F.coalesce("text", F.lit("")), F.coalesce("source", F.lit(""))
    return docs.select("doc_id", host.alias("host"), text.alias("text"), F.xxhash64(text).alias("t"), F.xxhash64("doc_id", text, host).alias("row"))


def _lines(rows: DataFrame) -> DataFrame:
    """row, host, t, pos, line (hash), words of every line with a word."""
    at = rows.select("row", "host", "t", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("norm", normalised(F.col("raw")))
    n_words = F.when(F.col("norm") == "", 0).otherwise(F.char_length("norm") - F.char_length(F.translate("norm", " ", "")) + 1)
    return at.select("row", "host", "t", "pos", F.xxhash64("norm").alias("line"), n_words.alias("words"), (F.col("norm") == "").alias("blank"))


def frequent_lines(docs: DataFrame) -> DataFrame:
    """host, line (hash), n_docs, host_docs of the lines above the limits."""
    return _frequent(_lines(_rows(docs)))


def _frequent(lines: DataFrame) -> DataFrame:
    seen = lines.where("not blank").groupBy("host", "line", "t").agg(F.lit(1).alias("one"))
    per_line = seen.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= MIN_DOCS)
    per_host = lines.groupBy("host", "t").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("host_docs"))
    return per_line.join(per_host, "host").where(F.col("n_docs") * 100 > F.col("host_docs") * MAX_SHARE)


def _removed(docs: DataFrame) -> DataFrame:
    """row, removed_words, removed_lines, positions of each row that loses lines."""
    lines = materialize(_lines(_rows(docs)), "op2-lines")
    copies = lines.where("pos = 0").groupBy("row").agg(F.count("*").alias("copies")).where("copies > 1")
    hit = lines.where("not blank").join(_frequent(lines).select("host", "line"), ["host", "line"])
    hit = hit.groupBy("row").agg(F.sum("words").alias("w"), F.count("*").alias("l"), F.collect_set("pos").alias("positions")).join(copies, "row", "left")
    return hit.select("row", F.expr("w div coalesce(copies, 1)").alias("removed_words"), F.expr("l div coalesce(copies, 1)").alias("removed_lines"), "positions")


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, removed_lines, removed_words and kept for every document."""
    removed = materialize(_removed(docs), "op2-removed").drop("positions")
    base = _base(_rows(docs).drop("host", "t"))
    out = base.join(removed, "row", "left")
    gone = F.coalesce("removed_words", F.lit(0)).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < MIN_LEFT * F.col("n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), gone.alias("removed_words"), (~failed & ~depleted).alias("kept"),
    )


def without_frequent_lines(docs: DataFrame) -> DataFrame:
    """doc_id and text without its host's frequent lines, for every document."""
    removed = materialize(_removed(docs), "op2-removed").select("row", "positions")
    rows = _rows(docs).select("doc_id", "row", "text").join(removed, "row", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("positions"), i))
    return rows.select("doc_id", F.when(F.col("positions").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
