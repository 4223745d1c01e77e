r"""URL filters: a rule list first, then a path-template tree, all DataFrame expressions.

Host and path are cut from the url (see `parts`). A rule is host + path; it fits its host and all
subdomains where the url's path starts with the rule's path; the longest rule wins.

Urls that a rule decides are the labelled ones. For each host a tree of path segments is built level
by level, until no url has a segment left (urls of a parent with fewer than MIN_SUPPORT get `*` for all
that is left, which is what the levels would give):

1. generalise  a segment that fewer than MIN_SUPPORT urls, or fewer than MIN_SHARE percent of its
               parent's urls, have is variable and becomes `*`.
2. merge       of the other branches of a parent, those with labels whose share of blocked ones does not
               differ from all of them together by Z standard deviations become one branch `~=`. Each is
               tested against the pool, not against each other. The variance is that of the pool with A
               more labels, half of them blocked, so that it is not 0 where the pool has one verdict.
               Branches without labels say nothing about likeness: they become a branch `~` of their own.
3. reject      a template whose smoothed purity (blocked + A * prior) / (labelled + A) is REJECT or
               more, where prior is the blocked share of all labelled urls.

From level CHAINS_FROM on, segments that all urls of a parent have in common are passed in one step, so rounds
follow the levels where paths part, not the length of the longest one. The tree is built on distinct (host, path) with counts, so repeats of a url cost one row. Hosts' rules
are looked up once per distinct host. Tables of one row a host or a branch grow with the data, so a join
broadcasts them only where they were measured to be small. They are written before they are joined,
which leaves Spark free to split a hot host.

Null url, or one without `://`: host and path are empty, no rule fits. Repeated or null ids and
further columns change nothing. Without any labels every url is allowed. A rule whose host is empty
fits nothing. Equal rules: block wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, sized

MIN_SUPPORT, MIN_SHARE = 5, 1
Z2 = 4
A, REJECT = 4, 0.7
#: The level from which on segments that all urls of a parent share are passed in one step; results don't depend on it.
CHAINS_FROM = 3
#: (host + path, verdict) of the query.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame([(r, v) for r, v in rules], "rule string, rule_verdict string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules that fit each host, longest first."""
    split = rules.select(F.regexp_extract("rule", r"^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", r"^[^/]*([\s\S]*)$", 1).alias("start"), "rule", "rule_verdict").where("suffix <> ''")
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))).alias("suffix"))
    fit = suffixes.join(split, "suffix")
    key = F.struct((-F.char_length("rule")).alias("k"), (F.col("rule_verdict") != "block").alias("allow"), "rule", "start", "rule_verdict")
    return fit.groupBy("host").agg(F.array_sort(F.collect_list(key)).alias("rules"))


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, rule_verdict of every page."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = materialize(host_rules(rows.select("host").distinct(), rules), "op5-rules")
    fits = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"])), F.lit(0))
    rows = rows.join(sized(known), "host", "left").withColumn("_r", fits)
    return rows.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.rule_verdict").alias("rule_verdict"))


def _past_chains(rows: DataFrame, tag: str) -> DataFrame:
    """rows moved past the segments that all urls of their parent have in common, in one step.

    Such a level has one branch only, which is the pool that it is tested against: `~=` with labels, `~` without.
    What the first and the last of sorted texts start with, all of them start with."""
    rest = F.concat(F.array_join("segments", "/"), F.lit("/"))
    span = rows.groupBy("host", "template").agg(F.sum("n").alias("all_n"), F.sum("labelled").alias("known"), F.min(rest).alias("low"), F.max(rest).alias("high"))
    low, high = (F.split(F.substring(c, F.lit(1), F.char_length(c) - 1), "/") for c in ("low", "high"))
    parted = F.array_position(F.zip_with(low, high, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    shared = F.when(parted > 0, parted - 1).otherwise(F.size(low)).cast("int")
    key = F.when(F.col("known") > 0, F.lit("/~=")).otherwise(F.lit("/~"))
    span = materialize(span.where(F.col("all_n") >= MIN_SUPPORT).select("host", "template", shared.alias("shared"), key.alias("key")).where("shared > 0"), tag)
    k = F.coalesce("shared", F.lit(0))
    moved = rows.join(sized(span), ["host", "template"], "left").withColumns({"segments": F.slice("segments", k + 1, F.size("segments")), "template": F.concat("template", F.repeat(F.coalesce("key", F.lit("")), k))})
    out = materialize(moved.drop("shared", "key"), tag)
    remove(span)
    return out


def templates(paths: DataFrame) -> DataFrame:
    """paths: host, path, n, labelled, blocked (distinct host and path) -> the same with template."""
    rows = paths.withColumn("segments", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    ended, written, d = [], [], 0
    parent = ["host", "template"]
    while True:
        rows = materialize(rows, f"op5-rows{d}")
        written.append(rows)
        ended.append(rows.where(F.size("segments") == 0))
        rows = rows.where(F.size("segments") > 0)
        if d >= CHAINS_FROM:
            # a round of its own for each level would take long on deep paths that hardly branch
            rows = _past_chains(rows, f"op5-chains{d}")
            written.append(rows)
            ended.append(rows.where(F.size("segments") == 0))
            rows = rows.where(F.size("segments") > 0)
        if rows.isEmpty():
            break
        rows = rows.withColumn("seg", F.get("segments", F.lit(0)))
        by = materialize(rows.groupBy(*parent, "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")), f"op5-by{d}")
        total = materialize(by.groupBy(*parent).agg(F.sum("n").alias("all_n")), f"op5-total{d}")
        counted = by
        by = by.join(sized(total), parent).withColumn("literal", (F.col("n") >= MIN_SUPPORT) & (F.col("n") * 100 >= F.col("all_n") * MIN_SHARE))
        pool = materialize(by.where("literal").groupBy(*parent).agg(F.sum("labelled").alias("L"), F.sum("blocked").alias("B")), f"op5-pool{d}")
        by = by.join(sized(pool), parent, "left")
        L, B, lab, blk = (F.col(c).cast("double") for c in ("L", "B", "labelled", "blocked"))
        share = (B + A / 2) / (L + A)
        away = (blk * L - lab * B) * (blk * L - lab * B)
        similar = away <= Z2 * share * (1 - share) * lab * L * L
        key = F.when(~F.col("literal"), F.lit("*")).when(F.col("labelled") == 0, F.lit("~")).when(similar, F.lit("~=")).otherwise(F.col("seg"))
        by = materialize(by.select(*parent, "seg", F.concat("template", F.lit("/"), key).alias("next"), (F.col("all_n") < MIN_SUPPORT).alias("few")), f"op5-level{d}")
        remove(counted, total, pool)
        written.append(by)
        rows = rows.join(sized(by), [*parent, "seg"])
        left = F.concat("template", F.repeat(F.lit("/*"), F.size("segments")))
        none, rest = F.array().cast("array<string>"), F.slice("segments", F.lit(2), F.size("segments"))
        rows = rows.select(*paths.columns, F.when(F.col("few"), none).otherwise(rest).alias("segments"), F.when(F.col("few"), left).otherwise(F.col("next")).alias("template"))
        d += 1
    out = materialize(reduce(DataFrame.unionByName, ended).drop("segments"), "op5-templates")
    remove(*written)
    return out


def judged(paths: DataFrame) -> DataFrame:
    """host, path, template, purity, rejected for paths as in `templates`."""
    rows = templates(paths)
    prior = rows.agg(F.coalesce(F.sum("blocked") / F.nullif(F.sum("labelled"), F.lit(0)), F.lit(0.0)).alias("prior"))
    by = rows.groupBy("host", "template").agg(F.sum("labelled").alias("lab"), F.sum("blocked").alias("blk"))
    by = by.join(F.broadcast(prior))  # one row
    purity = (F.col("blk") + A * F.col("prior")) / (F.col("lab") + A)
    by = materialize(by.select("host", "template", purity.alias("purity"), (purity >= REJECT).alias("rejected")), "op5-purity")
    return rows.select("host", "path", "template").join(sized(by), ["host", "template"])


def filter_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template for every page."""
    rows = materialize(ruled(pages, rules), "op5-ruled")
    blocked = (F.col("rule_verdict") == "block").cast("long")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("rule").alias("labelled"), F.coalesce(F.sum(blocked), F.lit(0)).alias("blocked"))
    out = rows.join(sized(materialize(judged(materialize(paths, "op5-paths")), "op5-judged")), ["host", "path"])
    verdict = F.coalesce("rule_verdict", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")
