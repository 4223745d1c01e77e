"""Arc candidates and feature events. Templates are data; one array expression makes all features of a row."""

from __future__ import annotations

import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars, tags
from .storage import stored
from .trees import flat, sibling_context

# Parts of each template. h head, c child, i left, j right; w word, t tag, s coarse tag;
# p and n the neighbours before and after. Numbers of templates follow from the order.
UNIGRAM = ["hw", "cw", "ht", "ct", "hs", "cs", "hw ht", "cw ct", "hw hs", "cw cs"]
BIGRAM = ["hw cw", "ht ct", "hs cs", "ht cw ct", "hw cw ct", "hw ht ct", "hw ht cw", "hs cw cs", "hw cw cs", "hw hs cs", "hw hs cw", "hw ht cw ct", "hw hs cw cs"]
LINEAR_BIGRAM = [x for x in BIGRAM if x != "hw ht cw"]
SURROUND = ["it itn jtp jt", "itp it jtp jt", "it itn jt jtn", "itp it jt jtn", "itp it", "it itn", "itp it itn", "jtp jt", "jt jtn", "jtp jt jtn"]
SURROUND_COARSE = [" ".join(p.replace("t", "s", 1) for p in x.split()) for x in SURROUND]


def _crossed(block: list[str]) -> list[str]:
    return [x + more for more in ("", " dist", " dir", " dist dir") for x in block]


MAXENT = [*UNIGRAM, "dist", "dir", *_crossed(UNIGRAM)[10:], *_crossed(BIGRAM), *_crossed(SURROUND), *_crossed(SURROUND_COARSE)]
MAXENT += [f"i{k} bet{k} j{k}{more}" for k in "ts" for more in ("", " dist", " dir", " dist", " dir")]
LINEAR = [x + more for block in (UNIGRAM, LINEAR_BIGRAM, SURROUND, SURROUND_COARSE) for more in ("", " dir dist") for x in block]
#: Between templates of the linear model: one feature for each tag between.
LINEAR_BETWEEN = [(k, more) for k in "ts" for more in ("", " dir dist")]

_EDGE = ["hw ht cw ct first last dir", "hw hs cw cs first last dir", "ht ct first last dir", "hs cs first last dir", "ht ct first last", "hs cs first last", "ht ct dir", "hs cs dir", "ht ct", "hs cs"]
_ROLE = ["ht ct", "hs cs", "ht ct dir", "hs cs dir", "hw ht cw ct first last dir", "hw hs cw cs first last dir", "ht ct first last dir", "hs cs first last dir", "ht ct first last", "hs cs first last"]
LABEL = [*_EDGE, *(x + " hr" for x in _ROLE), *(x + " hr args" for x in _ROLE), "ct prel", "cs prel", "ct dir prel", "cs dir prel"]
LABEL += ["lw lt rw rt", "lw ls rw rs", "lt rt", "ls rs", "same", "mods rm lm fr fl", "mods", "rm lm", "fr fl", "mods rm lm", "mods fr fl", "rm lm fr fl"]


def _joined(parts: list[str]) -> Column:
    """a/b/c, or null if any part is null."""
    out = [F.col(parts[0])]
    for p in parts[1:]:
        out += [F.lit("/"), F.col(p)]
    return F.concat(*out) if len(out) > 1 else out[0].cast("string")


#: Parts that templates end in, over and over with the same parts before.
_TAILS = ["dist dir", "dir dist", "dist", "dir"]
#: Parts that a row may lack; templates with one of them are left out for it.
_OPTIONAL = {"bett", "bets", "args"}


def with_features(rows: DataFrame, keep: list[str], templates: list[str], first: int, separator: str, only: set[int] | None = None, more: list[Column] = []) -> DataFrame:  # noqa: B006
    """keep and features: an array of `number separator parts` for the templates without a null part, then the arrays of more.

    Numbers count all templates. What several templates start with is joined once, and so are their tails."""
    asked = []
    for k, t in enumerate(templates, first):
        if only is None or k in only:
            tail = next((x for x in _TAILS if t.endswith(f" {x}")), "")
            asked.append((k, t.removesuffix(tail).strip(), tail))
    starts = {t: f"_s{n}" for n, t in enumerate(dict.fromkeys(t for _, t, _ in asked))}
    tails = {t: f"_t{n}" for n, t in enumerate(dict.fromkeys(t for *_, t in asked if t))}
    rows = rows.withColumns({c: _joined(t.split()) for t, c in starts.items()} | {c: F.concat(F.lit("/"), _joined(t.split())) for t, c in tails.items()})
    made = [(F.concat(F.lit(f"{k}{separator}"), starts[t], *([tails[tail]] if tail else [])), not _OPTIONAL.isdisjoint(t.split())) for k, t, tail in asked]
    runs = [(optional, F.array(*(c for c, _ in run))) for optional, run in itertools.groupby(made, lambda x: x[1])]
    arrays = [F.array_compact(x) if optional else x for optional, x in runs] + more
    return rows.select(*keep, (F.concat(*arrays) if len(arrays) > 1 else arrays[0]).alias("features"))


_METHOD = "spark.sql.codegen.hugeMethodLimit"


def small_methods(spark: SparkSession) -> None:
    """Let Spark leave whole-stage code where a method gets over 8000 bytes, which HotSpot never compiles.

    Hundreds of templates side by side make such methods. Only where the session has Spark's default; the setting stays."""
    if spark.conf.get(_METHOD, "65535") == "65535":
        spark.conf.set(_METHOD, "8000")


def with_root(tokens: DataFrame) -> DataFrame:
    """sent_id and arrays words, tags, heads with the artificial root at place 0."""
    rows = tokens.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", "word", "pos", "head"))).alias("t"))
    root = lambda value, column: F.concat(F.array(F.lit(value)), F.col(f"t.{column}"))
    return rows.select("sent_id", root("<root>", "word").alias("words"), root("<root-POS>", "pos").alias("tags"), root(-1, "head").alias("heads"))


def arc_candidates(tokens: DataFrame) -> DataFrame:
    """sent_id, i < j, dir (L, R), label: every pair of a sentence with its root, both ways.

    Pairs are made inside the sentence's row; n(n+1) rows a sentence of n words."""
    s = with_root(tokens)
    last = F.size("words") - 1
    pairs = s.select("*", F.explode(F.sequence(F.lit(0), last - 1)).alias("i")).select("*", F.explode(F.sequence(F.col("i") + 1, F.size("words") - 1)).alias("j"))
    both = pairs.select("*", F.explode(F.array(F.lit("L"), F.lit("R"))).alias("dir"))
    head, child = F.when(F.col("dir") == "L", F.col("j")).otherwise(F.col("i")), F.when(F.col("dir") == "L", F.col("i")).otherwise(F.col("j"))
    return both.withColumn("label", F.when(F.get("heads", child) == head, "Yes").otherwise("No"))


def ordered_candidates(tokens: DataFrame) -> DataFrame:
    """sent_id, i, j, label: every ordered pair of different words without the root; Yes if i is j's head."""
    s = with_root(tokens).where("size(words) > 2")
    n = F.size("words") - 1
    pairs = s.select("sent_id", "heads", n.alias("n"), F.explode(F.sequence(F.lit(1), n)).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("j")).where("i <> j")
    return pairs.select("sent_id", "i", "j", F.when(F.get("heads", F.col("j")) == F.col("i"), "Yes").otherwise("No").alias("label"))


def between_tags(tags_: Column, i: Column, j: Column) -> Column:
    """Distinct sorted tags strictly between i and j."""
    return F.array_sort(F.array_distinct(F.slice(tags_, i + 2, F.greatest(j - i - 1, F.lit(0)))))


def arc_parts(cands: DataFrame) -> DataFrame:
    """Columns that arc templates are made of, for candidates of arc_candidates()."""
    word, tag = lambda at: F.get("words", at), lambda at: F.get("tags", at)
    i, j = F.col("i"), F.col("j")
    c = cands.withColumns(
        {
            "iw": scalars.decode_punc(word(i)), "jw": scalars.decode_punc(word(j)), "it": tag(i), "jt": tag(j),
            "itp": F.when(i == 0, "-S-").otherwise(tag(i - 1)), "jtn": F.when(j == F.size("words") - 1, "-E-").otherwise(tag(j + 1)),
            "itn": F.when(j == i + 1, "-M-").otherwise(tag(i + 1)), "jtp": F.when(j == i + 1, "-M-").otherwise(tag(j - 1)),
            "dist": scalars.arc_distance(i, j).cast("string"), "between": between_tags(F.col("tags"), i, j),
        }
    )
    edges = ("-S-", "-E-", "-M-")
    c = c.withColumns({a: F.when(F.col(b).isin(*edges), F.col(b)).otherwise(scalars.simplify_pos(F.col(b))) for a, b in (("is", "it"), ("js", "jt"), ("isp", "itp"), ("jsn", "jtn"), ("isn", "itn"), ("jsp", "jtp"))})
    c = c.withColumn("between_s", F.array_sort(F.array_distinct(F.transform("between", scalars.simplify_pos))))
    joined = lambda x: F.when(F.size(x) > 0, F.array_join(x, "+"))
    right = F.col("dir") == "R"
    sides = {f"{a}{k}": F.when(right, F.col(f"{x}{k}")).otherwise(F.col(f"{y}{k}")) for k in "wts" for a, x, y in (("h", "i", "j"), ("c", "j", "i"))}
    return c.withColumns({"bett": joined("between"), "bets": joined("between_s"), **sides})


def maxent_arc_features(cands: DataFrame, only: set[int] | None = None) -> DataFrame:
    """cands with features: the 184 numbered templates `k-a/b/c`, or only some of them."""
    small_methods(cands.sparkSession)
    return with_features(arc_parts(cands), ["sent_id", "i", "j", "dir", "label"], MAXENT, 1, "-", only)


def _between(start: Column, end: Column):
    return lambda x: F.concat(start, x, end)


def linear_arc_features(cands: DataFrame, only: set[int] | None = None) -> DataFrame:
    """cands with features: the 88 templates `k:a/b/c`, or only some; those of tags between once for each tag."""
    small_methods(cands.sparkSession)
    n, many = len(LINEAR), []
    for k, (kind, more) in enumerate(LINEAR_BETWEEN, n):
        if only is not None and k not in only:
            continue
        tail = F.concat(F.lit("/"), F.col("dir"), F.lit("/"), F.col("dist")) if more else F.lit("")
        start, end = F.concat(F.lit(f"{k}:"), F.col(f"i{kind}"), F.lit("/")), F.concat(F.lit("/"), F.col(f"j{kind}"), tail)
        many.append(F.transform("between" if kind == "t" else "between_s", _between(start, end)))
    return with_features(arc_parts(cands), ["sent_id", "i", "j", "dir", "label"], LINEAR, 0, ":", only, many)


def label_features(tokens: DataFrame, only: set[int] | None = None) -> DataFrame:
    """sent_id, tok_id, role, features: the 46 templates of each token under another token, or only some.
    Heads and siblings of rows of sentences are found inside the row.

    is_last is always No, and coarse tags of siblings are always None: model files know them so."""
    small_methods(tokens.sparkSession)
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    t = sibling_context(tokens)
    if "t" in tokens.columns:
        t = t.withColumn("ids", F.col("t.tok_id"))
        head = lambda x: F.get("t", F.array_position("ids", x["head"]).cast("int") - 1)
        under = F.transform(F.filter("t", lambda x: F.array_contains("ids", x["head"])), lambda x: x.withField("hw", head(x)["word"]).withField("ht", head(x)["pos"]).withField("hr", head(x)["role"]))
        t = flat(t.select("sent_id", under.alias("t")))
    else:
        heads = tokens.select("sent_id", F.col("tok_id").alias("head"), F.col("word").alias("hw"), F.col("pos").alias("ht"), F.col("role").alias("hr"))
        t = t.join(heads, ["sent_id", "head"])
    none = lambda c: F.coalesce(c, F.lit("None"))
    args = scalars.role_class(F.col("role"))
    t = t.select(
        "sent_id", "tok_id", "role", "hw", "ht", "hr", F.col("word").alias("cw"), F.col("pos").alias("ct"),
        scalars.simplify_pos(F.col("ht")).alias("hs"), scalars.simplify_pos(F.col("pos")).alias("cs"),
        yes(F.col("tok_id") == 1).alias("first"), F.lit("No").alias("last"), scalars.arc_direction(F.col("head"), F.col("tok_id")).alias("dir"),
        F.when(args != "unknown", args).alias("args"), yes(F.col("has_prel")).alias("prel"),
        *(none(F.col(f"{side}_{k}")).alias(f"{side[0]}{k[0] if k == 'word' else 't'}") for side in ("left", "right") for k in ("word", "pos")),
        F.lit("None").alias("ls"), F.lit("None").alias("rs"), yes(F.col("between_siblings")).alias("same"), F.col("n_children").cast("string").alias("mods"),
        *(yes(F.col(c)).alias(a) for c, a in (("right_most", "rm"), ("left_most", "lm"), ("nearest_right", "fr"), ("nearest_left", "fl"))),
    )
    return with_features(t, ["sent_id", "tok_id", "role"], LABEL, 1, "-", only)


def write_events(features: DataFrame, label: str = "label") -> DataFrame:
    """value: `label f1 f2 ...`, one line a row."""
    return features.select(F.concat_ws(" ", F.col(label), F.array_join("features", " ")).alias("value"))


def numbered_rows(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name: 0, 1, ... in the order of column, whose values are distinct.

    No window over the whole table: a range sort, and the rows of the partitions before as an offset. The
    sorted rows are stored with their places, as their borders come from a sample that another run may draw otherwise."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, column).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id())
    cut = cut.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    cut = stored(cut.drop("_id"), "numbered")
    # a row for each partition
    sizes = cut.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offset = F.broadcast(sizes.select("_part", before.alias("_before")))
    return cut.join(offset, "_part").withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).select(*rows.columns, name)


def feature_dictionary(features: DataFrame) -> DataFrame:
    """feature, fid: distinct features of Yes candidates, numbered from 0 in text order."""
    distinct = features.where("label = 'Yes'").select(F.explode("features").alias("feature")).distinct()
    return numbered_rows(distinct, "feature", "fid")


def _digest(feature: str) -> list[Column]:
    """A feature's identity in 128 bits, so that joins move 16 bytes instead of the text."""
    return [F.xxhash64(feature).alias("h1"), F.xxhash64(F.lit(1), feature).alias("h2")]


def vectorise(features: DataFrame, dictionary: DataFrame) -> DataFrame:
    """sent_id, i, j, dir, fid and further columns of dictionary: known features only, repeats kept.

    Features meet the dictionary by a 128-bit digest. The dictionary is the smaller side, hashed within each partition."""
    more = [c for c in dictionary.columns if c != "feature"]
    d = dictionary.select(*_digest("feature"), *more).hint("shuffle_hash")
    # a candidate is one number beside its sentence, as these rows are many and move
    arc = F.shiftleft((F.shiftleft(F.col("i").cast("long"), 24) + F.col("j")), 1) + (F.col("dir") == "R").cast("long")
    f = features.select("sent_id", arc.alias("arc"), F.explode("features").alias("feature"))
    v = f.select("sent_id", "arc", *_digest("feature")).join(d, ["h1", "h2"])
    i, j = F.shiftright("arc", 25).cast("int"), F.shiftright("arc", 1).bitwiseAND(F.lit((1 << 24) - 1)).cast("int")
    return v.select("sent_id", i.alias("i"), j.alias("j"), F.when(F.col("arc") % 2 == 1, "R").otherwise("L").alias("dir"), *more)


def arc_vectors(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """sent_id, i, j, dir, fid: for every candidate the list of its known linear features, repeats kept. dictionary: feature, fid.

    The same rows as vectorise() of linear_arc_features(arc_candidates(tokens)), one a candidate."""
    from .arc_lookup import looked_up

    return looked_up(tokens, dictionary, ["fid"], ["int64"], False)


def fold_vectors(tokens: DataFrame, dictionary: DataFrame, fold, schema: pa.Schema) -> DataFrame:
    """What fold makes of the known features of all candidates of each chunk of sentences, as arc_vectors() lists them (see looked_up())."""
    from .arc_lookup import looked_up

    return looked_up(tokens, dictionary, ["fid"], ["int64"], False, fold, schema)


def arc_sums(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """sent_id, i, j, dir and, for each further column of weights (feature and numbers), the sum over the candidate's linear features."""
    from .arc_lookup import looked_up

    columns = [c for c in weights.columns if c != "feature"]
    return looked_up(tokens, weights, columns, ["float64"] * len(columns), True)


def lexicon_features(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens with arrays has_tag and has_coarse: for each tag and coarse tag, whether the lexicon lists it."""
    coarse = sorted({tags.COARSE.get(t, t.upper()) for t in tags.TAGS})
    asked = lambda names, have: F.transform(F.array(*map(F.lit, names)), lambda p: F.array_contains(have, p))
    listed = F.coalesce("tags", F.array().cast("array<string>"))
    # made for words of the lexicon, not for tokens
    known = lexicon.select("word", asked(tags.TAGS, listed).alias("_t"), asked(coarse, F.transform(listed, scalars.simplify_pos)).alias("_c"))
    none = lambda names: F.array_repeat(F.lit(False), len(names))
    return tokens.join(known, "word", "left").select("sent_id", "tok_id", "word", F.coalesce("_t", none(tags.TAGS)).alias("has_tag"), F.coalesce("_c", none(coarse)).alias("has_coarse"))


def train_test_split(sentences: DataFrame, k: int = 10) -> DataFrame:
    """sentences with part: every k-th sentence by sent_id is test."""
    rank = numbered_rows(sentences.select("sent_id").distinct(), "sent_id", "rank")
    return sentences.join(rank, "sent_id").withColumn("part", F.when((F.col("rank") + 1) % k == 0, "test").otherwise("train")).drop("rank")
