"""Token tables of dependency trees: offsets, arcs, children, spans. All keys include sent_id.

A table of trees has either a row for each token or, as grouped() makes it, one for each sentence with its tokens
as an array t. What asks only for a sentence's own tokens works inside such a row and takes both forms; tables
that come in the second form are not shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_token():
    return W.partitionBy("sent_id").orderBy("tok_id")


def grouped(tokens: DataFrame, by: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """by and t, the tree's tokens in order: a row for each tree. A table in this form stays as it is."""
    if "t" in tokens.columns:
        return tokens
    # all columns move, so that what is read of one table in several ways shares the exchange
    own = ["tok_id", *(c for c in tokens.columns if c not in (*by, "tok_id"))]
    return tokens.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("t"))


def flat(rows: DataFrame, array: str = "t") -> DataFrame:
    """The inverse of grouped(): a row for each item of an array, beside the other columns.

    Exploded as outer, because else Spark filters rows by the array's size first, and so works the array out twice."""
    rest = [c for c in rows.columns if c != array]
    return rows.select(*rest, F.posexplode_outer(array).alias("_p", "_x")).where("_p is not null").select(*rest, "_x.*")


def rows_of(sentences: DataFrame) -> DataFrame:
    """Arrays words, tags, roles, heads as one array t of tokens, beside all other columns."""
    arrays = ("words", "tags", "roles", "heads")
    t = F.transform(F.arrays_zip(*arrays), lambda x, p: F.struct((p + 1).alias("tok_id"), x["words"].alias("word"), x["tags"].alias("pos"), x["roles"].alias("role"), x["heads"].alias("head")))
    return sentences.select(*(c for c in sentences.columns if c not in arrays), t.alias("t"))


def tokens(sentences: DataFrame) -> DataFrame:
    """sent_id (and cand_id, if there) and arrays words, tags, roles, heads -> a row for each token."""
    keys = [c for c in ("sent_id", "cand_id") if c in sentences.columns]
    return flat(rows_of(sentences.select(*keys, "words", "tags", "roles", "heads")))


def sentences(tokens: DataFrame) -> DataFrame:
    """The inverse of tokens()."""
    g = grouped(tokens)
    return g.select("sent_id", *(F.col(f"t.{c}").alias(a) for c, a in (("word", "words"), ("pos", "tags"), ("role", "roles"), ("head", "heads"))))


def char_offsets(tokens: DataFrame) -> DataFrame:
    """tokens with start and end: character offsets of the words written without spaces. Rows of sentences stay rows."""
    if "t" in tokens.columns:
        own = tokens.schema["t"].dataType.elementType.names
        item = lambda x, i: F.struct(*(x[c].alias(c) for c in own), F.get("e", i).alias("start"), F.get("e", i + 1).alias("end"))
        rest = [c for c in tokens.columns if c != "t"]
        return tokens.withColumn("e", _ends()).select(*rest, F.when(F.size("e") > 0, F.transform("t", item)).alias("t"))
    end = F.sum(F.char_length("word")).over(_by_token().rowsBetween(W.unboundedPreceding, 0))
    return tokens.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("word"))


def _ends() -> Column:
    """0 and the character offsets where the words of array t end."""
    return F.aggregate("t", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.char_length(x["word"])))


def dependency_arcs(tokens: DataFrame) -> DataFrame:
    """Head and child of each token that has a head, with words, tags and character spans: found inside the sentence's row."""
    g = grouped(tokens).select("sent_id", "t").withColumn("e", _ends())
    own = g.schema["t"].dataType.elementType.names
    at = lambda x: F.array_position("t.tok_id", x["head"]).cast("int")
    arc = F.transform("t", lambda x, i: F.struct(*(x[c].alias(c) for c in own), F.get("e", i).alias("start"), F.get("e", i + 1).alias("end"), at(x).alias("h")))
    up = lambda x: F.get("t", x["h"] - 1)
    head = lambda x: [up(x)["word"].alias("head_word"), up(x)["pos"].alias("head_pos"), F.get("e", x["h"] - 1).alias("head_start"), F.get("e", x["h"]).alias("head_end")]
    both = F.transform(F.filter(arc, lambda x: x["h"] > 0), lambda x: F.struct(*(x[c].alias(c) for c in (*own, "start", "end")), *head(x)))
    return flat(g.select("sent_id", both.alias("a")), "a")


def arc_rows(tokens: DataFrame, heads: dict[str, str], by: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """by, other columns of a table of rows, and for each (name, head column) of heads an array name of the tree's arcs
    in child order: tok_id, head_unit, child_unit, arc. Offsets and heads are found inside the sentence's row."""
    g = grouped(tokens, by).withColumn("e", _ends())
    unit = F.transform("t", lambda x, i: F.concat(x["word"], F.lit(":"), F.get("e", i), F.lit(":"), F.get("e", i + 1), F.lit(" "), x["pos"]))
    g = g.withColumn("u", unit)

    def arcs(head: str) -> Column:
        up = lambda x: F.when(x[head] == 0, "ROOT ROOT").otherwise(F.get("u", F.array_position("t.tok_id", x[head]).cast("int") - 1))
        pairs = F.transform("t", lambda x, i: F.struct(x["tok_id"].alias("tok_id"), up(x).alias("head_unit"), F.get("u", i).alias("child_unit")))
        return F.transform(pairs, lambda x: F.struct(x["tok_id"].alias("tok_id"), x["head_unit"].alias("head_unit"), x["child_unit"].alias("child_unit"), F.concat(x["head_unit"], F.lit(" <-- "), x["child_unit"]).alias("arc")))

    return g.select(*(c for c in g.columns if c not in ("t", "e", "u")), *(arcs(head).alias(name) for name, head in heads.items()))


def arc_texts(tokens: DataFrame, head: str = "head", by: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """by, tok_id, head_unit, child_unit, arc: `word:s:e tag <-- word:s:e tag`, ROOT ROOT for head 0."""
    return flat(arc_rows(tokens, {"a": head}, by).select(*by, "a"), "a")


def word_graph(tokens: DataFrame, head: str = "head", by: tuple[str, ...] = ("sent_id",)) -> DataFrame:
    """by, graph: the arcs of a tree in child order, joined by (+). With by = (sent_id, cand_id), a graph for each candidate."""
    return arc_rows(tokens, {"a": head}, by).select(*by, F.array_join("a.arc", "(+)").alias("graph"))


def children(tokens: DataFrame) -> DataFrame:
    """sent_id, head, children (ascending)."""
    return tokens.groupBy("sent_id", "head").agg(F.array_sort(F.collect_list("tok_id")).alias("children"))


def sibling_context(tokens: DataFrame) -> DataFrame:
    """For each token: neighbours among its siblings, counts of its children, and its place around its head. Rows of sentences stay rows."""
    if "t" in tokens.columns:
        return _sibling_rows(tokens)
    t, siblings = tokens, W.partitionBy("sent_id", "head").orderBy("tok_id")
    own = t.groupBy("sent_id", F.col("head").alias("tok_id")).agg(F.count("*").alias("n_children"), F.max((F.col("pos") == "prel").cast("int")).alias("prel"))
    whole = W.partitionBy("sent_id", "head")
    left, right = F.col("tok_id") < F.col("head"), F.col("tok_id") > F.col("head")
    pick = lambda side, f: f(F.when(side, F.col("tok_id"))).over(whole)
    t = t.withColumns(
        {
            "left_word": F.lag("word").over(siblings), "left_pos": F.lag("pos").over(siblings),
            "right_word": F.lead("word").over(siblings), "right_pos": F.lead("pos").over(siblings),
            "rank": F.row_number().over(siblings), "n_left": F.coalesce(F.sum(left.cast("int")).over(whole), F.lit(0)),
            "left_most": F.coalesce(F.col("tok_id") == pick(left, F.min), F.lit(False)), "nearest_left": F.coalesce(F.col("tok_id") == pick(left, F.max), F.lit(False)),
            "right_most": F.coalesce(F.col("tok_id") == pick(right, F.max), F.lit(False)), "nearest_right": F.coalesce(F.col("tok_id") == pick(right, F.min), F.lit(False)),
        }
    )
    # siblings strictly between the token and its head
    between = F.when(left, F.col("n_left") - F.col("rank")).otherwise(F.col("rank") - F.col("n_left") - 1)
    t = t.withColumn("between_siblings", between == F.abs(F.col("head") - F.col("tok_id")) - 1)
    t = t.join(own, ["sent_id", "tok_id"], "left")
    return t.drop("rank", "n_left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("has_prel", F.coalesce(F.col("prel") == 1, F.lit(False))).drop("prel")


def _sibling_rows(rows: DataFrame) -> DataFrame:
    """sibling_context() inside the sentence's row: tokens sorted by head make the children of a token one slice."""
    own = rows.schema["t"].dataType.elementType.names
    kid = lambda x: F.struct(x["head"].alias("head"), x["tok_id"].alias("tok_id"), x["word"].alias("word"), x["pos"].alias("pos"))
    # tokens without a head are siblings too
    g = rows.withColumn("_k", F.array_sort(F.transform("t", lambda x: kid(x).withField("head", F.coalesce(x["head"], F.lit(-1))))))
    g = g.select(*rows.columns, "_k", F.col("_k.head").alias("_h"))
    children = lambda head: F.when(F.array_contains("_h", head), F.slice("_k", F.array_position("_h", head).cast("int"), F.size("_h") - F.size(F.array_remove("_h", head)))).otherwise(F.slice("_k", 1, 0))
    first = lambda x: F.struct(*(x[c].alias(c) for c in own), children(F.coalesce(x["head"], F.lit(-1))).alias("sib"), children(x["tok_id"]).alias("kids"))

    def placed(x: Column) -> Column:
        # siblings up to the head; the token's place among all
        at, head = F.array_position(x["sib"]["tok_id"], x["tok_id"]).cast("int"), x["head"]
        n_left, n_up_to = (F.size(F.filter(x["sib"], f)) for f in (lambda y: y["tok_id"] < head, lambda y: y["tok_id"] <= head))
        return F.struct(*(x[c].alias(c) for c in (*own, "sib", "kids")), at.alias("at"), n_left.alias("n_left"), n_up_to.alias("n_up_to"))

    def finished(x: Column) -> Column:
        left, right = x["tok_id"] < x["head"], x["tok_id"] > x["head"]
        before, after = F.get(x["sib"], x["at"] - 2), F.get(x["sib"], x["at"])
        yes = lambda side, at: F.coalesce(side & (x["at"] == at), F.lit(False))
        between = F.when(left, x["n_left"] - x["at"]).otherwise(x["at"] - x["n_left"] - 1)
        return F.struct(
            *(x[c].alias(c) for c in own),
            before["word"].alias("left_word"), before["pos"].alias("left_pos"), after["word"].alias("right_word"), after["pos"].alias("right_pos"),
            yes(left, 1).alias("left_most"), yes(left, x["n_left"]).alias("nearest_left"), yes(right, F.size(x["sib"])).alias("right_most"), yes(right, x["n_up_to"] + 1).alias("nearest_right"),
            (between == F.abs(x["head"] - x["tok_id"]) - 1).alias("between_siblings"), F.size(x["kids"]).cast("long").alias("n_children"),
            F.exists(x["kids"], lambda y: F.coalesce(y["pos"] == "prel", F.lit(False))).alias("has_prel"),
        )

    return g.select(*(c for c in rows.columns if c != "t"), F.transform(F.transform(F.transform("t", first), placed), finished).alias("t"))


_SPAN = pa.schema([("sent_id", pa.int64()), ("tok_id", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())])


def _spans(batches):
    """All tokens of a batch walk up at once, a step a round, and leave their ids at the tokens they meet."""
    for b in batches:
        lists = b.column("ids")
        per = np.diff(lists.offsets.to_numpy())
        ids, heads = (b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in ("ids", "heads"))
        row = np.repeat(np.arange(len(per)), per)
        first = np.repeat(np.cumsum(per) - per, per)
        size = np.repeat(per, per)
        ids, heads = ids.astype(np.int64), np.nan_to_num(heads).astype(np.int64)
        # the nodes that anything meets: tokens, and heads that are none
        nodes, node = np.unique(np.stack([np.concatenate([row, row]), np.concatenate([ids, heads])]), axis=1, return_inverse=True)
        node = node.reshape(-1)
        low, high = np.full(nodes.shape[1], np.iinfo(np.int64).max), np.full(nodes.shape[1], -1)
        at, who = np.arange(len(ids)), np.arange(len(ids))
        place = node[: len(ids)]
        # in a circle of heads a walk meets nothing new after as many steps as there are tokens
        for _ in range(int(per.max(initial=0))):
            np.minimum.at(low, place, ids[who])
            np.maximum.at(high, place, ids[who])
            inside = at >= 0
            up = np.where(inside, heads[at], 0)
            go = up > 0
            at, who, up = at[go], who[go], up[go]
            place = node[len(ids) + at]
            at = np.where(up <= size[who], first[who] + up - 1, -1)
            if not len(at):
                break
        met = high >= 0
        yield pa.RecordBatch.from_arrays([b.column("sent_id").take(pa.array(nodes[0][met])), *(pa.array(x[met]) for x in (nodes[1], low, high))], schema=_SPAN)


def subtree_span(tokens: DataFrame) -> DataFrame:
    """sent_id, tok_id, span_start, span_end: first and last token of each token's subtree.

    Tokens walk up inside their sentence, those of many sentences at once; nothing moves."""
    g = grouped(tokens).select(F.col("sent_id").cast("long"), F.col("t.tok_id").alias("ids"), F.col("t.head").alias("heads"))
    s = g.mapInArrow(_spans, "sent_id long, tok_id long, span_start long, span_end long")
    return s.select("sent_id", *(F.col(c).cast("int").alias(c) for c in ("tok_id", "span_start", "span_end")))


def drop_blank_tokens(tokens: DataFrame) -> DataFrame:
    """tokens without childless `_` words; ids and heads are renumbered by the blanks before them."""
    g = grouped(tokens).select("sent_id", "t")
    gone = F.transform(F.filter("t", lambda x: (x["word"] == "_") & ~F.coalesce(F.array_contains("t.head", x["tok_id"]), F.lit(False))), lambda x: x["tok_id"])
    g = g.withColumn("gone", gone).select("sent_id", "t", "gone", F.col("t.tok_id").alias("ids"))
    less = lambda k: (k - F.size(F.filter("gone", lambda y: y <= k))).cast("int")
    head = lambda x: F.when(F.array_contains("ids", x["head"]), less(x["head"])).otherwise(F.lit(0))
    item = lambda x: F.struct(less(x["tok_id"]).alias("tok_id"), x["word"].alias("word"), x["pos"].alias("pos"), x["role"].alias("role"), head(x).alias("head"))
    return flat(g.select("sent_id", F.transform(F.filter("t", lambda x: ~F.array_contains("gone", x["tok_id"])), item).alias("t")))


def resolve_edit_rows(rows: DataFrame) -> DataFrame:
    """rows: sent_id, t and edits, an array of id `s-e` and parent `s-e` or root -> sent_id, head_id, child_id. Spans are found inside the row."""
    spans = F.transform("t", lambda x: F.struct(F.concat(x["start"], F.lit("-"), x["end"]).alias("span"), x["tok_id"].alias("tok_id")))
    g = char_offsets(rows.select("sent_id", "edits", "t")).select("sent_id", "edits", spans.alias("s"))
    of = lambda span: F.filter("s", lambda x: x["span"] == span)["tok_id"]
    known = F.transform("edits", lambda e: F.struct(of(e["id"]).alias("c"), of(e["parent"]).alias("h"), (e["parent"] == "root").alias("top")))
    found = flat(g.select("sent_id", known.alias("x")), "x").select("sent_id", F.explode("c").alias("child_id"), "h", "top").where("size(h) > 0 or top")
    return found.select("sent_id", F.explode_outer("h").alias("head_id"), "child_id").select("sent_id", F.coalesce("head_id", F.lit(0)).alias("head_id"), "child_id")


def resolve_span_edits(edits: DataFrame, tokens: DataFrame) -> DataFrame:
    """edits: sent_id, id `s-e`, parent `s-e` or root -> sent_id, head_id, child_id. One exchange by sent_id a side; resolve_edit_rows() needs none."""
    e = edits.groupBy("sent_id").agg(F.collect_list(F.struct("id", "parent")).alias("edits"))
    return resolve_edit_rows(grouped(tokens).join(e, "sent_id"))
