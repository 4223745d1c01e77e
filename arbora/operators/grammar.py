"""Grammar induction by counting: rule events, their probabilities, evidence and contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions import scalars, tags
from .storage import stored
from .trees import flat, grouped


def relative_order(offsets: Column) -> Column:
    """Signed offsets -> ranks: 1, 2, ... to the right by nearness, -1, -2, ... to the left. Equal offsets share a rank."""
    right = F.array_sort(F.array_distinct(F.filter(offsets, lambda x: x > 0)))
    left = F.array_sort(F.transform(F.array_distinct(F.filter(offsets, lambda x: x < 0)), lambda x: -x))
    return F.transform(offsets, lambda x: F.when(x > 0, F.array_position(right, x)).when(x < 0, -F.array_position(left, -x)).otherwise(F.lit(0)).cast("int"))


def _node_rows(tokens: DataFrame) -> DataFrame:
    """sent_id and nodes, an array of the tokens but blanks, each with base tag (before a hyphen), role class, `[tag@role]`,
    the ids and units of its complement children in position order (null without any), the tag of its head and its type of rule.

    Children and heads are found inside the sentence's row: complements sorted by head make the children of
    a token one slice, so that a token costs two searches in an array and no loop over lambdas."""
    own = ("tok_id", "word", "base", "head", "kind", "unit")
    base = lambda x: F.split_part(x["pos"], F.lit("-"), F.lit(1))
    unit = lambda x: F.struct(x["tok_id"].alias("tok_id"), x["word"].alias("word"), base(x).alias("base"), x["head"].alias("head"), scalars.role_class(x["role"]).alias("kind"), F.concat(F.lit("["), base(x), F.lit("@"), x["role"], F.lit("]")).alias("unit"))
    u = grouped(tokens).select("sent_id", F.transform(F.filter("t", lambda x: x["word"] != "_"), unit).alias("u"))
    complements = F.filter("u", lambda y: (y["kind"] == "complement") & y["head"].isNotNull())
    u = u.withColumn("kids", F.array_sort(F.transform(complements, lambda y: F.struct(y["head"].alias("head"), y["tok_id"].alias("tok_id"), y["unit"].alias("unit")))))
    u = u.select("sent_id", "u", "kids", F.col("kids.head").alias("kid_heads"), F.col("u.tok_id").alias("ids"), F.col("u.base").alias("bases"))

    def children(x: Column) -> Column:
        at = F.array_position("kid_heads", x["tok_id"])
        return F.when(at > 0, F.slice("kids", at.cast("int"), F.size("kid_heads") - F.size(F.array_remove("kid_heads", x["tok_id"]))))

    up = lambda x: F.get("bases", F.array_position("ids", x["head"]).cast("int") - 1)
    node = F.transform("u", lambda x: F.struct(*(x[c].alias(c) for c in own), children(x).alias("c"), up(x).alias("head_base")))

    def finished(x: Column) -> Column:
        childless, adjunct = x["c"].isNull(), (x["kind"] == "adjunct") & x["head_base"].isNotNull()
        kind = F.when((x["kind"] == "complement") & ~childless, 1).when(adjunct & childless, 2).when(adjunct, 3)
        units = F.array_join(x["c"]["unit"], ",")
        return F.struct(*(x[c].alias(c) for c in own), x["head_base"].alias("head_base"), x["c"]["tok_id"].alias("child_ids"), units.alias("child_units"), kind.alias("type"))

    return u.select("sent_id", F.transform(node, finished).alias("nodes"))


def _rule(x, word: Column) -> Column:
    """A node's rule with the given text as its word: the specific form with the word, the generic one without."""
    one = F.concat(word, F.lit("["), x["base"], F.lit("] --> "), x["child_units"])
    up = F.concat(F.lit("["), x["head_base"], F.lit("] --> "), word, x["unit"])
    return F.when(x["type"] == 1, one).when(x["type"] == 2, up).otherwise(F.concat(up, F.lit(" --> "), x["child_units"]))


_RULE = pa.schema([("sent_id", pa.int64()), ("tok_id", pa.int32()), ("type", pa.int32()), ("head_key", pa.string()), ("rule", pa.string()), ("word_order", pa.string())])


def rule_events(tokens: DataFrame) -> DataFrame:
    """sent_id, tok_id, type, head_key, rule, word_order; specific (word/tag) and generic (tag) form of each rule.

    Type 1: a complement node with complement children. Type 2: an adjunct child without, type 3: an
    adjunct child with complement children, both keyed by the child. Those of a batch of sentences are found in numpy."""
    own = lambda x: F.struct(*(x[c].alias(c) for c in ("tok_id", "word", "pos", "role", "head")))

    def run(batches):
        for b in batches:
            yield _batch_rules(b)

    return grouped(tokens).select(F.col("sent_id").cast("long"), F.transform("t", own).alias("t")).mapInArrow(run, from_arrow_schema(_RULE))


_GROUP = pa.schema([("type", pa.int32()), ("head_key", pa.string()), ("rule", pa.string()), ("word_order", pa.string()), ("n", pa.int64()), ("trees", pa.list_(pa.int64()))])


def rule_groups(tokens: DataFrame) -> DataFrame:
    """type, head_key, rule, word_order, n, trees: rule_events() counted up, with their distinct trees. A row for each batch of
    sentences that has such events: generic rules are few in a batch, so that most of their events never become rows."""
    own = lambda x: F.struct(*(x[c].alias(c) for c in ("tok_id", "word", "pos", "role", "head")))

    def run(batches):
        for b in batches:
            yield _grouped_rules(_batch_rules(b))

    return grouped(tokens).select(F.col("sent_id").cast("long"), F.transform("t", own).alias("t")).mapInArrow(run, from_arrow_schema(_GROUP))


def rule_trees(tokens: DataFrame) -> DataFrame:
    """type, head_key, rule, n: trees that have the rule. A sentence is one row, so its events meet in one batch."""
    own = lambda x: F.struct(*(x[c].alias(c) for c in ("tok_id", "word", "pos", "role", "head")))
    keys = _GROUP.names[:3]

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([_batch_rules(b)]).group_by([*keys, "sent_id"], use_threads=False).aggregate([])
            t = t.group_by(keys, use_threads=False).aggregate([([], "count_all")]).rename_columns([*keys, "n"])
            yield from t.cast(pa.schema(list(_GROUP)[:3] + [_GROUP.field("n")])).to_batches()

    g = grouped(tokens).select(F.col("sent_id").cast("long"), F.transform("t", own).alias("t"))
    return g.mapInArrow(run, "type int, head_key string, rule string, n long").groupBy(*keys).agg(F.sum("n").alias("n"))


def _grouped_rules(events: pa.RecordBatch) -> pa.RecordBatch:
    """The rows of rule_groups() of a batch's events."""
    keys = _GROUP.names[:4]
    n = np.zeros(len(events), np.int64)
    for c in keys:
        n = np.unique(n * (len(events) + 2) + events.column(c).dictionary_encode().indices.fill_null(len(events)).to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)[1].reshape(-1)
    ids = events.column("sent_id").to_numpy(zero_copy_only=False)
    order = np.lexsort((ids, n))
    n, ids = n[order], ids[order]
    new = np.concatenate([[True], n[1:] != n[:-1]])[: len(n)]
    other = new | np.concatenate([[True], ids[1:] != ids[:-1]])[: len(n)]
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(n)))
    trees = np.diff(np.append(np.searchsorted(np.flatnonzero(other), at), int(other.sum())))
    first = events.take(pa.array(order[at]))
    return pa.RecordBatch.from_arrays([*(first.column(c) for c in keys), pa.array(sizes), _lists(trees, pa.array(ids[other]))], schema=_GROUP)


def _lists(sizes: np.ndarray, items: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), items)


def _ranks(event: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """relative_order() of each event's offsets."""
    span = 2 * int(np.abs(offset).max(initial=0)) + 1
    seen, at = np.unique(event * span + offset + span // 2, return_inverse=True)
    e, o = seen // span, seen % span - span // 2
    at = at.reshape(-1)
    # offsets of an event are a run of seen: right of them ranks count from the first positive, left of them back from the last negative one
    up_to, below = np.searchsorted(seen, e * span + span // 2, "right"), np.searchsorted(seen, e * span + span // 2)
    k = np.arange(len(seen))
    return np.where(o > 0, k - up_to + 1, np.where(o < 0, k - below, 0))[at]


def _batch_rules(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Both forms of the events of a batch of sentences. Tokens are numbered through; heads and children are found by search."""
    t, ids = rows.column("t"), rows.column("sent_id")
    sentence = np.repeat(np.arange(len(ids)), np.diff(t.offsets.to_numpy()))
    own = t.flatten()
    keep = np.asarray(pc.fill_null(pc.and_kleene(pc.not_equal(own.field("word"), "_"), pc.is_valid(own.field("tok_id"))), False))
    own, sentence = own.filter(pa.array(keep)), sentence[keep]
    tok = own.field("tok_id").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((tok, sentence))
    own, sentence, tok = own.take(pa.array(order)), sentence[order], tok[order]
    up = pc.fill_null(own.field("head"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.asarray(pc.is_valid(own.field("head")))
    tagged = np.asarray(pc.is_valid(own.field("pos")))
    role, roles = _coded(pc.fill_null(own.field("role"), ""))
    pos, poses = _coded(pc.fill_null(own.field("pos"), ""))
    base, bases = _renamed(pos, [x.split("-")[0] for x in poses])
    kind = np.array([_class(x) for x in roles], np.int64)[role]
    low = int(min(tok.min(initial=0), up.min(initial=0)))
    span = int(max(tok.max(initial=0), up.max(initial=0))) - low + 1
    key, wanted = sentence * span + tok - low, sentence * span + up - low
    n = len(key)
    at = np.minimum(np.searchsorted(key, wanted), max(n - 1, 0))
    has = known & (key[at] == wanted)
    # complements by head, in order of position: a token's children are one run
    kids = np.flatnonzero((kind == 1) & known)
    kids = kids[np.argsort(wanted[kids], kind="stable")]
    start = np.searchsorted(wanted[kids], key)
    many = np.searchsorted(wanted[kids], key, "right") - start
    under = has & tagged[at]
    kind_of = np.where((kind == 1) & (many > 0), 1, np.where((kind == 2) & under, np.where(many > 0, 3, 2), 0))
    event = np.flatnonzero(kind_of)
    kind_of = kind_of[event]
    children = np.where(kind_of == 2, 0, many[event])
    total, m = int(children.sum()), len(event)
    of = np.repeat(np.arange(m), children)
    child = kids[np.arange(total) - np.repeat(np.cumsum(children) - children, children) + np.repeat(start[event], children)]
    # places of the head, of type 3, and of the children
    heads = np.flatnonzero(kind_of == 3)
    ranks = _ranks(np.concatenate([heads, of]), np.concatenate([up[event[heads]], tok[child]]) - tok[event[np.concatenate([heads, of])]])
    numbers, codes = np.unique(ranks, return_inverse=True)
    texts = pa.array([str(x) for x in numbers.tolist()], pa.string()).take(pa.array(codes.reshape(-1)))
    join = lambda *x: pc.binary_join_element_wise(*x, "")
    first = np.zeros(m, np.int64)
    first[heads] = np.arange(len(heads))
    placed = pc.binary_join(_lists(children, texts.slice(len(heads))), ",")
    one, two = pa.array(kind_of == 1), pa.array(kind_of == 2)
    lead = pc.if_else(one, "0", texts.take(pa.array(first)) if len(heads) else pa.array([None] * m, pa.string()))
    side = pc.if_else(pa.array(up[event] > tok[event]), "1 --> 0", "-1 --> 0")
    word_order = pc.if_else(two, side, join(pc.if_else(one, "0 --> ", join(lead, " --> 0 --> ")), placed))
    # units; those without a tag are not listed
    nb = max(len(bases), 1)
    listed = tagged[child] & np.asarray(pc.is_valid(own.field("role")))[child]
    unit, unit_codes = np.unique(np.concatenate([role[child[listed]] * nb + base[child[listed]], role[event] * nb + base[event]]), return_inverse=True)
    unit = pa.array([f"[{bases[c % nb]}@{roles[c // nb]}]" for c in unit.tolist()], pa.string())
    unit_codes, some = unit_codes.reshape(-1), int(listed.sum())
    below = pc.binary_join(_lists(np.bincount(of[listed], minlength=m), unit.take(pa.array(unit_codes[:some]))), ",")
    own_base = pa.array(bases, pa.string()).take(pa.array(base[event], mask=~tagged[event]))
    self_ = pc.if_else(pa.array(tagged[event]), unit.take(pa.array(unit_codes[some:])), pa.scalar(None, pa.string()))
    tag = join("[", pc.if_else(one, own_base, pa.array(bases, pa.string()).take(pa.array(base[at[event]]))), "]")
    tail = pc.if_else(one, join(" --> ", below), pc.if_else(two, self_, join(self_, " --> ", below)))
    word = own.field("word").take(pa.array(event))
    generic = join(tag, pc.if_else(one, "", " --> "), tail)
    specific = pc.if_else(one, join(word, tag, tail), join(tag, " --> ", word, tail))
    cols = [ids.take(pa.array(sentence[event])), pa.array(tok[event].astype(np.int32)), pa.array(kind_of.astype(np.int32)), join(word, "/", own_base), specific, word_order]
    cols = [pa.concat_arrays([c.cast(f.type), (other if other is not None else c).cast(f.type)]) for c, f, other in zip(cols, _RULE, (None, None, None, own_base, generic, None))]
    return pa.RecordBatch.from_arrays(cols, schema=_RULE)


_EVENT = pa.schema([("sent_id", pa.int64()), ("tok_id", pa.int32()), ("type", pa.int32()), ("word", pa.string()), ("base", pa.string()), ("rule", pa.string()), ("demand", pa.list_(pa.string())), ("first", pa.bool_())])


def _coded(x: pa.Array) -> tuple[np.ndarray, list[str]]:
    """A number for each text and the texts by number."""
    d = x.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def _renamed(codes: np.ndarray, texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """As coded, for texts that may repeat."""
    names = {x: k for k, x in enumerate(dict.fromkeys(texts))}
    return np.array([names[x] for x in texts], np.int64)[codes], list(names)


def _class(role: str) -> int:
    first = role.split("/")[0]
    return 1 if first in tags.COMPLEMENTS else 2 if first in tags.ADJUNCTS else 0


def _batch_events(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Events of a batch of sentences. Tokens are numbered through; a head is found among its sentence's tokens by search."""
    t, ids = rows.column("t"), rows.column("sent_id")
    sentence = np.repeat(np.arange(len(ids)), np.diff(t.offsets.to_numpy()))
    own = t.flatten()
    keep = pc.and_(pc.is_valid(own.field("role")), pc.not_equal(own.field("word"), "_"))
    keep = np.asarray(pc.fill_null(keep, False))
    own, sentence = own.filter(pa.array(keep)), sentence[keep]
    tok = own.field("tok_id").to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((tok, sentence))
    own, sentence, tok = own.take(pa.array(order)), sentence[order], tok[order]
    up = pc.fill_null(own.field("head"), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    role, roles = _coded(own.field("role"))
    pos, poses = _coded(own.field("pos"))
    base, bases = _renamed(pos, [x.split("-")[0] for x in poses])
    kind = np.array([_class(x) for x in roles], np.int64)[role]
    span = int(max(tok.max(initial=0), up.max(initial=0))) + 2
    key, wanted = sentence * span + tok, sentence * span + up
    n = len(key)
    at = np.minimum(np.searchsorted(key, wanted), max(n - 1, 0))
    has = (up >= 0) & (key[at] == wanted)
    # complements by head, in order of position: a token's children are one run
    kids = np.flatnonzero((kind == 1) & has)
    kids = kids[np.argsort(at[kids], kind="stable")]
    many = np.bincount(at[kids], minlength=n)
    start = np.cumsum(many) - many
    kind_of = np.where((kind == 1) & (many > 0), 1, np.where((kind == 2) & has, np.where(many > 0, 3, 2), 0))
    event = np.flatnonzero(kind_of)
    kind_of = kind_of[event]
    # what is demanded: of an adjunct its head's tag first, then a complement's role, tag and side of the token or, of type 3, of its head
    nb = max(len(bases), 1)
    children = np.where(kind_of == 2, 0, many[event])
    total = int(children.sum())
    child = kids[np.arange(total) - np.repeat(np.cumsum(children) - children, children) + np.repeat(start[event], children)]
    centre = np.repeat(np.where(kind_of == 3, up[event], tok[event]), children)
    units = role[child] * nb + base[child]
    head = event[kind_of != 1]
    takes = role[head] * nb + base[at[head]]
    codes = np.concatenate([((units * 2 + (tok[child] >= centre)) * 2), (takes * 2 + (up[head] > tok[head])) * 2 + 1])
    order = np.argsort(np.concatenate([np.repeat(np.arange(len(event)), children) * 2 + 1, np.flatnonzero(kind_of != 1) * 2]), kind="stable")
    named, codes = np.unique(codes[order], return_inverse=True)
    names = [f"{roles[c // 4 // nb]}:{'<-a-' if c % 2 else '>-c-'}{bases[c // 4 % nb]}-{'R' if c // 2 % 2 else 'L'}" for c in named.tolist()]
    offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
    demand = pa.ListArray.from_arrays(offsets(children + (kind_of != 1)), pa.array(names, pa.string()).take(pa.array(codes)))
    # the generic rule
    unit, unit_codes = np.unique(np.concatenate([units, role[event] * nb + base[event]]), return_inverse=True)
    unit = pa.array([f"[{bases[c % nb]}@{roles[c // nb]}]" for c in unit.tolist()], pa.string())
    below = pc.binary_join(pa.ListArray.from_arrays(offsets(children), unit.take(pa.array(unit_codes[:total]))), ",")
    self_ = unit.take(pa.array(unit_codes[total:]))
    tag = pa.array([f"[{x}]" for x in bases], pa.string()).take(pa.array(np.where(kind_of == 1, base[event], base[at[event]])))
    join = lambda *x: pc.binary_join_element_wise(*x, " --> ")
    rule = pc.if_else(pa.array(kind_of == 1), join(tag, below), pc.if_else(pa.array(kind_of == 2), join(tag, self_), join(tag, self_, below)))
    # the first of its rule in the sentence; a rule's text and type tell its key
    same = rule.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + kind_of
    first = np.zeros(len(event), bool)
    first[np.unique(sentence[event] * (int(same.max(initial=0)) + 1) + same, return_index=True)[1]] = True
    cols = [ids.take(pa.array(sentence[event])), pa.array(tok[event].astype(np.int32)), pa.array(kind_of.astype(np.int32)), own.field("word").take(pa.array(event)), pa.array(bases, pa.string()).take(pa.array(base[event])), rule, demand, pa.array(first)]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, _EVENT)], schema=_EVENT)


def event_demands(tokens: DataFrame) -> DataFrame:
    """sent_id, tok_id, type, word, base, rule, demand, first: one row for each of rule_events() in its generic form, with its
    demands (as scoring.rule_demands() lists them) from the tree itself; first marks one event of each rule in a sentence."""
    own = lambda x: F.struct(*(x[c].alias(c) for c in ("tok_id", "word", "pos", "role", "head")))

    def run(batches):
        for b in batches:
            yield _batch_events(b)

    return grouped(tokens).select("sent_id", F.transform("t", own).alias("t")).mapInArrow(run, from_arrow_schema(_EVENT))


def _share(counts: DataFrame, key: list[str]) -> DataFrame:
    """counts with p: n over the sum of n by key. Totals are joined, so a hot key is not one window."""
    return counts.join(counts.groupBy(*key).agg(F.sum("n").alias("total")), key).withColumn("p", F.col("n") / F.col("total")).drop("total")


def rule_probabilities(events: DataFrame) -> DataFrame:
    """level rule: P(rule | type, head_key); level order: P(order | type, rule). Columns level, type, key, outcome, n, p.
    events: rule_events(), or with n, how often each was counted, in a table that is cheap to read twice."""
    # events are counted once, in tasks before they move, and stored: else each level would count them anew, as Spark filters
    # and narrows both differently. Dealt by rule, the counts give the sums, totals and joins of the level order without a further exchange
    by = ("type", "head_key", "rule", "word_order")
    counts = events.select(*by, "n") if "n" in events.columns else stored(events.groupBy(*by).agg(F.count("*").alias("n")), "rule-counts")
    counts = counts.repartition("type", "rule")
    rules = _share(counts.groupBy("type", "head_key", "rule").agg(F.sum("n").alias("n")), ["type", "head_key"])
    orders = _share(counts.groupBy("type", "rule", "word_order").agg(F.sum("n").alias("n")), ["type", "rule"])
    a = rules.select(F.lit("rule").alias("level"), "type", F.col("head_key").alias("key"), F.col("rule").alias("outcome"), "n", "p")
    return a.unionByName(orders.select(F.lit("order").alias("level"), "type", F.col("rule").alias("key"), F.col("word_order").alias("outcome"), "n", "p"))


def rule_evidence(events: DataFrame) -> DataFrame:
    """type, rule, word_order, sent_id: distinct supporting trees."""
    return events.select("type", "rule", "word_order", "sent_id").distinct()


def context_counts(tokens: DataFrame) -> DataFrame:
    """kind, context, outcome, n: root rules; child rules given the head's rule and side; STOP without adjuncts.

    A node's key is its generic rule: `2:` or `3:` for adjuncts, `1:` for complements with complements; else its tag."""
    key = lambda x: F.when(x["type"].isNotNull(), F.concat(x["type"].cast("string"), F.lit(":"), _rule(x, F.lit("")))).otherwise(x["base"])
    node = lambda x: F.struct(x["tok_id"].alias("tok_id"), x["head"].alias("head"), x["kind"].alias("kind"), key(x).alias("key"))
    n = _node_rows(tokens).select(F.transform("nodes", node).alias("k"))
    n = n.select("k", F.col("k.tok_id").alias("ids"), F.transform(F.filter("k", lambda x: x["kind"] == "adjunct"), lambda x: x["head"]).alias("taken"))
    counted = lambda kind, context, outcome: F.struct(kind.alias("kind"), context.alias("context"), outcome.alias("outcome"))
    up = lambda x: F.get("k", F.array_position("ids", x["head"]).cast("int") - 1)["key"]
    side = lambda x: F.when(x["tok_id"] > x["head"], "+R").otherwise("+L")
    child = F.transform(F.filter("k", lambda x: (x["kind"] != "unknown") & F.array_contains("ids", x["head"])), lambda x: counted(x["kind"], F.concat(up(x), side(x)), x["key"]))
    root = F.transform(F.filter("k", lambda x: x["head"] == 0), lambda x: counted(F.lit("root"), F.lit("root"), x["key"]))
    stop = F.transform(F.filter("k", lambda x: ~F.coalesce(F.array_contains("taken", x["tok_id"]), F.lit(False))), lambda x: counted(F.lit("adjunct"), F.concat(x["key"], F.lit("+0+True")), F.lit("STOP")))
    return flat(n.select(F.concat(child, root, stop).alias("x")), "x").groupBy("kind", "context", "outcome").agg(F.count("*").alias("n"))


def root_tags(tokens: DataFrame) -> DataFrame:
    return tokens.where("head = 0").select("pos").distinct()


def vocabulary(text: DataFrame) -> DataFrame:
    """word: distinct white-space words of column text, in byte order."""
    return text.select(F.explode(F.split("text", r"[ \t\n\r]+")).alias("word")).where("word <> ''").distinct().orderBy("word")


def merge_lexicon(entries: DataFrame) -> DataFrame:
    """word, tags: union of the tag arrays of each word, sorted."""
    tag = entries.select("word", F.explode("tags").alias("tag")).distinct()
    return tag.groupBy("word").agg(F.array_sort(F.collect_list("tag")).alias("tags"))


def pair_counts(arcs: DataFrame) -> DataFrame:
    """t1, t2, direction, distance (1..3), n from arcs with head_pos, pos, head, tok_id."""
    d = F.least(F.abs(F.col("head") - F.col("tok_id")), F.lit(3))
    return arcs.groupBy(F.col("head_pos").alias("t1"), F.col("pos").alias("t2"), (F.col("head") > F.col("tok_id")).cast("int").alias("direction"), d.alias("distance")).agg(F.count("*").alias("n"))


def backoff_probability(counts: DataFrame) -> DataFrame:
    """t1, t2, direction, distance, p: interpolated share of the direction at a distance."""
    at = lambda k: F.coalesce(F.sum(F.when(F.col("distance") == k, F.col("n"))), F.lit(0)).cast("double")
    n = counts.groupBy("t1", "t2", "direction").agg(*(at(k).alias(f"n{k}") for k in (1, 2, 3)))
    m = counts.groupBy("t1", "t2").agg(*(at(k).alias(f"m{k}") for k in (1, 2, 3)))
    wide = n.join(m, ["t1", "t2"]).withColumn("distance", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p = None
    for d, (a, b) in ((1, (2, 3)), (2, (1, 3)), (3, (1, 2))):
        nd, md, na, nb, ma, mb = (F.col(x) for x in (f"n{d}", f"m{d}", f"n{a}", f"n{b}", f"m{a}", f"m{b}"))
        value = 0.5 * share(nd, md) + 0.3 * share(na, md + ma) + 0.1 * share(nb, md + mb) + 0.1 * 0.0001
        p = F.when(F.col("distance") == d, value) if p is None else p.when(F.col("distance") == d, value)
    return wide.select("t1", "t2", "direction", "distance", p.alias("p"))
