"""Rule events and their probabilities against a plain reading of random trees."""

import random
from collections import Counter

from arbora.operators import grammar

ROLES = {"subj": "complement", "dobj": "complement", "root": "complement", "det": "adjunct", "modr": "adjunct", "other": "unknown", None: "unknown"}


def rows(n_sentences=60):
    """Heads at random: null, 0, out of range and the token itself are among them."""
    rng = random.Random(7)
    out = []
    for s in range(n_sentences):
        n = rng.choice([1, 2, 5, 9, 40])
        for k in range(1, n + 1):
            head = rng.choice([None, 0, n + 3, *([rng.randint(1, n)] * 9)])
            out.append((s, k, rng.choice(["a", "b", "_", "c"]), rng.choice(["ncn", "vt", "adj"]), rng.choice(list(ROLES)), head))
    rng.shuffle(out)
    return out


def ranks(offsets):
    right, left = sorted({x for x in offsets if x > 0}), sorted({-x for x in offsets if x < 0})
    return [right.index(x) + 1 if x > 0 else -left.index(-x) - 1 if x < 0 else 0 for x in offsets]


def plain(table):
    trees = {}
    for s, k, word, pos, role, head in table:
        if word != "_":
            trees.setdefault(s, {})[k] = (word, pos, ROLES[role], f"[{pos}@{role}]", head)
    text = lambda x: ",".join(map(str, x))
    out = Counter()
    for tree in trees.values():
        for k, (word, pos, kind, unit, head) in tree.items():
            kids = sorted(c for c, x in tree.items() if x[4] == k and x[2] == "complement")
            units = ",".join(tree[c][3] for c in kids)
            if kind == "complement" and kids:
                order = f"0 --> {text(ranks([c - k for c in kids]))}"
                made = [(1, f"{w}[{pos}] --> {units}", order) for w in (word, "")]
            elif kind == "adjunct" and head in tree:
                up = f"[{tree[head][1]}] --> "
                if kids:
                    first, *rest = ranks([head - k, *(c - k for c in kids)])
                    made = [(3, f"{up}{w}{unit} --> {units}", f"{first} --> 0 --> {text(rest)}") for w in (word, "")]
                else:
                    made = [(2, f"{up}{w}{unit}", "1 --> 0" if head > k else "-1 --> 0") for w in (word, "")]
            else:
                continue
            for key, (kind_, rule, order) in zip((f"{word}/{pos}", pos), made):
                out[kind_, key, rule, order] += 1
    return out


def test_events_and_probabilities_of_random_trees(spark):
    table = rows()
    tokens = spark.createDataFrame(table, "sent_id long, tok_id int, word string, pos string, role string, head int").repartition(7)
    tokens = tokens.where("role is not null")  # a unit without a role has no text
    want = plain([r for r in table if r[4] is not None])
    events = grammar.rule_events(tokens)
    got = Counter((r.type, r.head_key, r.rule, r.word_order) for r in events.collect())
    assert got == want and {k[0] for k in got} == {1, 2, 3}

    levels = Counter()
    for (kind, key, rule, order), n in want.items():
        levels["rule", kind, key, rule] += n
        levels["order", kind, rule, order] += n
    totals = Counter()
    for (level, kind, key, _), n in levels.items():
        totals[level, kind, key] += n
    p = {(r.level, r.type, r.key, r.outcome): (r.n, r.p) for r in grammar.rule_probabilities(events).collect()}
    assert p == {k: (n, n / totals[k[:3]]) for k, n in levels.items()}


def test_no_tokens(spark):
    none = spark.createDataFrame([], "sent_id long, tok_id int, word string, pos string, role string, head int")
    assert grammar.rule_probabilities(grammar.rule_events(none)).count() == 0
