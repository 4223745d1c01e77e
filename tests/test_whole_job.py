"""Queries over the whole derived treebank, against brute force in Python on a small table."""

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from arbora.functions import tags
from arbora.operators import features, grammar, scoring
from arbora.plans import fixtures, queries

TEXTS = ["the big cat sees a dog on extraordinary roads and 12 birds sing loudly today", "we go home"]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


@pytest.fixture(scope="module")
def sents(spark, sf):
    """Tokens by sentence, with the root at place 0."""
    out = {}
    for r in sorted(fixtures.tokens(spark, sf).collect(), key=lambda r: (r.sent_id, r.tok_id)):
        out.setdefault(r.sent_id, [None]).append(r)
    return out


def coarse(tag):
    return tag if tag in ("-S-", "-E-", "-M-") else tags.COARSE.get(tag, tag.upper())


def candidates(sents):
    """label and parts of every pair of every sentence, both ways; b: tags between, by kind."""
    for rows in sents.values():
        w, t = ["<root>"] + [r.word for r in rows[1:]], ["<root-POS>"] + [r.pos for r in rows[1:]]
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for way, h, c in (("L", j, i), ("R", i, j)):
                    near = j == i + 1
                    p = {"dir": way, "dist": str(min(j - i - 1, 5)), "hw": w[h], "cw": w[c], "ht": t[h], "ct": t[c], "it": t[i], "jt": t[j]}
                    p |= {"itp": t[i - 1] if i else "-S-", "jtn": t[j + 1] if j + 1 < len(w) else "-E-", "itn": "-M-" if near else t[i + 1], "jtp": "-M-" if near else t[j - 1]}
                    p |= {k.replace("t", "s"): coarse(v) for k, v in list(p.items()) if k in ("ht", "ct", "it", "jt", "itp", "jtn", "itn", "jtp")}
                    b = {"t": sorted(set(t[i + 1 : j])), "s": sorted({coarse(x) for x in t[i + 1 : j]})}
                    p |= {f"bet{k}": "+".join(v) for k, v in b.items() if v}
                    yield "Yes" if c and rows[c].head == h else "No", p, b


def filled(templates, first, separator, p):
    return [f"{k}{separator}" + "/".join(p[x] for x in t.split()) for k, t in enumerate(templates, first) if all(x in p for x in t.split())]


def linear(p, b):
    between = [f"{len(features.LINEAR) + n}:{p['i' + k]}/{x}/{p['j' + k]}" + (f"/{p['dir']}/{p['dist']}" if more else "") for n, (k, more) in enumerate(features.LINEAR_BETWEEN) for x in b[k]]
    return filled(features.LINEAR, 0, ":", p) + between


def counts(df):
    return Counter({tuple(r)[:-1]: r.n for r in df.collect()})


def sums(values):
    """Rows, characters and checksum of texts, as the queries sum them up."""
    return (len(values), sum(map(len, values)), sum(int(hashlib.md5(v.encode()).hexdigest()[:8], 16) for v in values))


def by(pairs):
    """Texts by key, summed up."""
    out = defaultdict(list)
    for key, value in pairs:
        out[key].append(value)
    return {k: sums(v) for k, v in out.items()}


def summed(df, *keys):
    return {tuple(r[k] for k in keys): (r.n, r.chars, r.digest) for r in df.collect()}


def test_arc_features_of_all_candidates(spark, sf, sents):
    cands = list(candidates(sents))
    assert len(cands) == sum(len(r) * (len(r) - 1) for r in sents.values())
    maxent = [(label, p["dir"], filled(features.MAXENT, 1, "-", p)) for label, p, _ in cands]
    lin = [(label, p["dir"], linear(p, b)) for label, p, b in cands]
    tokens = fixtures.tokens(spark, sf)
    for operator, want in ((features.maxent_arc_features, maxent), (features.linear_arc_features, lin)):
        got = operator(features.arc_candidates(tokens)).select("label", "dir", "features").collect()
        assert Counter((r.label, r.dir, tuple(r.features)) for r in got) == Counter((label, way, tuple(fs)) for label, way, fs in want)
    for query, want in ((queries.maxent_arc_features, maxent), (queries.linear_arc_features, lin)):
        assert summed(query(spark, sf), "label", "dir", "n_features") == by(((label, way, len(fs)), " ".join(fs)) for label, way, fs in want)
    assert summed(queries.write_events(spark, sf), "label") == by(((label,), " ".join([label, *fs])) for label, _, fs in maxent)
    ids = {f: k for k, f in enumerate(sorted({f for label, _, fs in lin for f in fs if label == "Yes"}))}
    assert {r.feature: r.fid for r in queries._dictionary(spark, sf).collect()} == ids
    got = {r.template: (r.ids, r.first_id, r.last_id) for r in queries.feature_dictionary(spark, sf).collect()}
    own = defaultdict(list)
    for f, k in ids.items():
        own[int(f.split(":")[0])].append(k)
    assert got == {t: (sum(k), min(k), max(k)) for t, k in own.items()}
    known = Counter((ids[f] % 1000, way) for _, way, fs in lin for f in fs if f in ids)
    assert {(r.fid_mod, r.dir): r.n for r in queries.vectorise(spark, sf).collect()} == known


def test_label_features_of_all_templates(spark, sf, sents):
    rows = features.label_features(fixtures.tokens(spark, sf)).collect()
    got = Counter((r.role, f) for r in rows for f in r.features)
    seen = {int(f.split("-")[0]) for _, f in got}
    under = [(r, rows[r.head]) for rows in sents.values() for r in rows[1:] if r.head]
    assert Counter({k: v for k, v in got.items() if k[1].startswith("9-")}) == Counter((r.role, f"9-{h.pos}/{r.pos}") for r, h in under)
    # templates with args lack a row only where the role has no class
    always = set(range(1, 21)) | set(range(31, 47))
    assert always <= seen and seen == set(range(1, 47))
    for k in always:
        assert sum(n for (_, f), n in got.items() if f.startswith(f"{k}-")) == len(under), k
    want = by(((role, int(f.split("-")[0])), f) for (role, f), n in got.items() for _ in range(n))
    assert summed(queries.label_features(spark, sf), "role", "template") == want


def test_dictionary_lattice_of_all_words(spark, sf, sents):
    words = {r.word for rows in sents.values() for r in rows[1:]}
    want = {}
    for k, rows in sents.items():
        text = "".join(r.word for r in rows[1:])
        found = [(i, j) for i in range(len(text)) for j in range(i + 1, len(text) + 1) if text[i:j] in words]
        want[k] = (len(found), sum(i for i, _ in found))
    assert {r.doc_id: (r.n, r.starts) for r in queries.dictionary_lattice(spark, sf).collect()} == want


def test_rules_of_one_sentence_count(spark, sf, sents):
    n, rules = Counter(), {}
    for r in grammar.rule_events(fixtures.tokens(spark, sf)).select("type", "head_key", "rule", "sent_id").distinct().collect():
        n[r.type, r.head_key, r.rule] += 1
        rules.setdefault(r.head_key, set()).add((r.type, r.rule))
    assert 1 in n.values()
    want = Counter()
    for rows in sents.values():
        for t in rows[1:]:
            key = f"{t.word}/{t.pos}"
            want.update((k, key, rule) for k, rule in rules.get(key, ()))
            if key not in rules and t.pos not in tags.NO_GENERIC_RULES:
                for k in {k for k, _ in rules.get(t.pos, ())}:
                    want[k, t.pos, max((n[k, t.pos, rule], rule) for x, rule in rules[t.pos] if x == k)[1]] += 1
    assert counts(queries.rules_for_tokens(spark, sf)) == want


def scored(spark, sf, sents):
    """sent_id, head, child and the sums of both outcomes' weights for every candidate."""
    ids = {r.feature: r.fid for r in queries._dictionary(spark, sf).collect()}
    arcs = [(k, *((j, i) if way == "L" else (i, j))) for k, rows in sents.items() for i in range(len(rows)) for j in range(i + 1, len(rows)) for way in "LR"]
    for arc, (_, p, b) in zip(arcs, candidates(sents), strict=True):
        known = [ids[f] for f in linear(p, b) if f in ids]
        yield *arc, sum(x % 7 - 3 for x in known), sum(x % 5 - 2 for x in known)


@pytest.mark.parametrize("name", ["score_arcs", "force_arcs", "arc_log_prob"])
def test_scores_of_all_candidates(spark, sf, sents, name):
    x, forced, probs = defaultdict(lambda: [0, 0.0]), defaultdict(float), Counter()
    for k, h, c, y, o in scored(spark, sf, sents):
        x[k][0] += 1
        x[k][1] += y * c
        forced[k] += 9999 if c and sents[k][c].pred_head == h else y
        probs[float(y), float(o), round(math.log(1 / (1 + math.exp(o - y))), 9)] += 1
    assert any(r.pred_head != r.head for rows in sents.values() for r in rows[1:])
    rows = getattr(queries, name)(spark, sf)
    if name == "arc_log_prob":
        assert counts(rows) == probs
    else:
        assert {r.sent_id: [r.n, r.x] if name == "score_arcs" else r.x for r in rows.collect()} == dict(x if name == "score_arcs" else forced)


def test_licenses_of_all_candidates(spark, sf, sents):
    n, rules, orders = Counter(), defaultdict(set), defaultdict(set)
    events = grammar.rule_events(fixtures.tokens(spark, sf))
    for r in scoring.rule_demands(events.select("type", "rule", "word_order").distinct()).collect():
        orders[r.type, r.rule].update(r.demand)
    for r in events.select("type", "head_key", "rule", "sent_id").distinct().collect():
        n[r.type, r.head_key, r.rule] += 1
        rules[r.head_key].add((r.type, r.rule))
    kinds = {d.split(":")[1][:2] for x in orders.values() for d in x}
    assert kinds == {">-", "<-"}

    def demands(t):
        own = rules.get(f"{t.word}/{t.pos}")
        if own is None:
            own = set() if t.pos in tags.NO_GENERIC_RULES else {max((n[k, t.pos, r], k, r) for k, r in rules[t.pos] if k == kind)[1:] for kind in {k for k, _ in rules.get(t.pos, ())}}
        return {tuple(d.split(":", 1)) for rule in own for d in orders[rule]}

    roots = {r.pos for rows in sents.values() for r in rows[1:] if r.head == 0}
    want = Counter()
    for rows in sents.values():
        for c, t in enumerate(rows[1:], 1):
            for h in range(len(rows)):
                if h != c:
                    head_pos, right = rows[h].pos if h else "<root-POS>", c > h
                    roles = {r for r, key in demands(rows[h]) if key == f">-c-{t.pos}-{'R' if right else 'L'}"} if h else set()
                    roles |= {r for r, key in demands(t) if key == f"<-a-{head_pos}-{'L' if right else 'R'}"}
                    score = round(math.log(0.1) if (t.pos not in roots if h == 0 else not roles) else 0.0, 9)
                    want[h == 0, ",".join(sorted(roles)), int(h != 0 and not roles), score] += 1
    assert {b for b in want if b[0]} and counts(queries.license_arcs(spark, sf)) == want
