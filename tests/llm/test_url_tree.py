"""The template tree of op5 against a recursive brute force."""

import sys
from collections import defaultdict

from arbora.llm import urls

PATHS = "host string, path string, n long, labelled long, blocked long"


def test_branches_without_labels_do_not_join_blocked_ones(spark):
    rows = [("h.com", f"/{s}/{k}.html", 1, int(s == "de"), int(s == "de")) for s in ("de", "en", "es") for k in range(20)]
    rows += [("g.com", f"/fr/{k}", 1, 1, 0) for k in range(20)]
    got = {(r.path.split("/")[1], r.template, r.rejected) for r in urls.judged(spark.createDataFrame(rows, PATHS)).collect()}
    assert got == {("de", "/~=/*", True), ("en", "/~/*", False), ("es", "/~/*", False), ("fr", "/~=/*", False)}


def test_unlabelled_pages_of_a_blocked_host_are_allowed(spark):
    rows = [(100 * i + k, f"https://blog.x.com/{s}/{k}.html") for i, s in enumerate(("de", "en")) for k in range(17)] + [(1000 + k, f"https://y.com/fr/{k}") for k in range(20)]
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), urls.rule_table(spark, urls.RULES)).collect()
    assert {(r.path[:3], r.verdict) for r in out} == {("/de", "block"), ("/en", "allow"), ("/fr", "allow")}


sys.setrecursionlimit(5000)


def brute(rows):
    """path -> template of one host's rows, by recursion."""
    out = {}

    def split(rows, template, d):
        out.update((r[1], template) for r, segs in rows if len(segs) == d)
        by = defaultdict(list)
        for r, segs in rows:
            if len(segs) > d:
                by[segs[d]].append((r, segs))
        total = {s: [sum(r[k] for r, _ in x) for k in (2, 3, 4)] for s, x in by.items()}
        all_n = sum(n for n, _, _ in total.values())
        literal = {s for s, (n, _, _) in total.items() if n >= urls.MIN_SUPPORT and n * 100 >= all_n * urls.MIN_SHARE}
        L, B = (sum(total[s][k] for s in literal) for k in (1, 2))
        share = (B + urls.A / 2) / (L + urls.A)
        branches = defaultdict(list)
        for s, x in by.items():
            _, lab, blk = total[s]
            like = lab and (blk / lab - B / max(L, 1)) ** 2 <= urls.Z2 * share * (1 - share) / lab + 1e-12
            branches["*" if s not in literal else "~" if not lab else "~=" if like else s] += x
        for key, x in branches.items():
            split(x, f"{template}/{key}", d + 1)

    split([(r, [s for s in r[1].split("/") if s]) for r in rows], "", 0)
    return out


def test_deep_paths_equal_brute_force(spark):
    deep = "/a/b/c/d"
    rows = [("h.com", f"{deep}/{s}/p/q/{k % 3}/{k}", 1 + k % 2, lab, lab * (s == "bad")) for s in ("bad", "good", "new") for k in range(12) for lab in [int(s != "new")]]
    rows += [("h.com", f"/a/x{'/y' * k}", 1, k % 2, 0) for k in range(9)] + [("h.com", "", 2, 0, 0), ("h.com", "/trap" * 40, 1, 0, 0)]
    df = spark.createDataFrame(rows, PATHS)
    got = {r.path: (r.template, r.rejected) for r in urls.judged(df).collect()}
    assert {p: t for p, (t, _) in got.items()} == brute(rows)
    assert {p.split("/")[5] for p, (_, bad) in got.items() if bad} == {"bad"}


def test_shared_segments_are_passed_at_once(spark):
    """Two deep paths that part once, one that ends on the way, one of 1,000 segments with copies, and prefixes that are no segments."""
    long = "/s" * 1000
    rows = [("h.com", long, 10, 0, 0)]
    stem = "/k/l/m" + "".join(f"/n{i}" for i in range(60))
    rows += [("g.com", f"{stem}/{x}{tail}", 6, lab, lab) for x, lab in (("left", 1), ("right", 0)) for tail in ("/u/v/w", "/u/v-w", "/u/v")]
    rows += [("g.com", stem, 7, 2, 0), ("g.com", stem + "/left-over/z", 6, 0, 0), ("g.com", stem[:-1], 6, 0, 0)]
    df = spark.createDataFrame(rows, PATHS)
    rounds = []
    keep = urls.materialize
    try:
        urls.materialize = lambda df, tag: (rounds.append(tag), keep(df, tag))[1]
        got = {(r.host, r.path): r.template for r in urls.judged(df).collect()}
    finally:
        urls.materialize = keep
    for host in ("h.com", "g.com"):
        mine = [r for r in rows if r[0] == host]
        assert {p: t for (h, p), t in got.items() if h == host} == brute(mine)
    assert sum(t.startswith("op5-rows") for t in rounds) < 10
