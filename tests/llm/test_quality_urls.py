import duckdb
import pytest

from arbora.llm import oracle, quality, urls

DOCS = "doc_id long, text string, source string, lang string, kept string"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def letters(n):
    """Digits count as equal in lines, so words that shall differ have none."""
    return "".join(chr(97 + int(c)) for c in str(n))


def sql_rows(name, table, columns, rows):
    con = duckdb.connect()
    con.sql(f"CREATE TABLE {table} ({columns})")
    if rows:
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    r = con.sql(oracle.SQL[name])
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


def test_quality_equals_sql(spark):
    banner = "All  RIGHTS reserved 2024"
    rows = [(k, f"{banner.upper() if k % 2 else banner}\nword " + " ".join(f"{letters(k)}x{letters(i)}" for i in range(15)), "h", None, "x") for k in range(30)]
    rows += [(100 + k, f"{banner}\n{banner}\n{banner}\n a{k} b c d e", "h", None, "x") for k in range(5)]
    rows += [(200, None, None, None, "x"), (201, "", "h", None, "x"), (202, "a b c d e f a b c d e g h i j", "i", None, "x"), (203, "x " * 50, None, "en", "x"), (204, " \n\t\n a\n a\na\n", "i", None, "x")]
    rows += [(205, "#tag <b> " + "é " * 12, "i", None, "x"), (3, rows[3][1], "h", None, "x"), (3, rows[3][1], "h", None, "x"), (None, rows[4][1], "h", None, "x"), (206, "z " * 60000, "q", None, "x")]
    got = rows_of(quality.quality(spark.createDataFrame(rows, DOCS)))
    assert got == sql_rows("op2_quality_rules", "documents", "doc_id BIGINT, text VARCHAR, source VARCHAR, lang VARCHAR, kept VARCHAR", rows)
    by = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert by[5].kept and by[5].removed_lines == 1 and not by[102].kept and by[202].n_repeat_words == 10 and by[206].base_failed
    clean = {r.doc_id: r.text for r in quality.without_frequent_lines(spark.createDataFrame(rows, DOCS)).collect()}
    assert clean[5] == rows[5][1].split("\n")[1] and clean[202] == rows[37][1]


def test_copies_are_one_document(spark):
    rows = [(k, "the same line of eleven words is here in each of them\nagain other", "h", None, None) for k in range(40)]
    assert all(r.kept for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect())


def test_quality_empty(spark):
    assert quality.quality(spark.createDataFrame([], DOCS)).count() == 0


URLS = [
    "https://a.com/fr/1", "https://A.B.com/de/2?x#y", "http://c.example.org/es/9", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://xorg/", "http://x.org?u/", None, "", "no scheme", "a://b://c/d", "http://net/fr",
    "HTTP://H.COM/de", "http://u@h.com:80/de/", "http://é.com/de/ü", "x://y.com/de/a\nb",
]


@pytest.mark.parametrize("size", [0, 1, 40])
def test_urls_equal_sql(spark, size):
    rows = [(k, u, "h") for k, u in enumerate(URLS * min(size, 1))]
    for k in range(size):
        for lang in ("fr", "de", "en", "es"):
            rows.append((1000 + k, f"http://big.com/{lang}/{k}.html", None))
            rows.append((2000 + k, f"http://mix.com/{lang if lang in ('de', 'en') else 'de'}x/../{lang}/{k}/a/b/c/{k}", None))
            rows.append((3000 + k, f"http://small{k % 15}.com/de/{k}", None))
            rows.append((3000 + k, f"http://small{k % 15}.com/zz/{k}", None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = rows_of(urls.filter_urls(df, urls.rule_table(spark, urls.RULES)))
    assert got == sql_rows("op5_url_filters", "pages", "page_id BIGINT, url VARCHAR, html VARCHAR", rows)
    if size:
        by = {r.page_id: r for r in urls.filter_urls(df, urls.rule_table(spark, urls.RULES)).collect()}
        assert (by[0].rule, by[1].rule, by[1].host) == ("com/fr/", "com/de/", "a.b.com")
        assert (by[2].rule, by[3].rule, by[4].rule, by[5].rule) == ("example.org/es/", "example.org/en/1", "org/", None)
        assert (by[8].host, by[10].path, by[11].host) == ("", "", "b:")


def test_merge_keeps_blocked_branches_apart(spark):
    paths = [("h", f"/{s}/{k}", 1, int(s != "new"), int(s == "bad")) for s in ("bad", "good", "new", "new2") for k in range(30)]
    df = spark.createDataFrame([(h, p, n, 0 if "new" in p else lab, b) for h, p, n, lab, b in paths], "host string, path string, n long, labelled long, blocked long")
    got = {r.path.split("/")[1]: r.template for r in urls.templates(df).collect()}
    assert got == {"bad": "/bad/*", "good": "/good/*", "new": "/~/*", "new2": "/~/*"}
    assert {r.path.split("/")[1] for r in urls.judged(df).where("rejected").collect()} == {"bad"}
