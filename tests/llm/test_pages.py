"""URL reputation, record fixity and HTML main text."""

import duckdb
import pytest
from pyspark.sql import functions as F

from moothall.llm import fixity, html_text, url_reputation
from moothall.llm.catalogue import ORACLES, QUERIES
from tools.check import TABLES, compare

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    text, good = compare(spark, con, SF_DIR, name, QUERIES[name], ORACLES[name])
    assert good, text


# ---- urls ----

URLS = [(1, "http://www.Example.ORG/es/x?y#z"), (2, "https://example.org/en/12"), (3, "https://example.org/en/2"), (4, "https://a.b.com/fr/"),
        (5, "https://com/de/q"), (6, "http://example.org"), (7, "http://notexample.org?es/"), (8, None), (9, "no scheme"), (10, "x://"),
        (11, "http://user@bad.host.co.uk:80/p"), (12, "http://10.0.0.1/a"), (13, "http://É.org/É"), (14, "a://b://c/d"), (14, "a://b://c/d")]


def pages(spark, rows=URLS):
    return spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "'n' AS name", "2 AS x", "3 AS n", "0.5 AS mean")


def test_hosts_paths_and_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge(pages(spark), none).collect()}
    assert found == {
        1: ("www.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("example.org", "/en/2", "org/", "allow"), 4: ("a.b.com", "/fr/", "com/fr/", "allow"), 5: ("com", "/de/q", "com/de/", "block"),
        6: ("example.org", "", None, "allow"), 7: ("notexample.org", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"),
        10: ("", "", None, "allow"), 11: ("user@bad.host.co.uk:80", "/p", None, "allow"), 12: ("10.0.0.1", "/a", None, "allow"),
        13: ("É.org", "/É", "org/", "allow"), 14: ("b:", "//c/d", None, "allow")}


def test_name_levels(spark):
    names = ["a.b.example.co.uk", "example.co.uk", "co.uk", "x.example.com.", "me@example.com:8080", "10.1.2.3", "localhost", ""]
    rows = spark.createDataFrame([(n,) for n in names], "h string").select(*url_reputation.name_levels(F.col("h"))).collect()
    assert [tuple(r) for r in rows] == [
        ("a.b.example.co.uk", "example.co.uk", "co.uk"), ("example.co.uk", "example.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"),
        ("x.example.com", "example.com", "com"), ("example.com", "example.com", "com"), ("10.1.2.3", "10.1.2.3", "ip"),
        ("localhost", "localhost", "localhost"), ("", "", "")]


def test_reputation_blocks_bad_hosts_and_shrinks_rare_ones(spark):
    rows, outcomes = [], []
    for host, n, bad in (("bad.one.net", 60, 57), ("good.one.net", 60, 3), ("rare.one.net", 2, 2), ("fine.two.net", 80, 4), ("x.three.net", 50, 2)):
        for k in range(n):
            rows.append((len(rows), f"http://{host}/{k}"))
            outcomes.append((len(outcomes), int(k < bad)))
    outcomes += [(0, 1), (None, 1), (7, None), (99999, 1)]
    labelled = spark.createDataFrame(outcomes, "page_id long, bad int")
    found = {r.host: (r.verdict, r.n_labels, r.n_bad) for r in url_reputation.judge(pages(spark, rows), labelled, rules=[url_reputation.Rule("allow", "x/")]).collect()}
    assert {h: v for h, (v, _, _) in found.items()} == {
        "bad.one.net": "block", "good.one.net": "allow", "rare.one.net": "allow", "fine.two.net": "allow", "x.three.net": "allow"}
    assert found["bad.one.net"][1:] == (60, 57)
    posterior = {r.name: r.alpha / (r.alpha + r.beta) for r in url_reputation.reputation(
        pages(spark, rows), labelled, "page_id", "url", "page_id", "bad").collect()}
    assert posterior["fine.two.net"] < posterior["rare.one.net"] < 1 and posterior["good.one.net"] < 0.3 < 0.8 < posterior["bad.one.net"]
    assert url_reputation.judge(pages(spark, rows).limit(0), labelled).count() == 0


# ---- fixity ----

def records(spark, rows):
    made = spark.createDataFrame(rows, "file string, offset long, length long, digest string, record long")
    return made.selectExpr("*", "1 AS node", "2 AS hash", "3 AS up")


def test_audit_finds_each_damage(spark):
    rows = [(f"f{k % 3}", 100 * k, 100, f"d{k}", k) for k in range(500)]
    copy = [r for r in rows if r[4] not in (33, 34)]
    copy = [(f, o, n, "broken" if k in (7, 499) else d, k) for f, o, n, d, k in copy] + [("f9", 0, 10, "new", 900), ("f1", 10_000_000, 5, "far", 901)]
    copy += [copy[0], copy[0]]
    found = fixity.audit(records(spark, rows), records(spark, copy), range_bytes=512, fanout=4).collect()
    assert sorted((r.record, r.problem) for r in found) == [(7, "changed"), (33, "missing"), (34, "missing"), (499, "changed"), (900, "extra"), (901, "extra")]
    assert fixity.audit(records(spark, rows), records(spark, rows[::-1])).count() == 0
    empty = records(spark, rows).limit(0)
    assert fixity.audit(empty, empty).count() == 0 and fixity.audit(records(spark, rows[:5]), empty).count() == 5


def test_roots_follow_content_and_descent_is_narrow(spark):
    rows = [("f", 64 * k, 64, f"d{k}", k) for k in range(256)]
    tree = fixity.build_tree(records(spark, rows), range_bytes=64, fanout=4)
    other = fixity.build_tree(records(spark, [*rows[:200], ("f", 64 * 200, 64, "x", 200), *rows[201:]]), range_bytes=64, fanout=4)
    assert [level.count() for level in tree] == [256, 64, 16, 4, 1]
    for a, b in zip(tree, other):  # one node differs on each level
        assert a.join(b.withColumnRenamed("hash", "other"), ["file", "node"]).filter("hash <> other").count() == 1


def test_index_of_odd_pages(spark):
    made = spark.createDataFrame([(1, None, None), (2, "u", "é"), (None, "u", "x"), (513, "", ""), (1, None, None)], "page_id long, url string, html string")
    index = fixity.index_pages(made)
    assert index.count() == 5 and index.filter("length > 0 AND digest IS NOT NULL AND offset >= 0").count() == 5


# ---- html ----

P = "This is a sentence of the article that is long enough to count as text, with some more words in it."


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("<p>", ""), ("just text &amp; more", "just text & more"), ("<script>x</script>", ""),
    (f"<nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>{P}<p>Short.<p>{P}</article><footer>(c)</footer>", f"Title\n\n{P}\n\nShort.\n\n{P}"),
    (f"<div class='sidebar'>{P}</div><main><p>a<br>b&nbsp;&#233;  c\n d</p><p>{P}</p></main>", f"a b é c d\n\n{P}"),
    (f"<article><p>{P}</p><div class='ad box'>Buy</div><section id=comments><p>{P} First!</p></section><aside>x</aside><p>End.</p></article>", f"{P}\n\nEnd."),
    (f"<article><header><h1>T</h1></header><p><b>{P}<br><p>Two</article>", f"T\n\n{P}\n\nTwo"),
    (f"<html><head><title>t</title><style>p{{}}</style></head><body><div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=x><p>{P}</p><p>Hm.</p><p>{P}</p></div></body>",
     f"{P}\n\nHm.\n\n{P}"),
    (f"<article><p>{P}</p><!-- no <p>comment</p> --><form><input><p>Mail me</p></form><p>cut of", f"{P}\n\ncut of"),
    (f"<form action=x><nav>m</nav><article><p>{P}</p></article></form>", P),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


ARTICLE = f"<article class='post category-social'><h1>Title</h1><p>{P}</p></article>"


@pytest.mark.parametrize("html", [
    f"<html class='no-ad'><body class='single has-sidebar nav-open'>{ARTICLE}</body></html>",
    f"<div class='content-sidebar-wrap'><main class='social'><p>Title<p>{P}</main><div class='sidebar'>{P}</div></div>",
    f"<div class='has-sidebar'><div class='nav-wrap'>{ARTICLE}</div><div class='widget'>{P}</div></div>",
    f"<main><div class='content-sidebar'>{ARTICLE}<div class='sidebar'>{P}</div></div></main>",
    f"<main>{ARTICLE}<section class='comments'><article class='comment'><p>{P}{P}</article></section></main>",
    f"{ARTICLE}<div class='sidebar'><article><p>{P}{P}{P}</article></div>",
    f"<article><p>Title<p>{P}<article class='comment'><p>{P}</article></article>",
    f"<div><p>Title<p>{P}</div><div class='related'><article><p>{P}{P}{P}</article></div>",
    f"<div><p>Title<p>{P}</div><div class='sidebar'><article><p>{P[:60]}</article></div>",
    f"<div class='comments-open'>{ARTICLE}</div>",
])
def test_layout_classes_keep_the_article(html):
    assert html_text.main_text(html) == f"Title\n\n{P}"


def test_long_and_nested_markup():
    assert html_text.main_text("<article>" + "<p>word " * 20_000).count("word") == 20_000
    assert html_text.main_text("<div>" * 5_000 + P) == P


def test_pages_keep_their_rows(spark):
    made = spark.createDataFrame([(1, "u", f"<p>{P}"), (1, "u", f"<p>{P}"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in html_text.extract_text(made).collect()))) == sorted(map(repr, [(1, "u", P), (1, "u", P), (None, None, "")]))
    assert html_text.extract_text(made.limit(0)).count() == 0


def test_the_limit_follows_the_base_rate(spark):
    """5 % of all pages are bad; a host with 30 % stands out, though it is far from half bad, a rare one of a good domain does not,
    and one that shares the domain of the bad one is judged by it."""
    rows, bad = [], []
    for host, n, n_bad in [*((f"h{k}.example.com", 50, 1 + k % 3) for k in range(40)), ("spam.example.net", 100, 30), ("rare.example.com", 2, 1), ("new.example.net", 2, 1)]:
        for k in range(n):
            bad.append((len(rows), int(k < n_bad)))
            rows.append((len(rows), f"http://{host}/{k}", ""))
    given = spark.createDataFrame(rows, "page_id long, url string, html string")
    labelled = spark.createDataFrame(bad, "page_id long, bad int")
    judged = url_reputation.judge(given, labelled, rules=[url_reputation.Rule("allow", "x/")])
    assert {r.host for r in judged.filter("verdict = 'block'").collect()} == {"spam.example.net", "new.example.net"}
    strict = url_reputation.judge(given, labelled, rules=[url_reputation.Rule("allow", "x/")], times_base=100.0)
    assert strict.filter("verdict = 'block'").count() == 0  # half bad at least


def test_suffixes_are_a_parameter(spark):
    name = spark.createDataFrame([("a.shop.com.sg",)], "h string").select(
        *url_reputation.name_levels(F.col("h")), *url_reputation.name_levels(F.col("h"), ("com.sg",))).first()
    assert tuple(name)[1:3] == ("com.sg", "sg") and tuple(name)[4:6] == ("shop.com.sg", "com.sg")
