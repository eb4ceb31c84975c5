import random

import duckdb
from pyspark.sql import functions as F

from lorekeep.llm import urlfilter as U

LINK = '<html><link href="{}" rel="canonical" ><a href="http://no.example.org/es/">x</a></html>'


def test_rules_and_aliases(spark):
    urls = [
        (1, "https://A.Example.org/es/x?y#z", ""),
        (2, "http://example.org/en/17", ""),
        (3, "http://example.org/en/27", ""),
        (4, "http://q.com/de/", ""),
        (5, "http://com/fr/", ""),
        (6, "http://net.net/de/", ""),
        (7, None, None),
        (8, "no url", "<p>"),
        (9, "http://other.net/a", "<link rel='canonical' href='https://q.com/de/1?x=1&amp;y=2'>"),  # to a blocked url that isn't a page
        (10, "http://other.net/b", '<META http-equiv="refresh" content="0; URL=/a">'),  # to 9, so blocked with it
        (11, "http://example.org/en/3", LINK.format("http://other.net/b")),  # an alias too, but allowed by its rule
        (12, "https://other.net/b#frag", None),  # the same as 10
        (13, "http://free.net/a", LINK.format("http://free.net/b")),
        (13, "http://free.net/a", LINK.format("http://free.net/b")),
        (14, "http://x.net?q", "canonical"),
        (15, "://#", ""),
        (16, "http://notexample.org/es/", ""),
    ]
    want = {1: ("example.org/es/", "block"), 2: ("example.org/en/1", "block"), 3: ("org/", "allow"), 4: ("com/de/", "block"), 5: ("com/fr/", "allow"), 6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"),
            9: (None, "block"), 10: (None, "block"), 11: ("org/", "allow"), 12: (None, "block"), 13: (None, "allow"), 14: (None, "allow"), 15: (None, "allow"), 16: ("org/", "allow")}
    pages = spark.createDataFrame([(*u, "c", "n") for u in urls], "page_id long, url string, html string, component string, node string")
    rows = U.url_table(pages).collect()
    assert len(rows) == len(urls) and {r["page_id"]: (r["rule"], r["verdict"]) for r in rows} == want
    at = {r["page_id"]: (r["host"], r["path"]) for r in rows}
    assert at[1] == ("a.example.org", "/es/x") and at[7] == at[8] == at[15] == ("", "") and at[14] == ("x.net", "")


def test_long_chains_and_hubs(spark):
    n = 60
    chain = [(f"http://c.net/{k}", f"http://c.net/{k + 1}") for k in range(n)] + [(f"http://h.net/{k}", "http://h.net/hub") for k in range(300)]
    pages = spark.createDataFrame([(k, f"http://c.net/{k}", None) for k in range(n)] + [(1000 + k, f"http://h.net/{k}", None) for k in range(300)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([*chain, (f"http://c.net/{n}", "http://q.com/de/z"), ("http://h.net/hub", "http://q.com/fr/")], "src string, dst string")
    rows = U.judge(pages, redirects).collect()
    assert {r["verdict"] for r in rows if r["page_id"] < n} == {"block"} and {r["verdict"] for r in rows if r["page_id"] >= 1000} == {"allow"}


def test_all_tags_and_relative_targets(spark):
    link = lambda to, rel="canonical": f'<link rel="{rel}" href="{to}">'
    at = "http://r.net/a/b/c?q=1"
    want = {
        link("page/5"): "r.net/a/b/page/5", link("../x"): "r.net/a/x", link("../../../x/./y/.."): "r.net/x/", link("?id=2"): "r.net/a/b/c?id=2", link("/d/../e?u=http://z.net"): "r.net/e?u=http://z.net",
        link("x?y=../z"): "r.net/a/b/x?y=../z", link("//S.net/y#f"): "s.net/y", link("HTTPS://s.net/y?a=1&amp;b=2"): "s.net/y?a=1&b=2", link("n", "nofollow Canonical"): "r.net/a/b/n",
        link("mailto:a@b.c"): None, link("#top"): None, link("n", "canonical-not"): None, link("n", "next") + "canonical": None, "<linked rel=canonical href=n>": None,
        "<link href=n rel=canonical>": "r.net/a/b/n", "<meta content='5; url=m' http-equiv=Refresh>": "r.net/a/b/m", '<meta http-equiv="refresh" content="5">': None,
    }
    pages = spark.createDataFrame([(f"{at}&k={k}", h) for k, h in enumerate(want)], "url string, html string")
    got = {r["a"]: r["b"] for r in U.page_edges(pages).collect()}
    assert got == {f"r.net/a/b/c?q=1&k={k}": b for k, b in enumerate(want.values()) if b}
    many = link("http://one.net/") + link("two") + '<meta http-equiv="refresh" content="0;url=three"><meta http-equiv="refresh" content="0;url=http://q.com/de/x">'
    pages = spark.createDataFrame([(1, "http://free.net/a/", many), (2, "http://free.net/a/two", None), (3, "http://free.net/a/b", link("../a/three", "alternate canonical")), (4, "http://free.net/z", None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in U.url_table(pages).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_planted_links_against_sql(spark, small, tmp_path):
    """The pages of the small table with links of one kind each, absolute or from the root, as the SQL follows them."""
    pages = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    rng, planted = random.Random(8), []
    for k, (i, url, html) in enumerate(pages):
        to = rng.choice(pages)[1] if k % 3 else "http://q.com/de/%d" % k if k % 2 else "/other/%d" % k
        tag = (f'<link href="{to}" rel="canonical">', f'<meta http-equiv="refresh" content="0; url={to}">', "", "")[rng.randrange(4)]
        planted.append((i, url, tag + (html or "")))
    planted += [(9000, "http://free.net/" + "x" * 50_000, "y" * 200_000), (9001, None, '<link rel="canonical" href="http://q.com/de/">'), (9002, "http://q.com/de/", None)] * 2
    frame = spark.createDataFrame(planted, "page_id long, url string, html string")
    frame.write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    result = con.sql(U.URL_ORACLE)
    names = ["page_id", "host", "path", "rule", "verdict"]
    want = sorted((tuple(r[result.columns.index(c)] for c in names) for r in result.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in names) for r in U.url_table(frame).collect()), key=str)
    assert got == want
    assert sum(r[3] is None and r[4] == "block" for r in got) > 3  # blocked by an alias alone


def test_ties_of_rules(spark):
    rules = [U.Rule("block", "a.com", "/x"), U.Rule("allow", "a.com", "/x"), U.Rule("block", "com", "/xyzab")]
    frame = spark.createDataFrame([("b.a.com", "/xyzabc"), ("b.a.com", "/x1"), ("ba.com", "/x1")], "host string, path string")
    got = [(r["r"] and tuple(r["r"])) for r in frame.select(U.rule_of(F.col("host"), F.col("path"), rules).alias("r")).collect()]
    assert got == [("com/xyzab", "block"), ("a.com/x", "allow"), None]  # the longest, of equal ones the one that allows


def test_empty(spark):
    assert U.url_table(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
