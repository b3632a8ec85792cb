import duckdb
import numpy as np
from pyspark.sql import functions as F

from quern.llm import queries, urls


def test_section_roots_and_relative_targets(spark):
    link = lambda x: f"<link rel='canonical' href='{x}'>"
    refresh = lambda x: f'<meta http-equiv="refresh" content="0; url={x}">'
    rows = [
        (1, "http://z.net/1", link("http://a.com/en/")),  # the target is a blocked section
        (2, "http://z.net/2", link("http://y.org/es/2") + link("http://x.net/de/")),  # an allowed one goes first
        (3, "http://q.net/dir/page1.html", link("page2.html")),
        (4, "http://q.net/dir/page2.html", link("http://y.org/es/9")),
        (5, "http://q.net/p?id=1", refresh("?id=3")),
        (6, "http://q.net/p?id=3", link("http://y.org/es/8")),
        (7, "http://q.net/e", link("/f?a=1&amp;b=2")),
        (8, "http://q.net/f?a=1&b=2", link("http://y.org/es/7")),
        (9, "http://q.net/g", link("http://[bad") + link("../h") + link("mailto:x")),
        (10, "http://b.com/en/", link("http://z.net/10")),  # a page's own url votes as it is written
        (11, "http://z.net/10", None),
        (12, "http://q.net/free", link("http://c.com/en")),  # no slash: not that section
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    assert verdict == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "block", 9: "allow", 10: "block", 11: "block", 12: "allow"}


def test_other_columns_do_not_matter(spark):
    rows = [(1, "http://z.net/1", "<link rel=canonical href=http://y.org/es/1>"), (2, None, None)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = plain.withColumns({c: F.lit("x") for c in ("host", "path", "rule", "verdict", "address", "u", "t", "a", "b", "node", "root", "named", "v")})
    assert sorted(map(str, urls.judge(clash).collect())) == sorted(map(str, urls.judge(plain).collect()))


def test_planted_links_match_the_sql(spark, tmp_path):
    """Chains, stars and rings of links over rules of both kinds, by both queries."""
    rng = np.random.default_rng(4)
    sections = ["en/1", "en/7", "en/77", "de/1", "de/8", "de/", "es/2", "x/1", "y"]
    url = lambda i: f"http://h{i % 7}.{['com', 'net', 'org', 'example.com', 'example.net', 'Example.ORG', 'info'][i % 7]}/{sections[i % 9]}/p{i}" + ["", "?q=1", "/", "#f"][i % 4]
    rows = []
    for i in range(400):
        to = int(rng.integers(0, 400))
        target = [url(to), url(to).replace("http:", ""), "/" + sections[to % 9] + f"/p{to}", f"p{to}", f"?a={to}&amp;b=2", "#top", "mailto:x"][int(rng.integers(0, 7))]
        html = ["", f"<p><LINK href='{target}' rel=canonical>", f'<meta content="3; URL={target}" http-equiv="refresh">', f"<link rel=stylesheet href='{target}'>"][int(rng.integers(0, 4))]
        rows.append((i, url(i) if i % 50 else None, html if i % 33 else None))
    rows += [(1, url(1), ""), (500, "noscheme/en/", "<link rel=canonical href=/en/>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, (tuple(r) for r in queries.op7_url_rules(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.oracle_sql()['op7_url_rules']})").fetchall()
    assert got == sorted(map(str, want))
    inherited = [r for r in want if r[3] is None and r[4] == "block"]
    assert len(inherited) > 10


def test_many_pages_without_an_address(spark):
    """Null, blank and relative urls are allowed, each as a row of its own."""
    rows = [(i, [None, "", "no scheme", "://"][i % 4], '<link rel="canonical" href="http://example.net/de/8">') for i in range(400)] + [(1000, "http://x.org/es/1", None), (1001, "http://y.org/1", '<link rel=canonical href="http://x.org/es/1">')]
    got = {r.page_id: (r.host, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 402 and all(got[i] == ("", "allow") for i in range(400)) and got[1000][1] == got[1001][1] == "block"
