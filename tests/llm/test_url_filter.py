"""URL filters: rules and aliases against a plain version, the query against
its SQL, also on pages that are given links."""

import random
import re

import duckdb
from oracle import compare, duck

from cartlake.llm import url_filter as uf
from cartlake.llm.queries import OP12_SQL, URL_RULES, op12_url_filter
from conftest import SF_SMALL

PAGE = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path, rest = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$", url).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    query = rest.split("#")[0]
    return host, path, host + ("" if path.startswith("/") else "/") + path + query


def own_rule(url, rules):
    host, path, _ = split(url)
    fits = [(len(h + p), len(h), a == "allow", h + p, a) for a, h, p in rules
            if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def verdicts(pages, rules, edges=()):
    """Union-find over nodes, then rule, alias allow, alias block, allow."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    told = {}
    for a, b in edges:
        if split(a)[2] and split(b)[2]:
            root[find(split(a)[2])] = find(split(b)[2])
    for url in {u for e in edges for u in e}:
        action = own_rule(url, rules)[1]
        if action and split(url)[2]:
            told.setdefault(find(split(url)[2]), set()).add(action)
    out = []
    for page, url in pages:
        rule, action = own_rule(url, rules)
        alias = told.get(find(split(url)[2]), set()) if split(url)[2] else set()
        out.append((page, *split(url)[:2], rule, action or ("allow" if "allow" in alias or not alias else "block")))
    return out


def key(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def rules_df(spark, rules):
    return spark.createDataFrame(rules, "action string, host string, path string")


URLS = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?q#f", "http://example.com", "http://example.com/en",
        "http://example.com/en/", "http://notexample.com/en/1", "https://www.example.com/en/1", "http://x.www.example.com/en/",
        "ftp://b.net/es/1", "http://net/fr/", "http://b.net/de/1", "http://b.org/es/?u=http://c.com/", "http://.com/",
        "http://com/", "http://a.com?x/en/", "http://a.com#/en/", "http://ÄB.net/es/ü", "http://b.net//es/", "x://y://z/"]


def test_rules_alone(spark):
    pages = list(enumerate(URLS)) + [(3, "http://com/")] * 2
    df = spark.createDataFrame([(i, u, None) for i, u in pages], PAGE)
    for rules in (URL_RULES, [("block", "com", "/"), ("allow", "com", "/"), ("block", "", "/"), ("allow", "b.net", "")], []):
        assert key(uf.judge(df, rules_df(spark, rules)).collect()) == key(verdicts(pages, rules))


def test_aliases_by_random_redirects(spark):
    rng = random.Random(7)
    hosts = ["a.example.com", "b.example.net", "c.org", "www.example.com", "d.org", "e.org"]
    urls = [f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'de'])}/{i % 60}" for i in range(240)]
    pages = list(enumerate(urls))
    edges = [(rng.choice(urls), rng.choice(urls + ["http://gone.net/fr/9", "broken"])) for _ in range(110)]
    edges += [(f"http://hub.org/{i}", "http://hub.org/0") for i in range(300)]     # one hot target
    edges += [(f"http://chain.org/{i}", f"http://chain.org/{i + 1}") for i in range(40)] + [("http://chain.org/40", "http://q.net/es/")]
    pages += [(1000 + i, f"http://chain.org/{i}") for i in range(41)] + [(2000, "http://hub.org/7")]
    df = spark.createDataFrame([(i, u, "<p>") for i, u in pages], PAGE)
    got = uf.judge(df, rules_df(spark, URL_RULES), spark.createDataFrame(edges, "url string, target string")).collect()
    assert key(got) == key(verdicts(pages, URL_RULES, edges))
    assert {r.verdict for r in got if r.page_id in range(1000, 1041)} == {"block"}


LINKED = [
    (1, "http://a.org/1", '<html><head><LINK href="http://b.net/es/1" REL="Canonical"></head>'),
    (2, "http://a.org/2", "<link rel='canonical' href='/1'><link rel=stylesheet href=/style.css>"),
    (3, "https://a.org/3", '<meta http-equiv="refresh" content="0; url=//a.org/2">'),
    (4, "http://a.org/4", "<a href='http://b.net/es/1'>canonical refresh</a>"),
    (5, "http://www.example.com/en/5", '<link rel="canonical" href="http://a.org/1">'),
    (6, "http://b.net/es/1", None), (7, "http://c.org/x/7?p=1#t", "<link rel=canonical href=http://b.net/fr/>"),
    (8, "https://c.org/x/7?p=1", "refresh"), (9, "http://c.org/x/7", ""), (10, None, "<link rel=canonical href=http://b.net/fr/>"),
    (11, "http://d.org/e", '<link rel=canonical href="mailto:x"><link rel="canonical" href="">'),
]


def test_links_in_html(spark):
    df = spark.createDataFrame(LINKED, PAGE)
    found = {(r.url, r.target) for r in uf.html_edges(df).collect()}
    assert found == {("http://a.org/1", "http://b.net/es/1"), ("http://a.org/2", "http://a.org/1"),
                     ("https://a.org/3", "https://a.org/2"), ("http://www.example.com/en/5", "http://a.org/1"),
                     ("http://c.org/x/7?p=1#t", "http://b.net/fr/")}
    got = {r.page_id: r.verdict for r in uf.judge(df, rules_df(spark, URL_RULES)).collect()}
    # 1, 2 and 3 are aliases of a blocked and of an allowed url: allow precedes
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block", 9: "allow",
                   10: "allow", 11: "allow"}
    less = {r.page_id: r.verdict for r in uf.judge(df.filter("page_id <> 5"), rules_df(spark, URL_RULES)).collect()}
    assert less[1] == less[2] == less[3] == "block"


def test_relative_targets(spark):
    base = "https://h.org/d/e.html?q=1"
    want = {"f": "https://h.org/d/f", "/g": "https://h.org/g", "//i.org/": "https://i.org/", "?r": "https://h.org/d/e.html?r",
            "http://j.org": "http://j.org", "mailto:k": None}
    df = spark.createDataFrame([(t, base) for t in want], "t string, b string")
    assert {r.t: r.x for r in df.select("t", uf.absolute(df.t, df.b).alias("x")).collect()} == want
    one = spark.createDataFrame([("x", "http://h.org")], "t string, b string")
    assert one.select(uf.absolute(one.t, one.b)).first()[0] == "http://h.org/x"


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "http://a.net/es/", "", "u")], "page_id long, url string, html string, host string") \
        .withColumns({c: clash(c) for c in ("node", "rule", "action", "component", "decided", "target", "path", "to")})
    assert [tuple(r) for r in uf.judge(df, rules_df(spark, URL_RULES)).collect()] == [(1, "a.net", "/es/", "net/es/", "block")]
    assert uf.judge(df.limit(0), rules_df(spark, URL_RULES)).count() == 0


def clash(name):
    from pyspark.sql import functions as F

    return F.lit(f"clash {name}")


def test_query_equals_sql(spark, tmp_path):
    ok, said = compare(spark, op12_url_filter, OP12_SQL, SF_SMALL, duck(SF_SMALL))
    assert ok, said
    rows = [r for r in LINKED if r[0] not in (10, 11)] + [(50 + i, u, "<p>") for i, u in enumerate(URLS)]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ok, said = compare(spark, op12_url_filter, OP12_SQL, str(tmp_path), con)
    assert ok, said
