import re
from urllib.parse import urljoin

import pytest

from netlens.llm import url_filter as uf
from netlens.llm.queries import OP3_SQL, URL_RULES

PAGES = [
    (1, "http://a.net/es/1", ""),
    (2, "https://a.net/x", "<link rel='canonical' href='http://a.net/es/1#top'>"),
    (3, "http://b.org/", '<META HTTP-EQUIV="Refresh" CONTENT="0; URL=//A.NET/x?utm_source=q">'),
    (4, "http://b.org?utm_campaign=1&k=2", "<a rel=canonical href=/fr/>"),
    (5, "http://www.example.com/en/7", '<link href="/en/8" rel="canonical">'),
    (6, "http://example.com/en/7", None),
    (7, "http://x.com/z", '<meta property="og:url" content="http://a.net/x/">'),
    (8, "http://EXAMPLE.com", '<link rel="canonical" href="http://a.net/x">'),
    (9, None, "<link rel=canonical href=http://a.net/x>"),
    (10, "no url", ""),
    (11, "http://notexample.com/en/", ""),
    (12, "ftp://a.net/es", ""),
    (13, "http://a.net:80/fr/", ""),
    (14, "http://b.org/#f", ""),
    (14, "http://b.org/#f", ""),
    (15, "http:///path?x", ""),
    (16, "http://a.net/d/e", "<link rel='alternate canonical' href='../es/x'>"),
    (17, "http://r.org/1", '<link rel="canonical" href="http://r.org/2"><link rel="next" href="n"><link href=http://c.net/fr/ rel=Canonical>'),
    (18, "http://c.net/y/z.html", '<meta property="og:title" content="x"><meta content="?k=1" property="og:url"/>'),
    (19, "http://c.net/y/z.html?k=1", '<meta http-equiv=refresh content="5;url=../fr/./a">'),
    (20, "http://c.net/q", "<link rel=canonical href='#top'><link rel=canonical href='mailto:a@b.net'><link rel=canonical href=''>"),
    (21, "http://c.net", "<link rel=canonical href='w?u=http://a.net/es/'><link data-rel=canonical href='/es/'>"),
    (22, "http://t.org/a", "<link rel=canonical href='//c.net/fr/..'>"),
    (23, "http://t.org/b", "<link rel=canonical href='http://u.net/x'><link rel=canonical href='http://c.net/es/'>"),
    (24, "http://u.net/x", "<link rel='not-canonical' href='/es/'>"),
]


def brute(pages, rules):
    def parse(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
        return (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")

    def rule(url):
        h, p, _ = parse(url)
        fits = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        return max(fits, key=lambda r: (len(r[0] + r[1]), r[2] == "allow", len(r[0])), default=None)

    def node(url):
        h, p, q = parse(url)
        kept = [x for x in q[1:].split("&") if x and not x.lower().startswith("utm_")]
        return h + re.sub("/$", "", p) + ("?" + "&".join(kept) if kept else "") if h else None

    def attribute(tag, name):
        m = re.search(rf"""[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", tag, re.I)
        return next((x for x in m.groups() if x is not None), "").strip() if m else ""

    def targets(url, html):
        for tag in re.findall(r"<(?:link|meta)\b[^>]*>", html or "", re.I):
            x = ""
            if tag.lower().startswith("<link"):
                if "canonical" in attribute(tag, "rel").lower().split():
                    x = attribute(tag, "href")
            elif attribute(tag, "property").lower() == "og:url":
                x = attribute(tag, "content")
            elif attribute(tag, "http-equiv").lower() == "refresh":
                x = re.search(r"""\burl\s*=\s*['"]?([^"'\s>]+)""", attribute(tag, "content"), re.I)[1]
            if x and x[0] != "#" and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?!//)", x):
                yield urljoin(url, x)

    groups, blocked = {}, set()
    for _, url, html in pages:
        urls = [url] + (list(targets(url, html)) if node(url) else [])
        nodes = [n for n in map(node, urls) if n]
        blocked |= {node(u) for u in urls if rule(u) and rule(u)[2] == "block"}
        merged = set(nodes).union(*(groups.get(n, set()) for n in nodes))
        for n in merged:
            groups[n] = merged
    out = []
    for i, url, _ in pages:
        r, (h, p, _) = rule(url), parse(url)
        bad = node(url) and blocked & groups[node(url)]
        out.append((i, h, p, r and r[0] + r[1], r[2] if r else "block" if bad else "allow"))
    return sorted(out, key=repr)


def run(spark, pages, rules=URL_RULES):
    got = uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3), rules)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    got = run(spark, PAGES)
    assert got == brute(PAGES, URL_RULES)
    verdicts = {r[0]: r[4] for r in got}
    assert [verdicts[k] for k in (2, 3, 7, 12, 14)] == ["block", "block", "allow", "allow", "block"]
    assert [verdicts[k] for k in (16, 17, 18, 19)] == ["block"] * 4 and (verdicts[20], verdicts[24]) == ("allow", "block")


def test_sql_with_links(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    assert sorted(con.execute(OP3_SQL).fetchall(), key=repr) == brute(PAGES, URL_RULES)


@pytest.mark.parametrize("target", ["b", "./b/", "../b?x", "../../b", "/b/../c/.", "//h.org/q", "?k=1", "b/c#f", "..", "http://z.org/a", "b?u=http://x"])
def test_targets_resolve_as_in_browsers(spark, target):
    base = "http://a.org/d/e/f.html?q#r"
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(target, base)], "t string, u string").select(uf.resolved(F.col("t"), F.col("u"))).first()
    assert row[0].rstrip("/") == urljoin(base, target).rstrip("/")


def test_long_chain_and_large_class(spark):
    chain = [(k, f"http://s{k}.org/", f"<link rel=canonical href='http://s{k + 1}.org/'>") for k in range(60)]
    star = [(100 + k, f"http://alias{k}.org/", "<link rel=canonical href='http://hub.org/'>") for k in range(200)]
    pages = [*chain, (60, "http://s60.org/", "<link rel=canonical href='http://q.net/fr/'>"), *star]
    got = run(spark, pages)
    assert got == brute(pages, URL_RULES) and sum(r[4] == "block" for r in got) == 61


def test_ties_and_limits(spark):
    rules = [("a.b", "/cc/", "block"), ("x.a.b", "/c", "allow"), ("b", "/c/dd/", "block")]
    pages = [(1, "http://x.a.b/cc/", ""), (2, "http://x.a.b/c/dd/", "")]
    assert run(spark, pages, rules) == brute(pages, rules)
    assert {r[4] for r in run(spark, pages, [])} == {"allow"}
    with pytest.raises(ValueError):
        uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), [(str(k), "/", "allow") for k in range(uf.MAX_RULES + 1)])


def test_empty_table_clashing_columns_and_native_plan(spark, capsys):
    schema = "node string, page_id long, url string, html string, own int, verdict string"
    assert uf.judge(spark.createDataFrame([], schema), URL_RULES).count() == 0
    got = uf.judge(spark.createDataFrame([("n", 1, "http://a.net/es/", "", 1, "v")], schema), URL_RULES)
    assert [tuple(r) for r in got.collect()] == [(1, "a.net", "/es/", "net/es/", "block")]
    got.explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
