"""URL rules, carried over to aliases by redirects and canonical links.

DataFrame functions only. A rule is a host (with all its subdomains) and a beginning
of the path; the longest rule decides a url. Urls without a rule of their own take
the decision of their redirect class: urls are nodes, redirects and canonical links
(``<link rel=canonical>``, ``<meta http-equiv=refresh>``, ``og:url``; all of a page's
tags, whatever else their lists of relations name) are links, and the classes are the
connected components. A class in which any url is blocked by a
rule is blocked, except for the urls that a rule allows: an explicit allow always
wins. Everything else is allowed.

Urls that differ only in the scheme, the fragment, ``utm_`` parameters, a slash at
the end of the path or the case of the host are one node. Targets are resolved against
their page: absolute ones, ``//host/``, ``/path``, ``?query``, and relative paths with
``.`` and ``..``. Empty ones, fragments of the page itself and schemes without ``://``
(``mailto:``) are no targets; entities in attributes are not decoded.

A null url, or one without ``://``, has an empty host and path, no rule and no node,
and is allowed. Of rules of equal length an allowing one wins, then the longer host.
The rules are a list of ``MAX_RULES`` at most, sent with the plan. Repeated rows are
judged each; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import cut_lineage
from netlens.llm.components import components

MAX_RULES = 1000
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url's node; null without one."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.lower(x).startswith("utm_")), "&")
    path = F.regexp_replace(path_of(url), "/$", "")
    node = F.concat(host_of(url), path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(F.contains(url, F.lit("://")) & (host_of(url) != ""), node)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of the (host, path, verdict) rules that fits, or null."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    first = lambda r: (len(r[0]) + len(r[1]), r[2] == "allow", len(r[0]), r)
    chosen = F.when(F.lit(False), F.lit(None).cast("struct<rule: string, verdict: string>"))
    for h, p, verdict in sorted(set(rules), key=first, reverse=True):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        chosen = chosen.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return chosen


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3))))


def resolved(target: Column, url: Column) -> Column:
    """The target of a link on the page ``url``, as a whole url; null if it has none."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.substr(target, F.length(path) + 1)
    folder = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path_of(url), "^/", "")), r"[^/]*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    step = lambda done, part: (
        F.when(part == "..", F.regexp_replace(done, r"/[^/]*$", "")).when(part == ".", done).otherwise(F.concat(done, F.lit("/"), part))
    )
    parts = F.split(whole, "/")
    clean = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), step)
    clean = F.concat(clean, F.when(whole.rlike(r"(?s)/\.\.?$"), "/").otherwise(""))
    return (
        F.when((target == "") | target.startswith("#"), None)
        .when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .otherwise(F.concat(site, clean, rest))
    )


def targets_of(html: Column, url: Column) -> Column:
    """Whole urls that a page redirects to or names as its canonical one."""
    tags = lambda name: F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    canonical = F.filter(tags("link"), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    og = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "property")) == "og:url")
    refresh = F.filter(tags("meta"), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    found = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(og, lambda t: _attribute(t, "content")),
        F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)""", 1)),
    )
    return F.filter(F.transform(found, lambda x: resolved(x, url)), lambda x: x.isNotNull())


def judge(
    pages: DataFrame, rules: list[tuple[str, str, str]], *, key: str = "page_id", url: str = "url", html: str | None = "html"
) -> DataFrame:
    """(key, host, path, rule, verdict) of every page."""
    u, none = F.col(url), F.array().cast("array<string>")
    rows = pages.select(
        F.col(key).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"), node_of(u).alias("node"),
        (F.coalesce(targets_of(F.col(html), u), none) if html else none).alias("targets"),
    )
    rows = cut_lineage(rows.withColumn("own", rule_for(F.col("host"), F.col("path"), rules)))
    goals = rows.where("node is not null").select("node", F.explode("targets").alias("target"))
    goals = goals.select(
        "node", node_of(F.col("target")).alias("goal"), rule_for(host_of(F.col("target")), path_of(F.col("target")), rules).alias("own")
    ).where("goal is not null")
    classes = components(goals.select(F.col("node").alias("a"), F.col("goal").alias("b")))
    blocked = rows.where("own.verdict = 'block'").select("node").union(goals.where("own.verdict = 'block'").select("goal"))
    blocked = blocked.where("node is not null").distinct()
    class_of = F.coalesce("component", "node").alias("class")
    # written, so that a url or class of very many rows is a plain join key on both sides
    bad = cut_lineage(blocked.join(classes, "node", "left").select(class_of).distinct())
    judged = rows.join(cut_lineage(classes), "node", "left").withColumn("class", F.coalesce("component", "node"))
    judged = judged.join(bad.withColumn("bad", F.lit(True)), "class", "left")
    verdict = F.coalesce("own.verdict", F.when(F.col("bad"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(key), "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"))
