"""URL filters with redirect equivalence (operator 12).

A url's own rule decides first: a rule (action, host, path) fits its host and
all subdomains where the url's path starts with the rule's, and the longest
``host + path`` wins. Urls without a rule take part in the decisions of their
aliases: pages, the targets of their canonical links and meta refreshes, and
any redirects the caller knows are nodes of one graph, whose connected
components are found by distributed star rounds. Within a component an
explicit allow of any alias takes precedence, else an explicit block of any
alias blocks; a component without either is allowed.

A node is a url without scheme and fragment (host lower-cased), so http and
https, and places on a page, are one node.

Rules meet urls by equality, not pair by pair: a url asks with each suffix of
its host for the lengths of the paths that rules on it have, and then with its
path cut to each such length. All work is on distinct (host, path); html is
only scanned for links, never moved.

Defined cases: a null url, or one without ``://``, has empty host and path
and no node of its own (no rule, allow); a null html has no links; repeated
rows get equal results; of equal rules block and allow the allow wins; without
rules or edges every verdict is allow; an empty table gives no rows; only the
named columns are used, extra ones are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

# <link rel=canonical href=...> and <meta http-equiv=refresh content="0; url=...">
LINK_TAG = r"(?is)<link\b[^>]*>"
META_TAG = r"(?is)<meta\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"
HREF = r"(?is)\bhref\s*=\s*(?:\"\s*([^\">]*?)\s*\"|'\s*([^'>]*?)\s*'|([^\s\"'>]+))"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?\s*([^\"'>\s]+)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), rest))


def absolute(target: Column, base: Column) -> Column:
    """A link's target as a url: with scheme, ``//host...``, ``/path`` or
    ``?query`` or a path beside the base's."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.regexp_extract(base, r"(?s)^([^?#]*)", 1)
    folder = F.concat(site, F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(/[^?#]*/|/)?", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (F.when(target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(target.startswith("?"), F.concat(whole, target))
            .when(~target.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, target)))


def html_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target) of canonical links and meta refreshes."""
    url, html = F.col(url_col), F.col(html_col)
    links = F.filter(F.regexp_extract_all(html, F.lit(LINK_TAG), 0), lambda t: t.rlike(CANONICAL))
    metas = F.filter(F.regexp_extract_all(html, F.lit(META_TAG), 0), lambda t: t.rlike(REFRESH))
    href = lambda t: F.concat(*[F.regexp_extract(t, HREF, k) for k in (1, 2, 3)])
    found = F.concat(F.transform(links, href), F.transform(metas, lambda t: F.regexp_extract(t, REFRESH_URL, 1)))
    return (pages.filter(url.contains("://") & html.rlike("(?i)canonical|refresh")).select(url.alias("url"), F.explode(found).alias("to"))
            .filter("to <> ''").select("url", absolute(F.col("to"), F.col("url")).alias("target"))
            .filter("target IS NOT NULL"))


def longest_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites (host, path), rules (action, host, path) -> the longest fitting
    rule of each distinct site that has one: (host, path, rule, action)."""
    rules = rules.select("action", F.col("host").alias("rule_host"), F.col("path").alias("rule_path"),
                         F.concat("host", "path").alias("rule"))
    lengths = rules.select("rule_host", F.length("rule_path").alias("n")).distinct()
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    asked = (sites.filter("host <> ''").select("host", "path").distinct()
             .select("host", "path", F.explode(suffix).alias("rule_host")).join(lengths, "rule_host")
             .filter(F.col("n") <= F.length("path"))
             .select("host", "path", "rule_host", F.expr("substring(path, 1, n)").alias("rule_path")))
    met = asked.join(rules, ["rule_host", "rule_path"])
    best = F.max_by(F.struct("rule", "action"),
                    F.struct(F.length("rule"), F.length("rule_host"), (F.col("action") == "allow").cast("int")))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.action")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's host, path, own rule (null if none fits) and verdict.

    ``rules``: (action 'allow' or 'block', host, path). ``redirects``: more
    edges (url, target), beside those found in the html."""
    urls = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))
    urls = urls.select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       node_of(F.col("url")).alias("node"))
    edges = html_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = saved(edges.distinct(), "aliases")
    linked = components(edges.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
                        .filter("a IS NOT NULL AND b IS NOT NULL"))
    # rules of pages and of targets that are no pages
    ends = edges.select(F.explode(F.array("url", "target")).alias("url"))
    ends = ends.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       node_of(F.col("url")).alias("node")).distinct()
    found = saved(longest_rules(urls.select("host", "path").unionByName(ends.select("host", "path")), rules), "rules")
    told = (ends.join(found, ["host", "path"]).join(linked, "node").groupBy("component")
            .agg(F.min("action").alias("decided")))          # 'allow' before 'block'
    aliases = linked.join(told, "component").select("node", "decided")
    return (urls.join(found, ["host", "path"], "left").join(aliases, "node", "left")
            .select(F.col("page").alias(id_col), "host", "path", "rule",
                    F.coalesce("action", "decided", F.lit("allow")).alias("verdict")))
