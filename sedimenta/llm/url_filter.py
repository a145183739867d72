"""URL filters: host and path rules, and block decisions carried to aliases over redirects and canonical links.

1. Every distinct URL gets the longest rule that fits it: the suffixes of its host meet the rules in one join.
2. Redirects (a refresh in a page's head, or pairs that are given) and canonical links are edges between URLs; their
   connected components are found in rounds over tables, so a component of any size is spread over tasks.
3. A URL with a rule of its own keeps that rule's verdict, so an explicit allow stands inside a blocked component. A URL
   without one is blocked if any URL of its component is blocked by a rule, and allowed otherwise.
"""

from __future__ import annotations

import html
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.graph import components

from .common import materialize, release, table

RULES = "host string, path string, verdict string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags that may name another address of a page, and what can't hold any.
TAGS, HIDDEN = r"(?i)<(?:link|meta)\b[^>]*+>", r"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>"
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
REFRESH = re.compile(r"""\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["']?([^"']*)""", re.I)


def rest(url: Column) -> Column:
    """What follows the first ://; empty for null and for a URL without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """Up to /, ?, # or the end, A-Z in lower case; empty for null and for a URL without ://."""
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def node(url: Column) -> Column:
    """One key for spellings of an address that differ in scheme, host case or fragment; null where there is no host."""
    query = F.regexp_extract(rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host(url) != "", F.unhex(F.md5(F.concat(host(url), F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), query))))


def targets(tags: list[str], url: str | None) -> list[str]:
    """The addresses that a page's tags name: its first canonical link and its refreshes, made absolute."""
    out, canonical = [], False
    for tag in tags:
        given = {}
        for m in ATTRIBUTE.finditer(tag):  # of an attribute that repeats the first counts, as in browsers
            given.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").strip())
        if tag[1:5].lower() == "link" and "canonical" in given.get("rel", "").lower().split() and given.get("href") and not canonical:
            canonical = True
            out.append(given["href"])
        elif tag[1:5].lower() == "meta" and given.get("http-equiv", "").lower() == "refresh" and (m := REFRESH.match(given.get("content", ""))) and m[1].strip():
            out.append(m[1].strip())
    done = []
    for x in out:
        try:
            done.append(urljoin(url or "", x))
        except ValueError:  # no address
            continue
    return done


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, target: a row for each redirect and canonical link in the pages' html. Null urls and html give none.

    Comments and scripts hold none. html is read whole; only rows with such a tag leave the JVM.
    """
    named = lambda x: F.filter(F.regexp_extract_all(x, F.lit(TAGS), F.lit(0)), lambda t: F.rlike(t, F.lit(r"(?i)canonical|refresh")))
    some = pages.where(F.col(url_col).isNotNull() & F.rlike(html_col, F.lit(r"(?i)<(?:link|meta)\b[^>]*?(?:canonical|refresh)")))
    tags = some.select(F.col(url_col).alias("url"), named(F.regexp_replace(html_col, HIDDEN, "")).alias("tags")).where(F.size("tags") > 0)

    @F.pandas_udf("array<string>")
    def resolved(t: pd.Series, u: pd.Series) -> pd.Series:
        return pd.Series([targets(list(x), y) for x, y in zip(t, u, strict=True)], dtype=object)

    return tags.select("url", F.explode(resolved("tags", "url")).alias("target"))


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of urls that a rule fits, with the longest: host, path, rule, own (its verdict).

    A rule fits its host and all subdomains if the path starts with the rule's. Rules of one length: that with the
    longer host wins, then allow. Null hosts, paths and verdicts of rules fit nothing. Rows: the distinct pairs times the
    labels of the longest rule's host at most.
    """
    some = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
    some = some.groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.min("verdict").alias("own"))
    labels = some.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    pairs = urls.select("host", "path").where("host <> ''").distinct()
    if not labels:
        return pairs.where("false").select("host", "path", F.lit("").alias("rule"), F.lit("").alias("own"))
    part = F.split("host", r"\.")
    suffixes = F.array(*[F.when(F.size(part) >= k, F.concat_ws(".", F.slice(part, -k, k))) for k in range(1, labels + 1)])
    met = pairs.select("host", "path", F.explode(F.array_compact(suffixes)).alias("rule_host")).join(some, "rule_host").where(F.startswith("path", "rule_path"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("of_host"), F.concat("rule_host", "rule_path").alias("rule"), "own")
    return met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.own").alias("own"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page's id_col, host, path, rule (null without one) and verdict (allow or block).

    rules: host, path, verdict; redirects: url, target, beside those in the html. Null urls, and those without ://, have
    an empty host and path, no rule and no alias: they are allowed. Null html names no alias. Repeated rows and ids are
    judged each by its url; pages of one url share its aliases. Very long urls and html are read whole. Other columns have
    no influence. Without rules everything is allowed; an empty table gives an empty result.
    """
    urls = pages.select(F.col(url_col).alias("url")).where("url IS NOT NULL").distinct()
    parts = urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = materialize(parts.join(fitting_rules(parts, rules), ["host", "path"], "left"), "ruled_urls")

    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.union(redirects.select("url", "target"))
    edges = materialize(edges, "alias_edges")
    if edges.limit(1).count():
        # an address that only a link names has no row in pages, but a rule can block it
        named = edges.select(F.explode(F.array("url", "target")).alias("url")).where("url IS NOT NULL").distinct()
        linked = named.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
        blocked = linked.join(fitting_rules(linked, rules), ["host", "path"]).where("own = 'block'").select(node(F.col("url")).alias("node")).distinct()
        found = components(edges.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")))
        spread = materialize(found.join(found.join(blocked, "node").select("component").distinct(), "component").select("node"), "blocked_nodes")
        release(found)
        open_ = ruled.where("own IS NULL").select("url", node(F.col("url")).alias("node")).join(spread, "node").select("url", F.lit("block").alias("spread"))
        ruled = ruled.join(open_, "url", "left")
    else:
        ruled = ruled.withColumn("spread", F.lit(None).cast("string"))
    verdicts = ruled.select(F.col("url").alias(url_col), "rule", F.coalesce("own", "spread").alias("verdict"))
    url = F.col(url_col)
    rows = pages.select(F.col(id_col), url).join(verdicts, url_col, "left")
    return rows.select(id_col, host(url).alias("host"), path(url).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rule_list(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules like ("block", "example.com/de/") as rows of judge()."""
    return spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], verdict) for verdict, r in rules], RULES)


#: The rules that the query judges by.
JUDGED_BY = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rule_list(spark, JUDGED_BY))


SQL = r"""
WITH RECURSIVE rules(rule, rule_host, rule_path, own) AS (
  VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), cut AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT p.*, r.rule, r.own, row_number() OVER (PARTITION BY page_id, url ORDER BY length(r.rule) DESC NULLS LAST) AS k
  FROM p LEFT JOIN rules r ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)
), best AS (SELECT * FROM ruled WHERE k = 1
), links AS (
  SELECT url AS a, regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^"]*)"', 1) AS b FROM pages
), edges AS (SELECT a, b FROM links WHERE b <> '' UNION SELECT b, a FROM links WHERE b <> ''
), reach AS (
  SELECT url AS x, url AS y FROM best WHERE own = 'block' UNION SELECT r.x, e.b FROM reach r JOIN edges e ON r.y = e.a
)
SELECT page_id, host, path, rule, CASE WHEN own IS NOT NULL THEN own WHEN url IN (SELECT y FROM reach) THEN 'block' ELSE 'allow' END AS verdict FROM best
"""
