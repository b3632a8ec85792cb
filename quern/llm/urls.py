"""URL rules, carried over redirects and canonical links.

A rule names a host and the start of a path; it fits the host and all its subdomains, and the longest rule that fits
decides.  Pages that no rule fits take the decision of their aliases: pages and the targets of their redirects
(``<meta http-equiv=refresh>``) and canonical links (``<link rel=canonical>``) are joined, connected components are
computed by distributed star steps, and a component with any explicitly allowed page is allowed, else one with a
blocked page is blocked.  Everything else is allowed.

An address is compared without scheme, fragment and a trailing slash, with the host in lower case; a rule is tried on
the url or target as it is written, so ``/en/`` names itself.  Targets are resolved against the page's url after their
HTML entities are read.  Rules are a fixed list, applied as expressions.  A null url, or one without
``://``, has an empty host and path and no aliases; null markup has no links, and markup of any length is searched by
expressions.  Of rules of equal length the later one in the list decides.  Rows are judged one by one; repeated rows
alike; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import graph, store
from quern.llm.arrow import column

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What two spellings of one address have in common; null for none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?", 1)
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.coalesce(rest, F.lit(""))))


def targets(html: Column) -> Column:
    """The addresses that a page names as itself: canonical links and refresh targets."""
    href = r"""\bhref\s*=\s*["']?([^"'\s>]+)"""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*>)"), 1), lambda t: t.rlike(r"(?is)\brel\s*=\s*[\"']?canonical\b"))
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*>)"), 1), lambda t: t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"))
    urls = F.concat(F.transform(links, lambda t: F.regexp_extract(t, "(?is)" + href, 1)), F.transform(metas, lambda t: F.regexp_extract(t, r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)))
    return F.filter(urls, lambda u: u != "")


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(u, t): urls of pages and their redirect and canonical targets as full urls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = column(batch, "u")
            t = [_full(a, b) for a, b in zip(u.to_pylist(), column(batch, "t").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([u, pa.array(t, pa.string())], ["u", "t"])

    named = pages.select(F.col(url).alias("u"), F.explode(targets(F.coalesce(F.col(html), F.lit("")))).alias("t"))
    return named.filter("u is not null").mapInArrow(run, "u string, t string").filter(F.col("t").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"))


def _full(page: str, target: str) -> str | None:
    try:
        return urljoin(page, unescape(target))
    except ValueError:  # no address, such as an unclosed bracket in the host
        return None


def edges(named: DataFrame) -> DataFrame:
    """(a, b): addresses of pages and of their targets, from :func:`links`."""
    return named.select(address(F.col("u")).alias("a"), address(F.col("t")).alias("b")).filter("a is not null and b is not null")


def judge(pages: DataFrame, ident: str = "page_id", url: str = "url", html: str = "html", rules=RULES, owner: str = "") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    u = F.col(url)
    rows = pages.select(F.col(ident).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), address(u).alias("address")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    named = store.table(links(pages, url, html), "links", owner)
    roots = graph.components(edges(named), owner)
    # explicit decisions of the addresses themselves, whether they are pages here or only targets
    seen = pages.select(u.alias("u")).union(named.select("t"))
    told = seen.select(address(F.col("u")).alias("named"), rule_of(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v")).filter("named is not null and v is not null").distinct()
    votes = roots.join(told, roots["node"] == told["named"]).groupBy("root").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"))
    alias = store.table(roots.join(votes, "root").select("node", F.when(F.col("allowed") == 1, "allow").otherwise("block").alias("inherited")), "aliases", owner)
    # pages without an address meet no alias, and don't meet one another under a null key
    spread = F.when(F.col("address").isNull(), F.xxhash64("page_id", "host", "path")).otherwise(F.lit(0).cast("long"))
    alias = alias.withColumn("__spread", F.lit(0).cast("long"))
    rows = rows.withColumn("__spread", spread)
    done = rows.join(alias, (rows["address"] == alias["node"]) & (rows["__spread"] == alias["__spread"]), "left")
    return done.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.col("inherited"), F.lit("allow")).alias("verdict"))
