"""URL filters: rules first, then link-graph propagation, in DataFrame functions only.

Host edges come from the links of a and area elements outside of comments, scripts and styles: absolute ones, those that begin with //, and relative ones where a
base element names another host. Trust is a personalised PageRank from hosts that the rules mostly
allow; distrust is the same over reversed edges from hosts that they mostly block: who links to bad hosts is suspect.
Both are sums of joins on the host table, which holds one row a host and never reaches the driver; as scores only grow, the
growth of their total tells when they have settled.

Defined results: a null url or one without :// has empty host and path and no rule; hosts that no link reaches and no
rule seeds are allowed; null html has no links; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import ascii_lower, cut, cut_and_sum

#: The value of an element's href, after white space and past attributes and their quoted values; the element's name goes in front.
HREF = r"""(?:\s+[^\s>"'=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]*))?)*?\s+href\s*=\s*["']?\s*([^"'\s>]+)"""
LINK, BASE = rf"(?i)<a(?:rea)?{HREF}", rf"(?i)<base{HREF}"
#: What holds no links: comments, scripts and styles, also those that never end.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
ABSOLUTE, SCHEME = "(?i)^[a-z][a-z0-9+.-]*://", "(?i)^[a-z][a-z0-9+.-]*:"
#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. rules is a parameter, so one CASE holds it."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    empty = F.lit(None).cast("struct<rule:string,verdict:string>")
    return empty if out is None else out.otherwise(empty)


def link_host(link: Column, relative: Column) -> Column:
    """The host that a link leads to: its own, none for another scheme (mailto:), or that of relative links."""
    return F.when(link.rlike(ABSOLUTE), url_host(link)).when(link.startswith("//"), url_host(F.concat(F.lit("x:"), link))).when(link.rlike(SCHEME), "").otherwise(relative)


def host_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts. A page's repeats combine before the shuffle."""
    html = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), UNREAD, " ")
    base = F.regexp_extract("html", BASE, 1)
    rows = pages.select(url_host(F.col(url_col)).alias("src"), html.alias("html")).select("src", base.alias("base"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link"))
    links = rows.select("src", link_host(F.col("link"), link_host(F.col("base"), F.col("src"))).alias("dst"))
    return links.filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(host, score): scores = (1 - damping) * seed + damping * incoming, from edges (src, dst, share), seeds (host, seed).

    Ends when three rounds add no more than tolerance of all scores. What a round adds is at most damping times what the one before
    has added, so that comes after log(tolerance) / log(damping) rounds or so at the latest.
    """
    base = seeds.filter("seed > 0").withColumn("score", (1 - damping) * F.col("seed")).select("host", "score")
    score, before = cut_and_sum(base, total=F.sum("score"))
    while before["total"]:
        for _ in range(3):
            moved = edges.join(score, edges["src"] == score["host"]).select(F.col("dst").alias("host"), (damping * F.col("share") * F.col("score")).alias("score"))
            score = base.unionByName(moved).groupBy("host").agg(F.sum("score").alias("score"))
        score, after = cut_and_sum(score, total=F.sum("score"))
        if after["total"] - before["total"] <= tolerance * after["total"]:
            break
        before = after
    return score


def filter_urls(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = 0.85,
    tolerance: float = 1e-6,
    distrust_ratio: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): rules first, else block where distrust > ratio * trust."""
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = judged.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    hosts = cut(
        judged.filter(F.col("host") != "")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("found.verdict") == "allow").alias("good"), F.count_if(F.col("found.verdict") == "block").alias("bad"))
    )
    edges = cut(host_edges(pages, url_col, html_col))
    outgoing = edges.groupBy("src").agg(F.sum("n").alias("total")).withColumnRenamed("src", "o")
    incoming = edges.groupBy("dst").agg(F.sum("n").alias("total")).withColumnRenamed("dst", "o")
    forward = cut(edges.join(outgoing, edges["src"] == outgoing["o"]).select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    backward = cut(edges.join(incoming, edges["dst"] == incoming["o"]).select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("total")).alias("share")))

    def seeds(kind: str) -> DataFrame:
        return hosts.filter(2 * F.col(kind) > F.col("n")).select("host", F.lit(1.0).alias("seed"))

    trust = propagate(forward, seeds("good"), damping, tolerance).withColumnRenamed("score", "trust")
    distrust = propagate(backward, seeds("bad"), damping, tolerance).withColumnRenamed("score", "distrust")
    scores = cut(hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"]))
    verdict = F.when(F.col("distrust") > distrust_ratio * F.col("trust"), "block").otherwise("allow")
    return (
        judged.join(scores, "host", "left")
        .withColumn("verdict", F.coalesce(F.col("found.verdict"), F.when(F.col("distrust").isNull(), "allow").otherwise(verdict)))
        .select("page_id", "host", "path", F.col("found.rule").alias("rule"), "verdict", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    )
