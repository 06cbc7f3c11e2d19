"""URL filters: rules on host and path, and trust propagated over links between hosts for the other URLs.

Hosts of allowed URLs are trusted seeds, hosts of blocked URLs are distrusted ones, each weighed by its number of URLs.
Trust follows links by personalised PageRank; distrust goes against them, from a blocked host to those that link to it.
A host is blocked if the distrust that reached it over links is more than its trust and more than ``share`` of an even
share. A host's own blocked pages don't count against its others: rules name paths, not hosts.

Only DataFrame functions are used. Edges are weighed by distinct host pairs, aggregated before the shuffle; rounds are
written to the shared folder. Null URLs, and those without ``://``, have an empty host and path, fit no rule and are
allowed. Null and empty html has no links, long html is searched whole. Repeated rows get equal verdicts, an empty table
gives no rows. Columns named host, path, rule and verdict are replaced; other columns are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded, materialise

#: A link to another host.
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


@dataclass(frozen=True)
class LinkTrust:
    damping: float = 0.85
    rounds: int = 10
    share: float = 0.5
    #: Rounds whose plan runs as one job.
    rounds_per_table: int = 5


def _folded(host: Column) -> Column:
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), _folded(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; of rules of one length, block before allow, then the first in order. Null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block", [-ord(c) for c in r[0]])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.select(host_of(F.col(url_column)).alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html_column, F.lit(LINK), F.lit(1)), _folded))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, how: LinkTrust) -> DataFrame:
    """(host, reached): mass that came over edges (src, dst, n) from seeds (host, weight), whose weights sum to 1."""
    out_weight = edges.groupBy("src").agg(F.sum("n").alias("all"))
    step = materialise(edges.join(out_weight, "src").select("src", "dst", (F.col("n") / F.col("all") * how.damping).alias("p")), "steps")
    start = seeds.select("host", (F.col("weight") * (1 - how.damping)).alias("mass"))
    rank = start
    reached = None
    for i in range(how.rounds):
        reached = step.join(rank, step["src"] == rank["host"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("mass")).alias("mass")).withColumnRenamed("dst", "host")
        if (i + 1) % how.rounds_per_table == 0 or i + 1 == how.rounds:
            reached = materialise(reached, "ranks")
        rank = reached.union(start).groupBy("host").agg(F.sum("mass").alias("mass"))
    return reached.withColumnRenamed("mass", "reached")


def _seeds(judged: DataFrame, verdict: str) -> DataFrame:
    own = judged.where((F.col("fit.verdict") == verdict) & (F.col("host") != "")).groupBy("host").agg(F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(own.agg(F.sum("n").alias("all")))).select("host", (F.col("n") / F.col("all")).alias("weight"))


def blocked_hosts(judged: DataFrame, edges: DataFrame, how: LinkTrust) -> DataFrame:
    """(host): hosts over the threshold. judged: host, fit of every URL."""
    trust = personalised_rank(edges, _seeds(judged, "allow"), how).withColumnRenamed("reached", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(back, _seeds(judged, "block"), how).withColumnRenamed("reached", "distrust")
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("host")).agg(F.count_distinct("host").alias("hosts"))
    both = distrust.join(trust, "host", "left").crossJoin(F.broadcast(hosts))
    return both.where((F.col("distrust") > F.coalesce("trust", F.lit(0.0))) & (F.col("distrust") * F.col("hosts") >= how.share)).select("host")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], how: LinkTrust | None = None, *, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (allow or block)."""
    how = how or LinkTrust()
    url = F.coalesce(F.col(url_column), F.lit(""))
    keys = pages.select(host_of(url).alias("host"), path_of(url).alias("path"))
    edges = materialise(host_edges(pages, url_column=url_column, html_column=html_column), "links")
    out = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    out = out.withColumn("_url_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    by_link = F.lit("allow")
    if not edges.isEmpty():
        judged = keys.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
        bad = materialise(blocked_hosts(judged, edges, how), "blocked").select(F.col("host").alias("_url_host"))
        out = out.join(bounded(bad), F.col("host") == F.col("_url_host"), "left")
        by_link = F.when(F.col("_url_host").isNotNull(), "block").otherwise("allow")
    out = out.withColumns({"rule": F.col("_url_fit.rule"), "verdict": F.coalesce("_url_fit.verdict", by_link)})
    return out.drop("_url_fit", "_url_host")
