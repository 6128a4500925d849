"""URL filters: rules, and link-graph propagation where no rule fits.

Hosts of pages that a rule allows seed trust, those of blocked pages seed
distrust, each by its share of the host's pages.  Trust runs along host links as
personalised PageRank; distrust runs against them, from a blocked host to those
that link to it.  Both run until no score moves by ``tolerance``; as each round
moves at most ``damping`` times what the one before did, that comes.  Scores are not
normalised: a host without links keeps its seed, and what it would pass on is lost.

A host is blocked when the blocked share of its own pages reaches ``threshold``, or
when distrust that came over links reaches ``least`` and is such a share of it and
the host's trust together.  So a host that links to blocked ones beside many others
is blocked as well, whatever part of their distrust each of them gets.

Edges are summed by host pair before anything else; a round is one join and one
grouped sum, and a hub's edges are left to adaptive skew handling.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule and is allowed; null html has no links; texts of any length are read
whole; a repeated row counts and is judged each time; a null page_id is kept; of
rules of one length the later wins; an empty table gives none; extra columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shelf

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(c: str) -> str:
    return f"translate({c}, '{_UPPER}', '{_LOWER}')"


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and the rule's verdict."""
    rest = "CASE WHEN locate('://', url) > 0 THEN substring(url, locate('://', url) + 3) ELSE '' END"
    rows = pages.selectExpr("CAST(page_id AS LONG) AS page_id", f"{rest} AS rest")
    rows = rows.select("page_id", F.expr(_lower("regexp_extract(rest, '^([^/?#]*)', 1)")).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = "regexp_extract_all(html, '(?i)href\\\\s*=\\\\s*[\"\\']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"\\'\\\\s>]+)', 1)"
    src = _lower("regexp_extract(url, '://([^/?#]*)', 1)")
    rows = pages.where("html IS NOT NULL AND url IS NOT NULL").select(F.expr(src).alias("src"), F.expr(f"explode({links})").alias("dst"))
    return rows.select("src", F.expr(_lower("dst")).alias("dst")).where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, shelf: Shelf, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, score) of personalised PageRank: seeds are (host, seed), edges (src, dst, n); a lone seed keeps its weight."""
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    edges = shelf.put(edges.join(out, "src").selectExpr("src", "dst", "n / total AS w"))
    seeds = shelf.put(seeds.where("seed > 0"))
    rank = shelf.put(seeds.selectExpr("host", "seed AS score", "0D AS moved"))
    while True:
        came = edges.join(rank.selectExpr("host AS src", "score"), "src").groupBy(F.col("dst").alias("host")).agg((damping * F.sum(F.col("score") * F.col("w"))).alias("score"))
        new = seeds.selectExpr("host", "seed AS score").unionAll(came).groupBy("host").agg(F.sum("score").alias("score"))
        new = new.join(rank.selectExpr("host", "score AS was"), "host", "left").selectExpr("host", "score", "abs(score - coalesce(was, 0D)) AS moved")
        new = shelf.put(new)
        shelf.drop(rank)
        rank = new
        if (rank.agg(F.sum("moved")).first()[0] or 0.0) < tolerance:
            return rank.select("host", "score")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.6, least: float = 0.02, damping: float = 0.85) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of each of ``pages`` (page_id, url, html)."""
    shelf = Shelf(pages.sparkSession, "urls")
    rows = shelf.put(judged(pages, rules))
    edges = shelf.put(host_edges(pages))
    share = lambda v: F.avg(F.when(F.col("by_rule") == v, 1.0).otherwise(0.0))
    hosts = shelf.put(rows.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")))
    trust = propagate(edges, hosts.selectExpr("host", "good AS seed"), shelf, damping)
    distrust = propagate(edges.selectExpr("dst AS src", "src AS dst", "n"), hosts.selectExpr("host", "bad AS seed"), shelf, damping)
    scores = hosts.join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0)
    came = "greatest(distrust - bad, 0D)"
    blocked = f"bad >= {threshold} OR {came} >= {least} AND {came} >= {threshold} * ({came} + trust)"
    scores = shelf.put(scores.selectExpr("host", "trust", "distrust", f"{blocked} AS blocked"))
    shelf.keep(rows, scores)
    out = rows.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    return out.selectExpr("page_id", "host", "path", "rule", "coalesce(by_rule, IF(blocked, 'block', 'allow')) AS verdict", "trust", "distrust")
