"""URL verdicts: prefix rules, and trust and distrust spread over the link graph of hosts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DAMPING = 0.85
#: Iteration ends when the hosts' changes add up to no more than this share of all seeds.
TOLERANCE = 1e-4
#: A host is blocked if its distrust is above the first times what a host of blocked pages alone gets as a seed, and above the second times its trust.
LEAST_DISTRUST, MARGIN = 0.05, 2.0
#: Less than this above the margin is a tie, which doesn't block.
TIE = 1e-9
#: Host and path of a url, and hosts of absolute links.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end. Empty if there is no ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = lambda group: F.regexp_extract(url, URL, group)
    return F.translate(parts(1), UPPER, LOWER), parts(2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    return reduce(lambda rest, r: F.when(fits(r[0], r[1]), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))).otherwise(rest), reversed(longest), F.lit(None))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst, w``: links between different hosts in absolute hrefs, counted."""
    host, _ = host_and_path(F.col(url_col))
    hrefs = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), 1)
    to = pages.select(host.alias("src"), F.explode(hrefs).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return to.where("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("w"))


def spread(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``host, trust, distrust``: both personalised PageRanks, iterated until the sum of all changes is within the tolerance.

    nodes: ``host, good, bad`` (seed weights); edges: ``src, dst, w``. Trust flows along links and distrust
    against them, each from seeds that are divided by their sum; what reaches a host without links ends there. Each
    round is two equi-joins on hosts with partial sums, written to the shared folder. A round leaves ``damping`` of a
    change at most, so the number of rounds is bounded by the tolerance; more would be an error, and are raised as one.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("into"))
    share = materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("p"), (F.col("w") / F.col("into")).alias("q")), "host_links")
    ends = share.select(F.col("src").alias("host")).union(share.select("dst")).distinct()
    total = nodes.agg(*(F.greatest(F.coalesce(F.sum(c), F.lit(0.0)), F.lit(1e-300)).alias(c) for c in ("good", "bad"))).first()  # two numbers
    part = lambda c: (F.coalesce(c, F.lit(0.0)) / total[c]).alias(c)
    now = materialize(nodes.join(ends, "host", "full").select("host", part("good"), part("bad")).withColumns({"trust": F.col("good") * (1 - damping), "distrust": F.col("bad") * (1 - damping)}), "ranks")
    if share.isEmpty():
        return now.select("host", "trust", "distrust")
    for _ in range(int(math.log(tolerance) / math.log(damping)) + 3):
        ahead = share.join(now.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("p")).alias("t"), F.lit(0.0).alias("d"))
        back = share.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("q")).alias("d"))
        sums = ahead.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        new = now.join(sums, "host", "left").select(
            "host", "good", "bad", ((1 - damping) * F.col("good") + damping * F.coalesce("t", F.lit(0.0))).alias("trust"), ((1 - damping) * F.col("bad") + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
            F.col("trust").alias("old_t"), F.col("distrust").alias("old_d"),
        )
        new = materialize(new, "ranks")
        change = new.agg(F.sum(F.abs(F.col("trust") - F.col("old_t"))).alias("t"), F.sum(F.abs(F.col("distrust") - F.col("old_d"))).alias("d")).first()
        now = new.drop("old_t", "old_d")
        if max(change) <= tolerance:
            return now.select("host", "trust", "distrust")
    raise RuntimeError("ranks didn't converge")


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, trust, distrust``.

    A page that a rule fits gets the rule's verdict. Any other gets its host's: block where distrust, spread
    against links from hosts with blocked pages (weighted by their share of pages), is above LEAST_DISTRUST and
    MARGIN times the trust spread along links from hosts with allowed pages; else allow. Null urls and those
    without a host are allowed, with null trust; null html has no links; repeated rows are repeated. An empty table
    gives an empty one.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host.alias("host"), path.alias("path"))
    ruled = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("host != ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"))
    seeds = materialize(seeds, "seeds")
    total = seeds.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("good", "bad"))).first()
    ranks = spread(seeds, host_links(pages, url_col, html_col))
    seed = lambda c, t: F.col(c) * t / (1 - DAMPING)  # noqa: E731  in units of what a whole seed gets
    blocked = (seed("distrust", total["bad"]) > LEAST_DISTRUST) & (seed("distrust", total["bad"]) > MARGIN * seed("trust", total["good"]) + TIE)
    verdict = F.coalesce("ruled", F.when(blocked, "block"), F.lit("allow"))
    return ruled.join(ranks, "host", "left").select("id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op5_query(pages: DataFrame) -> DataFrame:
    """The contract's columns, one row per page; edge cases as in ``judge_urls``."""
    return judge_urls(pages).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")
