"""URL filter: rules on host suffix and path prefix, and trust over the link graph.

Urls that no rule decides are judged by their host. Trust starts at hosts with
allowed pages and follows links (personalised PageRank); distrust starts at hosts
with blocked pages and runs against the links, so that a host is charged for what
it links to. All of it is joins and sums over host edges.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabdrift.llm.common import lower_ascii, small_side, written

#: Most blocked hosts that are broadcast to the pages; with more, the pages are joined by shuffle.
BROADCAST_HOSTS = 200_000
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct name, verdict of the longest rule that fits; null if none does.

    A rule fits its host and all subdomains of it, if the path starts with the
    rule's. Of equally long rules the first in text order is taken, and block before allow.
    """
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name, r.verdict != "block"), reverse=True):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(judged: DataFrame, site_links: bool = True) -> DataFrame:
    """Links between different hosts as (src, dst, n).

    They come from anchors with a host of their own, wherever that leads: a linked host
    needs no page. A relative link stays on its page's host and so says nothing about
    another. With ``site_links`` hosts of a site are joined as well: each host with the one a
    label above it, both ways, up to two labels, whether or not that one has pages, so that
    ``blog.x.com`` and ``m.x.com`` meet in ``x.com``. Hosts that end in a number (addresses)
    have none above.
    """
    anchors = judged.filter("uf_host != ''").select(
        F.col("uf_host").alias("src"), F.explode(F.regexp_extract_all(F.col("uf_html"), F.lit(LINK), F.lit(1))).alias("dst")
    )
    edges = anchors.select("src", lower_ascii(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n")).filter("src != dst")
    if not site_links:
        return edges
    edges = written(edges, "anchors")
    hosts = judged.filter("uf_host != ''").select(F.col("uf_host").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    labels = hosts.filter(~F.col("host").rlike(r"\.[0-9]+(:|$)")).select(F.split("host", r"\.").alias("l"))
    site = lambda i: F.array_join(F.slice("l", i + 1, F.size("l")), ".")
    steps = F.transform(F.sequence(F.lit(0), F.size("l") - 3), lambda i: F.struct(site(i).alias("src"), site(i + 1).alias("dst")))
    up = labels.filter(F.size("l") > 2).select(F.explode(steps).alias("s")).select("s.src", "s.dst").distinct().withColumn("n", F.lit(1).cast("long"))
    both = edges.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    return both.groupBy("src", "dst").agg(F.sum("n").alias("n"))


def rounds_for(residual: float, damping: float) -> int:
    """After so many rounds at most ``residual`` of the seed mass is not where it ends up."""
    return max(1, math.ceil(math.log(residual) / math.log(damping)))


def propagate(hosts: DataFrame, edges: DataFrame, damping: float = 0.85, residual: float = 1e-3, every: int = 8) -> DataFrame:
    """Trust along and distrust against ``edges``, by power iteration.

    ``hosts`` has host, trusted and blocked, the seed weights; each seed vector is
    scaled to sum 1. In a round a host keeps (1 - damping) of its seed and receives
    damping times what its neighbours pass on in proportion to link counts. Hosts
    without links pass nothing on. A round shrinks what is missing by ``damping`` at
    least, so the number of rounds follows from ``residual``, the sum of differences from
    the final ranks that may be left, and not from the graph. A round is one join of the
    links with the ranks and one sum per host. Ranks are written out every few rounds,
    which bounds the plan. Returns host, trust, distrust.
    """
    total = hosts.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    share = lambda c, s: (F.col(c) / F.lit(float(s)) * (1.0 - damping)) if s else F.lit(0.0)
    seeds = written(hosts.select("host", share("trusted", total["t"]).alias("trust"), share("blocked", total["b"]).alias("distrust")), "hosts")
    if edges.isEmpty():
        return seeds
    out = edges.groupBy("src").agg(F.sum("n").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("into"))
    shares = edges.join(out, "src").join(into, "dst")
    down, up, none = F.col("n") / F.col("out") * damping, F.col("n") / F.col("into") * damping, F.lit(0.0)
    flows = shares.select(F.col("src").alias("giver"), F.col("dst").alias("taker"), down.alias("t"), none.alias("d")).unionByName(
        shares.select(F.col("dst").alias("giver"), F.col("src").alias("taker"), none.alias("t"), up.alias("d"))
    )
    flows = written(flows.groupBy("giver", "taker").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "flows")
    ranks, rounds = seeds, rounds_for(residual, damping)
    for i in range(1, rounds + 1):
        passed = flows.join(ranks, flows["giver"] == ranks["host"]).select(
            F.col("taker").alias("host"), (F.col("trust") * F.col("t")).alias("trust"), (F.col("distrust") * F.col("d")).alias("distrust")
        )
        ranks = passed.unionByName(seeds).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        if i % every == 0 and i < rounds:
            ranks = written(ranks, "ranks")
    return ranks


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], margin: float = 0.5, site_links: bool = True, url: str = "url", html: str = "html", **how
) -> DataFrame:
    """Add uf_host, uf_path, uf_rule and uf_verdict to every page.

    A host's seed weights are the shares of its pages that rules allow and block; a
    host that is linked, or above another, but has no page counts as a page at its root
    path. All these hosts carry trust and distrust. Ranks are scaled so that a host holds 1 on
    average; a host is blocked when its distrust exceeds its trust by more than ``margin``.

    Null urls and urls without ``://`` have empty host and path, match only by that and are
    allowed; null html has no links. Repeated pages count as often as they occur. Of
    rules of equal length the first in text order holds. Urls and pages of any length are
    read whole. Columns uf_* of the input are replaced or dropped; other names may clash
    with nothing. An empty table gives an empty result.
    """
    judged = pages.withColumn("uf_host", host_of(F.col(url))).withColumn("uf_path", path_of(F.col(url)))
    judged = judged.withColumn("uf_found", rule_for(F.col("uf_host"), F.col("uf_path"), rules)).withColumn("uf_html", F.col(html))
    verdict = F.col("uf_found.verdict")
    hosts = written(
        judged.filter("uf_host != ''").groupBy(F.col("uf_host").alias("host")).agg(
            F.avg(F.when(verdict == "allow", 1.0).otherwise(0.0)).alias("trusted"),
            F.avg(F.when(verdict == "block", 1.0).otherwise(0.0)).alias("blocked"),
        ),
        "host-seeds",
    )
    edges = written(host_edges(judged, site_links), "edges")
    linked = edges.select(F.col("src").alias("host")).unionByName(edges.select(F.col("dst").alias("host"))).distinct()
    linked = linked.join(hosts, "host", "left_anti").withColumn("root", rule_for(F.col("host"), F.lit("/"), rules)["verdict"])
    hosts = hosts.unionByName(linked.select(
        "host",
        F.when(F.col("root") == "allow", 1.0).otherwise(0.0).alias("trusted"),
        F.when(F.col("root") == "block", 1.0).otherwise(0.0).alias("blocked"),
    ))
    hosts = written(hosts, "vertices")
    ranks = propagate(hosts, edges, **how)
    n = hosts.count()
    bad = ranks.filter((F.col("distrust") - F.col("trust")) * F.lit(float(n)) > margin).select(F.col("host").alias("uf_host"), F.lit("block").alias("uf_bad"))
    bad = small_side(written(bad, "bad-hosts"), BROADCAST_HOSTS)  # a broadcast leaves the pages of a large host where they are
    return (
        judged.join(bad, "uf_host", "left")
        .withColumn("uf_rule", F.col("uf_found.name"))
        .withColumn("uf_verdict", F.coalesce(verdict, "uf_bad", F.lit("allow")))
        .drop("uf_found", "uf_html", "uf_bad")
    )
