"""URL filter: rules first, then link-graph propagation between hosts.

A host is a trusted seed by the share of its pages that the rules allow, and a blocked seed by the share that
they block; a host that is linked to but has no page counts as its root page. Personalised PageRank carries
trust along the links from the trusted seeds, and distrust against them from the blocked ones. Beside both runs
a PageRank that starts from every host alike. A host's trust is the share of what flows to it in that which
comes from trusted seeds, and its distrust likewise; so neither depends on how many links a seed has, nor on how
many seeds there are. (Rank that hosts without links would return to the seeds scales all scores alike and
leaves the shares as they are.) A page without a rule is blocked if its host's distrust passes a threshold and
the host's trust.

Edges are counted for each pair of hosts before any exchange, so a very common host costs one row for each
of its neighbours, and scores are summed partially before they are exchanged. All steps are DataFrame
operations; scores are written to the shared folder every few rounds.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule, and is allowed; a null
html has no links; repeated pages give repeated rows; an empty table gives none; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``text``: host and path, like ``net/``."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 12
    rounds_in_a_plan: int = 4
    #: Distrust, from 0 to 1, at which a host is blocked.
    threshold: float = 0.5


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    links = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s>]+)"), 1)
    pairs = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return pairs.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, how: Propagation) -> DataFrame:
    """(host, trust, distrust), each from 0 to 1, from seeds (host, trust, distrust); every host of the edges must be among the seeds.

    Kinds of score: ``trust`` and ``ahead`` follow the links, ``distrust`` and ``back`` go against them.
    """
    kinds = {"trust": ("src", "dst"), "ahead": ("src", "dst"), "distrust": ("dst", "src"), "back": ("dst", "src")}
    ways = edges.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(a).alias("from"), F.col(b).alias("to"), "n") for k, (a, b) in kinds.items()])).alias("w")).select("w.*")
    out = ways.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    ways = written(ways.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("w")), "ways")
    starts = [F.struct(F.lit(k).alias("kind"), x.alias("score")) for k, x in (("trust", F.col("trust")), ("distrust", F.col("distrust")), ("ahead", F.lit(1.0)), ("back", F.lit(1.0)))]
    start = written(seeds.select("host", F.explode(F.array(*starts)).alias("s")).select("s.kind", "host", "s.score").where("score > 0"), "seeds")
    # what has reached a host so far, its own start left out
    score, flow = start.withColumn("score", F.col("score") * (1 - how.damping)), None
    for k in range(how.rounds):
        moved = ways.join(score.withColumnRenamed("host", "from"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("score") * F.col("w") * how.damping).alias("score"))
        flow = moved
        if (k + 1) % how.rounds_in_a_plan == 0:
            flow = written(flow, "score")
        score = flow.unionByName(start.withColumn("score", F.col("score") * (1 - how.damping))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
    side = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("score")).otherwise(0.0))
    share = lambda a, b: F.when(side(b) > 0, F.least(side(a) / side(b), F.lit(1.0))).otherwise(0.0).alias(a)
    return flow.groupBy("host").agg(share("trust", "ahead"), share("distrust", "back"))


def judge(pages: DataFrame, rules: list[Rule], how: Propagation = Propagation()) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.text)).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules, lambda r: r.verdict))
    edges = written(host_edges(ruled), "edges")
    crawled = ruled.where("host != ''").groupBy("host").agg(*[F.avg((F.coalesce("by_rule", F.lit("")) == v).cast("double")).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))])
    linked = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct().join(crawled.select("host"), "host", "left_anti")
    at_root = rule_of(F.col("host"), F.lit("/"), rules, lambda r: r.verdict)
    linked = linked.select("host", *[F.coalesce((at_root == v).cast("double"), F.lit(0.0)).alias(k) for k, v in (("trust", "allow"), ("distrust", "block"))])
    scores = written(propagate(edges, crawled.unionByName(linked), how), "hosts")
    bad = (F.col("distrust") >= how.threshold) & (F.col("distrust") > F.col("trust"))
    return ruled.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
