"""URL filters: rules, and trust and distrust propagated over host edges.

Hosts whose pages an ``allow`` rule passes are the trusted seeds of a
personalised PageRank along the edges; hosts whose pages a ``block`` rule
stops are the seeds of a second one along the reversed edges, so that what
links to blocked hosts is distrusted.  A seed starts with its pages over the
mean of all seeds of its kind, so a host's scores depend on its neighbourhood
and not on how many seeds there are elsewhere.  A host without a rule is
blocked where its distrust exceeds its trust by more than a threshold.  Edges
are the absolute links in the pages and the step from a host to its parent
domain.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, hot_keys, materialize, salted, spread

LINK = r"""(?i)href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed values.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def split_url(url: Column) -> tuple[Column, Column]:
    """``(host, path)``; both empty for null and for urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.name) if name is None else name.when(fits, r.name)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if name is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: distinct pairs of different hosts with their counts."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\.[^.]+\..*|[^.]+\.[^.]+)$", 1)
    steps = pages.groupBy("host").agg(F.lit(1).cast("long").alias("n")).select(F.col("host").alias("src"), parent.alias("dst"), "n").where("dst <> ''")
    return links.unionByName(steps).where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


#: Hosts with more neighbours are dealt over tasks by salts.
HUB_LINKS = 4096
#: The walks end when at most this share of the seeds' mass is still on its way.
RESIDUAL = 1e-3
DAMPING = 0.85


def rounds_for(residual: float = RESIDUAL, damping: float = DAMPING) -> int:
    """Rounds after which at most ``residual`` of the mass moves: each round keeps ``damping`` of it, or less where hosts have no way on."""
    return ceil(log(residual) / log(damping))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, residual: float = RESIDUAL, every: int = 2) -> DataFrame:
    """``(host, trust, distrust)`` of both walks.

    ``seeds`` has ``(kind, host, mass)`` with kind ``trust`` or ``distrust``.
    The rank is a sum over the lengths of walks: each round moves what arrived
    in the last one a step on and adds it, until at most ``residual`` of the
    mass is left, which :func:`rounds_for` tells, or sooner where nothing
    moves any more.  Edges are summed per pair, so a hub costs as many rows as
    it has neighbours, and they are dealt over tasks; ranks are summed before
    they are shuffled; the lineage is cut every few rounds by a table in the
    shared folder.
    """
    along = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    against = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    both, keys = along.unionByName(against), ["kind", "a"]
    out = materialize(both.groupBy(*keys).agg(F.sum("n").alias("all"), F.count("*").alias("n")), "host-out")
    hubs = hot_keys(out, keys, HUB_LINKS)
    none = hubs.isEmpty()
    walk = salted(both, hubs, keys, F.col("b")).join(spread(out.select(*keys, "all"), hubs, keys), [*keys, "salt"])
    walk = materialize(walk.select(*keys, "salt", "b", (F.col("n") / F.col("all")).alias("w")), "host-walk")
    mean = F.broadcast(seeds.groupBy("kind").agg(F.avg("mass").alias("mean")))  # two rows at most
    start = seeds.join(mean, "kind").where("mean > 0").select("kind", "host", (F.col("mass") / F.col("mean") * (1 - damping)).alias("rank"))
    state = materialize(start.withColumn("step", F.col("rank")), "host-seeds")
    rounds, table = rounds_for(residual, damping), state
    for i in range(rounds):
        ahead = state.where("step > 0").select("kind", F.col("host").alias("a"), "step")
        ahead = ahead.withColumn("salt", F.lit(0)) if none else spread(ahead, hubs, keys)
        moved = walk.join(ahead, [*keys, "salt"]).select("kind", F.col("b").alias("host"), (F.col("w") * F.col("step") * damping).alias("rank"))
        moved = moved.withColumn("step", F.col("rank"))
        state = state.select("kind", "host", "rank", F.lit(0.0).alias("step")).unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("step").alias("step"))
        if (i + 1) % every == 0 and i + 1 < rounds:
            old, state = table, materialize(state, "host-rank")
            table = state
            discard(old)
            if (state.agg(F.sum("step")).first()[0] or 0.0) < 1e-12:
                break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return state.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 1e-6) -> DataFrame:
    """``(page_id, url, host, path, rule, verdict, trust, distrust)`` of each page.

    The longest rule that fits decides; other pages are blocked where their
    host's distrust exceeds its trust by more than ``threshold`` mean seeds.
    Hosts that no walk reaches, the empty host among them, are allowed.  A
    null url has an empty host and path, null html has no links; repeated rows
    count as often as they occur, as seeds and as links; a very long page is
    searched whole; an empty table gives no rows; other columns are left out.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    flat = rows.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    seeds = flat.where("by_rule is not null").select(F.when(F.col("by_rule") == "allow", "trust").otherwise("distrust").alias("kind"), "host").groupBy("kind", "host").agg(F.count("*").cast("double").alias("mass"))
    scores = materialize(propagate(materialize(host_edges(rows), "host-edges"), seeds), "host-scores")
    # The scores are read from a table, so Spark knows their size and broadcasts them only below its threshold.
    scored = flat.join(scores, "host", "left")
    bad = F.round(F.coalesce("distrust", F.lit(0.0)) - F.coalesce("trust", F.lit(0.0)), 9) > threshold
    return scored.select("page_id", "url", "host", "path", "rule", F.coalesce("by_rule", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
