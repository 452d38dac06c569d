"""URL filters: host rules, and trust propagated over the host graph where no rule fits.

Everything here is DataFrame expressions.  The host graph has one edge for each pair of hosts that link (absolute
``href`` targets; links within a host are left out), and edges between a host and the domain above it, so its size is bounded
by hosts, not by pages or links.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import ascii_lower, bounded, drop, read, table

HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""
#: Share of a node's score that flows on, and what may be left to flow when propagation stops.
DAMPING, REST = 0.85, 1e-3
#: A host is blocked if distrust is more than this share of what reaches it, so many pages of trust being added to each host's.
SUSPECT, DOUBT = 0.5, 2.0


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The production rules: block net/, allow example.net/en/, block example.com/de/, allow org/fr/.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule's name, or null.  The rules are the caller's list and part of the plan; keep it to some hundred."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.name).otherwise(found)
    return found


def node_of(host: Column) -> Column:
    """A host without user information."""
    return F.regexp_replace(host, "^[^@]*@", "")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rest: float = REST) -> DataFrame:
    """Personalised PageRank: (host, rank), ranks summing to 1.  edges: src, dst, weight (weights from a host sum to 1); seeds: host, seed (not negative).

    A walk starts at the seeds and goes on with probability ``damping``; where it can't, it starts again.  Walks of 0, 1, 2, ...
    steps are summed until what is left of them is under ``rest`` of the whole, so distance from the seeds has no limit of its own.
    Each step joins to edges on the host and sums by target, which combines map-side, and is written: plans stay short and
    lost executors cost one step.
    """
    now = table(seeds.filter("seed > 0").select("host", F.col("seed").cast("double").alias("part")), "walks")
    start = now.agg(F.sum("part")).first()[0] or 0.0
    parts, left = [now], start
    while left > rest * start:
        seen = Observation()
        step = edges.join(now, edges.src == now.host).select(F.col("dst").alias("host"), (damping * F.col("weight") * F.col("part")).alias("part")).groupBy("host").agg(F.sum("part").alias("part"))
        now = table(step.observe(seen, F.sum("part").alias("left")), "walks")
        left = seen.get["left"] or 0.0
        parts.append(now)
        if len(parts) == 16:
            whole = table(reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("part").alias("part")), "walked")
            drop(*parts[:-1])
            parts = [whole]
    summed = reduce(DataFrame.unionByName, parts).groupBy("host").agg(F.sum("part").alias("part"))
    total = summed.agg(F.sum("part")).first()[0] or 1.0
    return summed.select("host", (F.col("part") / total).alias("rank"))


def domains(hosts: DataFrame) -> DataFrame:
    """src, dst between each host and the domain above it, and so on up to two labels, in both directions.  hosts: host.  Addresses in numbers have none."""
    labels = F.split("host", "[.]")
    named = hosts.filter(~F.col("host").rlike("^[0-9.:\\[\\]]*$")).select(labels.alias("labels")).filter(F.size("labels") > 2)
    name = lambda i: F.array_join(F.slice("labels", i, F.size("labels")), ".")
    steps = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("labels") - 2), lambda i: F.struct(name(i).alias("src"), name(i + 1).alias("dst")))).alias("e")).select("e.src", "e.dst").distinct()
    return steps.unionByName(steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def host_verdicts(judged: DataFrame, links: DataFrame, damping: float = DAMPING, suspect: float = SUSPECT, doubt: float = DOUBT) -> DataFrame:
    """(host, trust, distrust, host_verdict).  judged: host, ruled ('allow', 'block' or null) by page; links: src, dst.

    Hosts with allowed pages are trusted seeds and hosts with blocked ones distrusted seeds, by their number of such pages.
    Trust flows along links, distrust against them (who links to a blocked host is suspect), and both between a host and
    the domain above it.  Scores are pages' worth: all trust together is the number of allowed pages, all distrust that of
    blocked ones.  A host is blocked if distrust is more than ``suspect`` of distrust, trust and ``doubt``, so a single
    page decides nothing; a host that nothing reaches is allowed.
    """
    hosts = table(judged.groupBy(node_of(F.col("host")).alias("host")).agg(F.sum(F.when(F.col("ruled") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("ruled") == "block", 1).otherwise(0)).alias("blocked")), "hosts")
    pairs = table(links.filter("src != dst and src != '' and dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n")), "host_edges")
    above = table(domains(hosts.select("host")).withColumn("n", F.lit(1).cast("bigint")), "domains")
    # both walks at once, on a graph that holds the hosts twice
    kinds = (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src"))
    named = lambda kind, c: F.concat(F.lit(f"{kind} "), F.col(c))
    totals = hosts.agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).first()
    flows, seeds = [], []
    for kind, pages, src, dst in kinds:
        flow = pairs.select(F.col(src).alias("src"), F.col(dst).alias("dst"), "n").unionByName(above).groupBy("src", "dst").agg(F.sum("n").alias("n"))
        out = flow.groupBy(F.col("src").alias("origin")).agg(F.sum("n").alias("total"))
        flows.append(flow.join(out, flow.src == out.origin).select(named(kind, "src").alias("src"), named(kind, "dst").alias("dst"), (F.col("n") / F.col("total")).alias("weight")))
        seeds.append(hosts.select(named(kind, "host").alias("host"), (F.col(pages) / F.lit(float(totals[pages] or 1))).alias("seed")))
    ranks = table(propagate(table(flows[0].unionByName(flows[1]), "flow"), seeds[0].unionByName(seeds[1]), damping), "ranks")
    both = hosts.select("host")
    for kind, pages, _, _ in kinds:
        own = ranks.filter(F.col("host").startswith(f"{kind} ")).select(F.substring("host", len(kind) + 2, 1 << 30).alias("host"), "rank")
        whole = own.agg(F.sum("rank")).first()[0] or 1.0
        both = both.join(own.select("host", (F.col("rank") * F.lit((totals[pages] or 0) / whole)).alias(kind)), "host", "left")
    both = both.fillna(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > F.lit(suspect) * (F.col("trust") + F.col("distrust") + F.lit(doubt))
    return both.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, suspect: float = SUSPECT, doubt: float = DOUBT) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed.  Null html has no links.
    User information in a host (``user@``) is shown but is not part of the node of the host graph.  Repeated rows are judged
    alike and count each; other columns, whatever their names, are not looked at.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    named = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(verdicts)
    named = named.withColumn("ruled", verdicts)
    links = pages.select(node_of(host_of(F.col("url"))).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))
    links = links.select("src", ascii_lower(node_of(F.col("target"))).alias("dst"))
    blocked = table(host_verdicts(named.filter("host != ''"), links, damping, suspect, doubt).filter("host_verdict = 'block'").select(F.col("host").alias("bad_host")), "blocked_hosts")
    joined = named.join(bounded(blocked), node_of(F.col("host")) == F.col("bad_host"), "left")
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))
