"""URL filtering by rules, then by trust and distrust spread over the link graph of hosts.

All of it is DataFrame functions. Rules (verb, host and path prefix) decide the pages that they fit;
the longest wins. Other pages get their host's verdict: personalised PageRank spreads trust
along links, and distrust against the links (a host that links to bad hosts is suspect). The
seeds are all hosts with judged pages, each by its own majority: trust by how many more pages are
allowed than blocked, distrust by how many more are blocked. Seeds count pages and are not
scaled to a sum of one, so that trust and distrust can be compared and the threshold means the same at any size.
A host is blocked if its distrust is more than ``threshold`` pages over its trust.

Rounds go on until no host's rank changes by more than ``tolerance`` of itself and the threshold together;
there is no bound on their number, which grows with the logarithm of the seeds' sum, since a step keeps 0.85 of it.
The graph has one weighted edge for each pair of hosts, combined before the shuffle; ranks
have one row a host, so a hub's edges can be split by adaptive execution. Without links
the ranks are the seeds and no round runs.

Defined results: null urls and urls without ``://`` have empty host and path, fit no rule and are
allowed; null html has no links; html of any length is searched whole; an even host seeds nothing; repeated rows are
judged each, and count each; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slicer.llm.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)\bhref\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    out = None
    for verdict, rule in ordered:
        name, slash, below = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + below)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts; weights are numbers of links."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return linked.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def _flows(edges: DataFrame, kind: str, src: str, dst: str) -> DataFrame:
    out = edges.groupBy(F.col(src).alias("of")).agg(F.sum("weight").alias("total"))
    return edges.join(out, edges[src] == out.of).select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("weight") / F.col("total")).alias("share"))


def spread(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-3, floor: float = 1e-3) -> DataFrame:
    """Personalised PageRank (host, trust, distrust) over edges (src, dst, weight) from seeds (host, trust, distrust).

    Trust goes along the edges, distrust against them, in the same rounds. Ranks are settled when none changes by more
    than ``tolerance`` * (rank + ``floor``).
    """
    start = written(seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "seed")).where("seed > 0").select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank")))
    flow = written(_flows(edges, "trust", "src", "dst").unionByName(_flows(edges, "distrust", "dst", "src")))
    ranks, settled = start, flow.isEmpty() or start.isEmpty()
    while not settled:
        passed = flow.join(ranks, (flow.kind == ranks.kind) & (flow.src == ranks.host)).groupBy(flow.kind, F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share") * damping).alias("rank"))
        both = [x.select("kind", "host", *[(F.col("rank") if c == name else F.lit(0.0)).alias(c) for c in ("rank", "before")]) for x, name in ((passed, "rank"), (start, "rank"), (ranks, "before"))]
        after = written(both[0].unionByName(both[1]).unionByName(both[2]).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before")))
        settled = after.where(F.abs(F.col("rank") - F.col("before")) > tolerance * (F.col("rank") + floor)).isEmpty()
        ranks = after.select("kind", "host", "rank")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def verdicts(pages: DataFrame, rules: list[tuple[str, str]], *, threshold: float = 1e-3, tolerance: float = 1e-3) -> DataFrame:
    """Every page with host, path, the rule that decided it (or null), verdict, and its host's trust and distrust."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumns({"host": host, "path": path})
    parsed = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    edges = written(host_edges(parsed))
    more = F.count(F.when(F.col("found.verdict") == "allow", 1)) - F.count(F.when(F.col("found.verdict") == "block", 1))
    hosts = parsed.where("host <> ''").groupBy("host").agg(more.cast("double").alias("more"))
    seeds = hosts.select("host", F.greatest("more", F.lit(0.0)).alias("trust"), F.greatest(-F.col("more"), F.lit(0.0)).alias("distrust"))
    scores = spread(edges, seeds, tolerance=tolerance, floor=threshold)
    bad = F.col("distrust") - F.col("trust") > threshold
    judged = parsed.select("page_id", "host", "path", "found").join(scores, "host", "left")
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
