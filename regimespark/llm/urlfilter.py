"""URL filtering by rules and, where none fits, by trust and distrust over the link graph.

Hosts and their parent domains are nodes. Edges are hyperlinks to other hosts and, both ways,
the steps from a host up to each ancestor with at least one dot, crawled or not, so that sibling
hosts reach each other. Trust is personalised PageRank from the hosts with
allowed pages along the links; distrust is the same from hosts with blocked pages against the
links, as a page that links to bad pages is suspect. A host whose distrust exceeds THRESHOLD
times its trust, both weighed by their seeds' pages, is blocked; flows that are equal but for their
last bits (within EVEN of each other) do not exceed each other. Rounds follow from UNSETTLED, the
share of the mass that may still be under way. What reaches a host without a way on goes back to
the seeds: as that repeats the whole flow, it is done by scaling the scores to the seeds' mass.

Only DataFrame functions are used. The graph is aggregated to host pairs before it is joined.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is
allowed; equal edges add their weights; hosts that no seed reaches are allowed; repeated rows
are judged alike; an empty table gives no rows; other columns are ignored; numeric addresses and
names with empty labels have no parents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, materialise, measured

# The rules of the contract, (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DAMPING, THRESHOLD, UNSETTLED, EVEN = 0.85, 1.0, 0.01, 1e-9
ROUNDS = math.ceil(math.log(UNSETTLED) / math.log(DAMPING))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url):
    """(host, path) of a url column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def longest_rule(host, path, rules):
    """(rule text, verdict) of the longest fitting rule; of equally long ones, the first listed."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True)[::-1]:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, and steps between hosts and all their parent domains, crawled or not."""
    target = F.regexp_replace(F.col("link"), r"(?is)^.*?href\s*=\s*[\"']?\s*", "")
    links = pages.select("host", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*(?:https?:)?//[^\"'>\s]+"), F.lit(0))).alias("link"))
    links = links.select(F.col("host").alias("src"), F.translate(F.regexp_extract(target, r"//([^/?#:\"']+)", 1), _UPPER, _LOWER).alias("dst"))
    named = F.col("host").rlike(r"^[^.]+(\.[^.]+){2,}$") & ~F.col("host").rlike(r"^[0-9.]+(:[0-9]*)?$")
    labels = pages.select("host").distinct().where(named).select(F.split("host", r"\.").alias("q"))
    steps = labels.select("q", F.explode(F.sequence(F.lit(1), F.size("q") - 2)).alias("i"))
    up = steps.select(*(F.array_join(F.slice("q", F.col("i") + k, F.size("q")), ".").alias(c) for k, c in enumerate(("src", "dst")))).distinct()
    both = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = links.groupBy("src", "dst").agg(F.count("*").alias("w")).unionByName(both.withColumn("w", F.lit(1).cast("long")))
    return links.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.sum("w").cast("double").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Personalised PageRank (kind, node, score) of seeds(kind, node, s) over edges(kind, src, dst, w), each kind in a graph of its own; the scores of a kind sum to its seeds."""
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("out"))
    share = materialise(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("out")).alias("p")), "url-share")
    score = seeds.select("kind", "node", F.col("s").alias("score"))
    back = seeds.select("kind", "node", (F.col("s") * (1 - damping)).alias("x"))
    for k in range(rounds):
        flow = share.join(score.withColumnRenamed("node", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("node"), (F.col("p") * F.col("score") * damping).alias("x"))
        score = flow.unionByName(back).groupBy("kind", "node").agg(F.sum("x").alias("score"))
        if k % 4 == 3 or k == rounds - 1:
            score = materialise(score, "url-score")
    # two rows at most
    scale = score.groupBy("kind").agg(F.sum("score").alias("all")).join(seeds.groupBy("kind").agg(F.sum("s").alias("mass")), "kind")
    return score.join(F.broadcast(scale), "kind").select("kind", "node", (F.col("score") / F.col("all") * F.col("mass")).alias("score"))


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages(page_id, url, html)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = materialise(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given")), "url-ruled")
    hosts = ruled.groupBy("host").agg(F.count("*").alias("pages"), *(F.count(F.when(F.col("given") == v, 1)).alias(v) for v in ("allow", "block")))
    hosts, seen = measured(hosts, "url-hosts", pages=F.sum("pages"), top=F.max("pages"))
    edges = materialise(host_edges(rows), "url-edges")
    graphs = edges.select(F.lit("allow").alias("kind"), "src", "dst", "w").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    seeds = hosts.select(F.col("host").alias("node"), F.explode(F.create_map(F.lit("allow"), F.col("allow"), F.lit("block"), F.col("block"))).alias("kind", "n")).where("n > 0")
    scores = propagate(graphs, materialise(seeds.select("kind", "node", F.col("n").cast("double").alias("s")), "url-seeds"))
    scores = scores.groupBy("node").agg(*(F.sum(F.when(F.col("kind") == v, F.col("score"))).alias(f"{v}_score") for v in ("allow", "block")))
    graded = hosts.select("host", "pages").join(scores.withColumnRenamed("node", "host"), "host", "left")
    bad = F.coalesce("block_score", F.lit(0.0)) > F.coalesce("allow_score", F.lit(0.0)) * (threshold * (1 + EVEN))
    graded = materialise(graded.select("host", "pages", F.when(bad & (F.col("host") != ""), "block").otherwise("allow").alias("found")), "url-graded")
    out = hot_join(ruled, graded, ["host"], "pages", seen["pages"], ["page_id"], "left", seen["top"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "found").alias("verdict"))


def op10_link_trust(spark, sf_dir: str) -> DataFrame:
    """Every page's rule and verdict."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """DuckDB SQL of op10, its rounds written out."""
    pick = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"
    rounds = []
    for name, a, b in (("allow", "src", "dst"), ("block", "dst", "src")):
        rounds.append(f"{name}_g AS MATERIALIZED (SELECT {a} AS a, {b} AS z, w / sum(w) OVER (PARTITION BY {a}) AS p FROM e)")
        rounds.append(f"{name}_s AS MATERIALIZED (SELECT host AS node, {name}_n::DOUBLE AS s FROM h WHERE {name}_n > 0)")
        rounds.append(f"{name}_0 AS MATERIALIZED (SELECT node, s AS score FROM {name}_s)")
        for k in range(ROUNDS):
            rounds.append(
                f"{name}_{k + 1} AS MATERIALIZED (SELECT node, sum(x) AS score FROM (SELECT z AS node, p * score * {DAMPING}::DOUBLE AS x FROM {name}_g JOIN {name}_{k} ON a = node"
                f" UNION ALL SELECT node, s * {1 - DAMPING!r}::DOUBLE FROM {name}_s) GROUP BY 1)"
            )
        rounds.append(f"{name}_r AS MATERIALIZED (SELECT node, score / (SELECT sum(score) FROM {name}_{ROUNDS}) * (SELECT sum(s) FROM {name}_s) AS score FROM {name}_{ROUNDS})")
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
r0 AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS MATERIALIZED (SELECT page_id, html, host, path, {pick} AS best FROM r0),
h AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE best LIKE 'allow %') AS allow_n, count(*) FILTER (WHERE best LIKE 'block %') AS block_n FROM r GROUP BY 1),
l0 AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//[^"''>\s]+')) AS link FROM r),
l AS (SELECT src, translate(regexp_extract(link, '(?is)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#:"'']+)', 1), '{_UPPER}', '{_LOWER}') AS dst, 1 AS w FROM l0),
up0 AS (SELECT string_split(host, '.') AS q FROM h WHERE regexp_matches(host, '^[^.]+(\.[^.]+){{2,}}$') AND NOT regexp_matches(host, '^[0-9.]+(:[0-9]*)?$')),
up1 AS (SELECT q, unnest(range(1, len(q) - 1)) AS i FROM up0),
up AS (SELECT DISTINCT array_to_string(q[i:], '.') AS src, array_to_string(q[i + 1:], '.') AS dst FROM up1),
e AS MATERIALIZED (SELECT src, dst, sum(w)::DOUBLE AS w FROM (SELECT * FROM l UNION ALL SELECT src, dst, 1 FROM up UNION ALL SELECT dst, src, 1 FROM up) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
{", ".join(rounds)}
SELECT page_id, r.host, path, substr(best, 7) AS rule, coalesce(substr(best, 1, 5), CASE WHEN r.host <> '' AND coalesce(b.score, 0) > coalesce(a.score, 0) * {THRESHOLD * (1 + EVEN)!r}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM r LEFT JOIN allow_r a ON a.node = r.host LEFT JOIN block_r b ON b.node = r.host
"""


OP10_SQL = _sql()
