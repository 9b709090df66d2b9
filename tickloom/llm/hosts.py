"""URL verdicts from rules and from trust that spreads over links between hosts, in DataFrame operations only.

Rules judge the urls that they fit, the longest first. Of every host, the share of its pages that rules allow makes it a
trusted seed and the share that they block a distrusted one. Trust follows links (personalised PageRank from the trusted
seeds, along edges weighted by their number); distrust follows them backwards, to those who link to blocked hosts. A page
that no rule fits is blocked if its host's distrust reaches ``least`` and exceeds its trust.

Links are counted per (host, host) before they are shuffled, and each round joins that table with one row a host; a hub's
messages are summed within tasks first. Rounds are cut by tables in the shared folder. What reaches a host that links nowhere
stays there for that round and is not given back to the seeds. There are ``rounds`` rounds, 12 unless said otherwise: hosts farther than
that from a seed get nothing, and up to 0.85 ** 12 = 14 % of a seed's mass is cut off.

Nulls and edge cases: a null url or one without ``://`` has an empty host and path, which no rule fits and no link leads
to, and is allowed; a null html has no links; links of a host to itself are left out; pages without any link between
hosts are judged by the seeds alone; rows that repeat a page_id are judged each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def _after_scheme() -> Column:
    return F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")


def split_urls(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path of ``url``."""
    rest = pages.withColumn("__rest", F.coalesce(_after_scheme(), F.lit(""))).withColumn("__raw", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substr(__rest, length(__raw) + 1)"), r"^[^?#]*", 0)
    return rest.withColumn("host", F.translate("__raw", UPPER, LOWER)).withColumn("path", path).drop("__rest", "__raw")


def fitted(rules: list[Rule]) -> Column:
    """The name of the longest rule that fits host and path, else null. The list of rules is part of the plan: a few hundred."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        out = F.when(fits, F.lit(rule.name)).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and n: links between different hosts, from pages with host and html."""
    found = pages.where("host <> ''").select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))).alias("to"))
    linked = found.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst and dst <> ''")
    return linked.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 12, damping: float = 0.85, every: int = 4) -> DataFrame:
    """host, trust and distrust after ``rounds`` steps from seeds (host, trusted, blocked)."""
    edges = cut(edges, "edges")
    seeds = cut(seeds, "seeds")
    now = seeds.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"))
    if edges.isEmpty():
        return now  # nothing to spread over
    given = edges.groupBy("src").agg(F.sum("n").alias("given"))
    taken = edges.groupBy("dst").agg(F.sum("n").alias("taken"))
    shares = cut(edges.join(given, "src").join(taken, "dst").select("src", "dst", (F.col("n") / F.col("given")).alias("onward"), (F.col("n") / F.col("taken")).alias("back")), "shares")
    every_host = shares.select(F.col("src").alias("host")).union(shares.select("dst")).union(seeds.select("host")).distinct()
    start = cut(every_host.join(seeds, "host", "left").select("host", F.coalesce("trusted", F.lit(0.0)).alias("trusted"), F.coalesce("blocked", F.lit(0.0)).alias("blocked")), "start")
    now = start.select("host", (F.col("trusted") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"))
    for k in range(1, rounds + 1):
        ahead = shares.join(now, shares.src == now.host).select(F.col("dst").alias("to"), (F.col("trust") * F.col("onward")).alias("t"), F.lit(0.0).alias("b"))
        behind = shares.join(now, shares.dst == now.host).select(F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("b"))
        sent = ahead.unionByName(behind).groupBy("to").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        now = start.join(sent, start.host == sent["to"], "left").select(
            "host",
            (F.col("trusted") * (1 - damping) + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            (F.col("blocked") * (1 - damping) + damping * F.coalesce("b", F.lit(0.0))).alias("distrust"),
        )
        if k % every == 0 or k == rounds:
            now = cut(now, "ranks")
    return now


def judge(pages: DataFrame, rules: list[Rule], rounds: int = 12, damping: float = 0.85, least: float = 0.05) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url, html)."""
    split = split_urls(pages.select("page_id", "url", "html")).withColumn("rule", fitted(rules))
    allows = F.col("rule").isin([r.name for r in rules if r.verdict == "allow"])
    blocks = F.col("rule").isin([r.name for r in rules if r.verdict == "block"])
    seeds = split.where("host <> ''").groupBy("host").agg(F.avg(F.coalesce(allows.cast("int"), F.lit(0))).alias("trusted"), F.avg(F.coalesce(blocks.cast("int"), F.lit(0))).alias("blocked"))
    ranks = propagate(host_edges(split), seeds, rounds, damping)
    bad = ranks.where((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad"))
    ruled = F.when(allows, "allow").when(blocks, "block")
    return split.select("page_id", "host", "path", "rule").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(ruled, F.when(F.col("bad"), "block"), F.lit("allow")).alias("verdict"))


def sql(rules: list[Rule], rounds: int = 12, damping: float = 0.85, least: float = 0.05) -> str:
    """DuckDB SQL for the rows of ``judge``."""
    cases = "\n".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in sorted(rules, key=lambda r: -len(r.name))
    )
    lists = {v: ", ".join(f"'{r.name}'" for r in rules if r.verdict == v) for v in ("allow", "block")}
    steps = [f"r0 AS MATERIALIZED (SELECT host, trusted * {1 - damping!r} AS trust, blocked * {1 - damping!r} AS distrust FROM start)"]
    for k in range(1, rounds + 1):
        steps.append(f"""r{k} AS MATERIALIZED (SELECT host, trusted * {1 - damping!r} + {damping!r} * coalesce((SELECT sum(r.trust * onward) FROM shares JOIN r{k - 1} r ON r.host = src WHERE dst = start.host), 0) AS trust,
            blocked * {1 - damping!r} + {damping!r} * coalesce((SELECT sum(r.distrust * back) FROM shares JOIN r{k - 1} r ON r.host = dst WHERE src = start.host), 0) AS distrust FROM start)""")
    link = LINK.replace("'", "''")
    return f"""
WITH a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
split AS MATERIALIZED (SELECT *, CASE {cases} END AS rule FROM c),
seeds AS (SELECT host, avg(coalesce(rule IN ({lists['allow']}), false)::INT) AS trusted, avg(coalesce(rule IN ({lists['block']}), false)::INT) AS blocked FROM split WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM split WHERE host <> ''),
edges AS (SELECT src, dst, count(*)::DOUBLE AS n FROM links WHERE src <> dst AND dst <> '' GROUP BY ALL),
shares AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS onward, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges),
every AS (SELECT src AS host FROM shares UNION SELECT dst FROM shares UNION SELECT host FROM seeds),
start AS MATERIALIZED (SELECT host, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked FROM every LEFT JOIN seeds USING (host)),
{', '.join(steps)}
SELECT page_id, host, path, rule, CASE WHEN rule IN ({lists['allow']}) THEN 'allow' WHEN rule IN ({lists['block']}) THEN 'block'
    WHEN distrust >= {least} AND distrust > trust THEN 'block' ELSE 'allow' END AS verdict
FROM split LEFT JOIN r{rounds} USING (host)
"""
