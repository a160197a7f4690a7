"""URL filters: rules by host and path, and trust carried along links between hosts.

Personalised PageRank starts from hosts of pages that a rule allows (trust, along the links) and
of pages that a rule blocks (distrust, against the links).  A host whose distrust exceeds its
trust is blocked; pages that a rule fits keep the rule's verdict.  Everything is DataFrame
operations over an edge table aggregated to one row per pair of hosts.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule; null or
empty html has no links; links within a host and links without a host count for nothing; repeated
pages count as often as they come; rank that reaches a host without links leaves the graph; a host
that neither trust nor distrust reaches is allowed; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import table, written

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Rules are compared one by one in a single expression; longer lists belong in a table.
MOST_RULES = 200
LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'>\s]*)"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
DAMPING, ITERATIONS, CUT_EVERY = 0.85, 10, 5


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), ascii_uppercase, ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, n."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))
    found = found.select("src", host_of(F.col("href")).alias("dst")).where("src != '' AND dst != '' AND src != dst")
    return found.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS) -> DataFrame:
    """(kind, host, rank) from seeds (kind, host, weight): ``trust`` along links, ``distrust`` against them."""
    links = written(links, "links")
    out = links.groupBy(F.col("src").alias("s")).agg(F.sum("n").alias("all"))
    into = links.groupBy(F.col("dst").alias("s")).agg(F.sum("n").alias("all"))
    along = links.join(out, F.col("src") == F.col("s")).select(F.lit("trust").alias("k"), F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("n") / F.col("all")).alias("share"))
    against = links.join(into, F.col("dst") == F.col("s")).select(F.lit("distrust").alias("k"), F.col("dst").alias("a"), F.col("src").alias("b"), (F.col("n") / F.col("all")).alias("share"))
    edges = written(along.unionByName(against), "edges")
    start = written(seeds.select("kind", "host", (F.col("weight") * (1 - damping)).alias("rank")), "seeds")
    ranks = start
    for k in range(iterations):
        moved = edges.join(ranks, (F.col("k") == F.col("kind")) & (F.col("a") == F.col("host")))
        moved = moved.select("kind", F.col("b").alias("host"), (damping * F.col("share") * F.col("rank")).alias("rank"))
        ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (k + 1) % CUT_EVERY == 0:
            ranks = written(ranks, "ranks")
    return ranks


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    read = pages.select(F.col(id_col).alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("html").alias("html"))
    rule, what = rule_of(F.col("host"), F.col("path"), rules)
    read = read.withColumns({"rule": rule, "_what": what})
    seeds = read.where("_what IS NOT NULL").groupBy(F.when(F.col("_what") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    total = seeds.groupBy(F.col("kind").alias("t")).agg(F.sum("n").alias("all"))
    seeds = seeds.join(F.broadcast(total), F.col("kind") == F.col("t")).select("kind", "host", (F.col("n") / F.col("all")).alias("weight"))  # two rows at most
    ranks = propagate(host_links(read), seeds)
    rank = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    blocked = ranks.groupBy(F.col("host").alias("h")).agg(rank("trust").alias("t"), rank("distrust").alias("d")).where(F.round("d", 12) > F.round("t", 12))
    blocked = written(blocked.select("h"), "blocked")
    judged = read.drop("html").join(blocked, F.col("host") == F.col("h"), "left")
    verdict = F.coalesce("_what", F.when(F.col("h").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op5_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _oracle() -> str:
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}'), '')"
    fits = []
    for what, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{slash}{rest}')", text, what))
    rule, verdict = (" ".join(["CASE", *(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits), "END"]) for k in (1, 2))
    steps = ""
    for k in range(ITERATIONS):
        steps += f"""
    r{k + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (
        SELECT kind, host, rank FROM r0 UNION ALL
        SELECT r.kind, e.b AS host, {DAMPING} * e.share * r.rank AS rank FROM edges e JOIN r{k} r ON e.k = r.kind AND e.a = r.host) GROUP BY kind, host),"""
    return f"""
WITH read AS (SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
    judged AS (SELECT *, {rule} AS rule, {verdict} AS what FROM read),
    hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']?([^"''>\\s]*)', 1)) AS href FROM judged),
    links AS (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("href")} AS dst FROM hrefs) WHERE src != '' AND dst != '' AND src != dst GROUP BY src, dst),
    edges AS (SELECT 'trust' AS k, src AS a, dst AS b, n / sum(n) OVER (PARTITION BY src) AS share FROM links
        UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
    seeds AS (SELECT CASE WHEN what = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged WHERE what IS NOT NULL GROUP BY 1, 2),
    r0 AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) * (1 - {DAMPING}) AS rank FROM seeds),{steps}
    blocked AS (SELECT host AS h FROM r{ITERATIONS} GROUP BY host
        HAVING round(coalesce(sum(CASE WHEN kind = 'distrust' THEN rank END), 0), 12) > round(coalesce(sum(CASE WHEN kind = 'trust' THEN rank END), 0), 12))
SELECT page_id, host, path, rule, coalesce(what, CASE WHEN h IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN blocked ON host = h
"""


ORACLE = _oracle()
