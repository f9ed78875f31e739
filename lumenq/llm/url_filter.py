"""URL filters: rules first, then trust and distrust propagated over the link graph of hosts.

Rules name a host suffix and a path prefix. Pages that no rule fits are judged by their host: personalised PageRank
spreads trust from hosts with allowed pages along links, and distrust from hosts with blocked pages against them, to
the hosts that link there. A host is blocked where distrust outweighs trust.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenq.llm._shared import discard, modest_batches, read_table, staged

#: (verdict, host, path) of the production rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING, THRESHOLD = 0.85, 0.5
#: Rounds end when all that has not been dealt out yet, at most the damping to the power of the rounds, is below this.
TOLERANCE = 1e-9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Absolute links; relative ones stay on their host and carry nothing over.
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equal ones a block wins. Null where none fits."""
    name = verdict = None
    for kind, of_host, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block")):
        fits = ((host == of_host) | F.endswith(host, F.lit("." + of_host))) & F.startswith(path, F.lit(prefix))
        name = F.when(fits, F.lit(of_host + prefix)) if name is None else name.when(fits, F.lit(of_host + prefix))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if name is None else (name, verdict)


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute links of every page."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("link"))
    to = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    edges = links.select("src", host_of(to).alias("dst")).where("src <> dst and src <> '' and dst <> ''")
    return edges.groupBy("src", "dst").agg(F.count("*").alias("links"))


def rounds_for(damping: float = DAMPING, tolerance: float = TOLERANCE) -> int:
    """Rounds after which the ranks are settled: what the next ones would add is below tolerance times the seeds."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust): both personalised PageRanks from seeds (host, trust, distrust), in one pass a round.

    Trust of a host is dealt out over its links by their number, distrust over the links that lead to it. A round deals
    on what the round before has dealt: rounds go on until that is below tolerance for every host, relative to the least
    rank that a host has, so that no verdict can change, and hosts at any distance are reached. One number a round
    comes to the driver; a round takes the place of the one before.
    """
    edges = staged(edges, "host-edges")
    base = seeds.select("host", (F.lit(1 - damping) * F.col("trust")).alias("trust"), (F.lit(1 - damping) * F.col("distrust")).alias("distrust"))
    if edges.isEmpty():
        return base
    out = edges.groupBy("src").agg(F.sum("links").alias("out_links"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("in_links"))
    shares = staged(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("links") / F.col("out_links")).alias("forward"), (F.col("links") / F.col("in_links")).alias("backward")), "host-shares")
    total = lambda df: df.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    moving = staged(base, "host-moving")
    ranks = staged(base, "host-ranks")
    hosts = ranks.count()
    while True:
        ahead = shares.join(moving, shares.src == moving.host).select(F.col("dst").alias("host"), (F.col("forward") * F.col("trust") * damping).alias("trust"), F.lit(0.0).alias("distrust"))
        back = shares.join(moving, shares.dst == moving.host).select(F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("backward") * F.col("distrust") * damping).alias("distrust"))
        dealt = staged(total(ahead.unionByName(back)).where("trust > 0 or distrust > 0"), "host-moving")
        new = staged(total(ranks.unionByName(dealt)), "host-ranks")
        discard(moving, ranks)
        moving, ranks, before = dealt, new, hosts
        # the largest share of a rank that this round has added; a round that reaches new hosts adds their whole rank
        change, hosts = new.join(dealt.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left").agg(
            F.max(F.greatest(F.coalesce(F.try_divide("t", "trust"), F.lit(0.0)), F.coalesce(F.try_divide("d", "distrust"), F.lit(0.0)))), F.count("*")
        ).first()
        if hosts == before and (change or 0.0) < tolerance:
            return ranks


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and host_distrust of every row of pages.

    A null url, or one without ://, has an empty host and path; the empty host is never a seed and takes no part in
    the graph. Null html links nowhere. Hosts that neither rank reaches are allowed. Very long urls and html are read
    whole. Repeated rows get a row each and count each as evidence. Other columns are ignored; an empty table gives an empty result.
    """
    modest_batches(pages.sparkSession)
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    seeds = judged.where("host <> '' and by_rule is not null").groupBy("host").agg(F.avg((F.col("by_rule") == "allow").cast("double")).alias("trust"), F.avg((F.col("by_rule") == "block").cast("double")).alias("distrust"))
    ranks = propagate(seeds, host_edges(pages, url_col, html_col))
    # rounded, so that the order of the sums does not decide ties
    share = F.round(F.coalesce(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), F.lit(0.0)), 6)
    hosts = staged(ranks.select("host", share.alias("host_distrust")), "host-verdicts")
    own = F.coalesce("by_rule", F.when(F.coalesce("host_distrust", F.lit(0.0)) > threshold, F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(hosts, "host", "left").select("page_id", "host", "path", "rule", own.alias("verdict"), F.coalesce("host_distrust", F.lit(0.0)).alias("host_distrust"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url under the production rules."""
    return judge_urls(read_table(spark, sf_dir, "pages"))


def _sql(rules=RULES) -> str:
    """The same verdicts in SQL: the ranks are a recursion over rounds of what is dealt on."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in ordered)
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    link = _LINK.replace("'", "''")
    return f"""
WITH RECURSIVE u AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, {host('url')} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM h),
r0 AS (SELECT host, {1 - DAMPING} * avg(CAST(by_rule = 'allow' AS INT)) AS t, {1 - DAMPING} * avg(CAST(by_rule = 'block' AS INT)) AS d FROM j WHERE host <> '' AND by_rule IS NOT NULL GROUP BY host),
l AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS link FROM h),
e AS (SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM l),
n AS (SELECT src, dst, count(*) AS n FROM e WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
sh AS (SELECT src, dst, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS f, n / CAST(sum(n) OVER (PARTITION BY dst) AS DOUBLE) AS b FROM n),
arcs AS (SELECT src AS a, dst AS z, f * {DAMPING} AS f, CAST(0 AS DOUBLE) AS b FROM sh UNION ALL SELECT dst, src, 0, b * {DAMPING} FROM sh),
r AS (SELECT 0 AS k, host, CAST(t AS DOUBLE) AS t, CAST(d AS DOUBLE) AS d FROM r0
      UNION ALL
      SELECT k + 1, z, sum(t * f), sum(d * b) FROM r JOIN arcs ON a = host WHERE k < {rounds_for()} GROUP BY k + 1, z HAVING sum(t * f) > 0 OR sum(d * b) > 0),
k AS (SELECT host, round(coalesce(sum(d) / nullif(sum(t) + sum(d), 0), 0), 6) AS x FROM r GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(x, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(x, 0) AS host_distrust
FROM j LEFT JOIN k ON k.host = j.host"""


OP6_SQL = _sql()
