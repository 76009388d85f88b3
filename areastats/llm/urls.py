"""URL filters: rules on hosts and paths, and trust carried along links between hosts.

A rule names a host and a path prefix; it fits that host and its subdomains, and of those that fit the
longest decides. Hosts of allowed pages are seeds of trust, hosts of blocked pages seeds of distrust, each by its
number of such pages. Trust flows along links as personalised PageRank; distrust flows against
them, from a page to those that link to it. A page without a rule is blocked if its host has more distrust
than trust, else allowed.

Edges join hosts: links with a host of their own in the pages' markup, and a host with its parent domain,
both ways, where that has pages too. Edges are counted per pair of hosts before anything else, so a host with a third of
all pages is one row; scores are joined to edges and summed, with no step that gathers a
host's neighbours. Scores start from the seeds' own and only grow. Steps go on until no host's score grows by more than
`TOLERANCE` of itself over the last few, and trust and distrust are compared by their ratio: neither the distance from a
seed nor the number of hosts, which scores shrink with, decides.

Defined results: a NULL url, or one without `://`, has empty host and path; no rule fits it,
and it is allowed. NULL markup has no links. Repeated rows are judged alike and count each
time. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areastats.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
#: Steps of the SQL beside the query; the operator goes on until scores settle.
ITERATIONS = 20
STORE_EVERY = 5
#: Largest growth of any host's score, as part of itself, in the last STORE_EVERY steps.
TOLERANCE = 1e-8
#: Distrust must exceed trust by so much of it: above rounding and what TOLERANCE leaves open.
MARGIN = 1e-7
LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*[a-z][a-z0-9+.-]*://([^/?#\"'\s<>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(after, "^([^/?#]*)", 1)
    path = F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def parents(host: Column) -> Column:
    """A host and the domains above it: a.b.c gives a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def fitting_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Hosts with their rules, longest first (and block before allow): host, rules."""
    rows = [(r.partition("/")[0].lower(), "/" + r.partition("/")[2], r, verdict) for verdict, r in rules]
    table = hosts.sparkSession.createDataFrame(rows, "domain string, prefix string, rule string, verdict string")
    # The most negative length first; the rule table is as long as the caller's list.
    entry = F.struct((-F.length("rule")).alias("order"), F.expr("verdict = 'allow'").alias("mild"), "prefix", "rule", "verdict")
    return (
        hosts.withColumn("domain", F.explode(parents(F.col("host"))))
        .join(table, "domain")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list(entry)).alias("rules"))
    )


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """Links between different hosts with their number: src, dst, w."""
    links = (
        pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(LINK), 1)).alias("dst"))
        .select(F.col("host").alias("src"), F.translate("dst", UPPER, LOWER).alias("dst"))
        .where("src <> dst AND src <> ''")
    )
    up = hosts.where("host LIKE '%.%'").select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("above"))
    up = up.join(hosts.select(F.col("host").alias("above")), "above")
    family = up.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("above").alias("dst")), F.struct(F.col("above").alias("src"), F.col("host").alias("dst")))).alias("e"))
    linked = links.groupBy("src", "dst").agg(F.count("*").alias("w"))
    return linked.unionByName(family.select("e.src", "e.dst", F.lit(1).cast("long").alias("w"))).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Trust and distrust per host (kind, host, score) from seeds (kind, host, s), both kinds at once.

    A host first reached counts as grown by all of its score, so no path ends before its last host.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w")
    )
    out = both.groupBy("kind", "a").agg(F.sum("w").alias("all"))
    steps = scratch.store(both.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("all")).alias("share")), "steps")
    total = seeds.groupBy("kind").agg(F.sum("s").alias("all"))
    start = scratch.store(seeds.where("s > 0").join(total, "kind").select("kind", "host", (F.col("s") / F.col("all")).alias("score")), "seeds")
    again = start.select("kind", "host", (F.col("score") * (1 - damping)).alias("score"))
    scores, growth = scratch.store(again, "scores"), 1.0
    while growth > tolerance:
        before = scores
        for _ in range(STORE_EVERY):
            moved = steps.join(scores.withColumnRenamed("host", "a"), ["kind", "a"])
            moved = moved.select("kind", F.col("b").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            scores = moved.unionByName(again).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        scores = scratch.store(scores, "scores")
        grown = scores.unionByName(before.withColumn("score", -F.col("score"))).groupBy("kind", "host")
        grown = grown.agg(F.sum("score").alias("more"), F.max("score").alias("score")).where("score > 0")
        growth = grown.agg(F.coalesce(F.max(F.col("more") / F.col("score")), F.lit(0.0))).first()[0]
        scratch.drop(before)
    return scores


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per page: key, host, path, rule (NULL if none fits), verdict, trust, distrust (of the host)."""
    scratch = Scratch(pages.sparkSession)
    parts = pages.withColumn("_url", F.coalesce(F.col(url), F.lit("")))
    host, path = host_and_path(F.col("_url"))
    parts = parts.select(F.col(key).alias("_key"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    light = parts.select("_key", "host", "path")
    counts = scratch.store(light.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    hosts = counts.select("host")
    ruled = scratch.store(fitting_rules(hosts, rules), "host-rules")

    # A row per host, read from a file of known size: Spark broadcasts it while it is small.
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"]))
    judged = light.join(ruled, "host", "left").withColumn("fit", F.get(fits, 0))
    judged = judged.select("_key", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("given"))
    seeds = judged.where("given IS NOT NULL").select(F.when(F.col("given") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
    seeds = seeds.groupBy("kind", "host").agg(F.count("*").cast("double").alias("s"))
    scores = propagate(host_edges(parts, hosts), seeds)
    per_host = scores.groupBy("host").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")]
    )
    per_host = scratch.store(per_host.join(hosts, "host"), "host-scores")
    distrusted = F.coalesce(F.col("distrust") > F.col("trust") * (1 + MARGIN), F.lit(False))
    return judged.join(per_host, "host", "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("given", F.when(distrusted, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def _oracle() -> str:
    rules = ", ".join(
        f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}', {len(r)})" for v, r in RULES
    )
    steps = []
    for i in range(ITERATIONS):
        steps.append(
            f"s{i + 1} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM ("
            f"SELECT steps.kind, steps.b AS host, score * share * {DAMPING} AS score FROM steps JOIN s{i} ON steps.kind = s{i}.kind AND a = s{i}.host "
            f"UNION ALL SELECT kind, host, score * {1 - DAMPING} FROM s0) GROUP BY ALL)"
        )
    return rf"""
WITH u AS (
  SELECT page_id, html, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), rules(domain, prefix, rule, given, n) AS (VALUES {rules}),
j AS (
  SELECT page_id, p.host, path, arg_max(rule, n) AS rule, arg_max(given, n) AS given, count(*) AS copies
  FROM p LEFT JOIN rules ON (host = domain OR ends_with(host, '.' || domain)) AND starts_with(path, prefix) GROUP BY page_id, p.host, path
), h AS (SELECT DISTINCT host FROM p),
links AS (
  SELECT host AS src, translate(x, '{UPPER}', '{LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']?\s*[a-z][a-z0-9+.-]*://([^/?#"''\s<>]+)', 1)) AS x FROM p)
), fam AS (
  SELECT h.host AS a, g.host AS b FROM h JOIN h g ON h.host LIKE '%.%' AND g.host = substr(h.host, instr(h.host, '.') + 1)
), e AS (
  SELECT src, dst, sum(w) AS w FROM (
    SELECT src, dst, 1 AS w FROM links WHERE src <> dst AND src <> ''
    UNION ALL SELECT a, b, 1 FROM fam UNION ALL SELECT b, a, 1 FROM fam) GROUP BY ALL
), both_ways AS (SELECT 'trust' AS kind, src AS a, dst AS b, w FROM e UNION ALL SELECT 'distrust', dst, src, w FROM e),
steps AS (SELECT kind, a, b, w::DOUBLE / sum(w) OVER (PARTITION BY kind, a) AS share FROM both_ways),
seeds AS (
  SELECT CASE WHEN given = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*)::DOUBLE AS s
  FROM j WHERE given IS NOT NULL GROUP BY ALL
), s0 AS (SELECT kind, host, s / sum(s) OVER (PARTITION BY kind) AS score FROM seeds),
{", ".join(steps)},
v AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust,
    coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust FROM s{ITERATIONS} GROUP BY host
)
SELECT page_id, j.host, path, rule,
  coalesce(given, CASE WHEN round(coalesce(distrust - trust, 0), 12) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN v USING (host)
"""


ORACLE = _oracle()
