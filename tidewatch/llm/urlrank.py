"""URL verdicts from rules, and for hosts without a rule from the link graph.

Rules decide first: the longest that fits. A host's remaining pages get the verdict of
its ranks: trust is a personalised PageRank from hosts whose pages the rules allow, along
links; distrust is the same from hosts whose pages they block, against the links. Hosts
whose distrust exceeds `ratio` times their trust are blocked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, TOLERANCE, RATIO, CUT_EVERY = 0.7, 1e-3, 1.0, 6
TIE = 1e-9  # walks that differ relatively by less are equal, however sums are ordered
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*https?://([^/"'?#>\s]+)"""

# The rules of the registered query, as (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def url_parts(pages: DataFrame) -> DataFrame:
    """Add `host` and `path`; both are empty for a null url and one without `://`."""
    rest = F.expr("IF(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')")
    split = pages.withColumn("rest_", F.coalesce(rest, F.lit("")))
    raw = F.regexp_extract("rest_", r"^[^/?#]*", 0)
    return (split.withColumn("host", F.translate(raw, UPPER, LOWER))
            .withColumn("path", F.regexp_extract(
                F.expr("substring(rest_, length(host) + 1)"), r"^[^?#]*", 0))
            .drop("rest_"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each distinct host the rules on it or a domain above it.

    An equi-join on the domain: a host has as many domains as labels.
    """
    domains = hosts.select("host", F.explode(F.expr(
        r"transform(sequence(1, size(split(host, '\\.'))), "
        r"i -> array_join(slice(split(host, '\\.'), i, 1000), '.'))")).alias("domain"))
    parts = rules.select(
        F.substring_index("rule", "/", 1).alias("domain"), "rule", "verdict",
        F.expr("substring(rule, instr(concat(rule, '/'), '/'))").alias("start"),
        (-F.length("rule")).alias("shortness"))
    return (domains.join(parts, "domain").groupBy("host")
            .agg(F.array_sort(F.collect_set(
                F.struct("shortness", "rule", "verdict", "start"))).alias("rules")))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts of the pages' markup.

    Sums are taken before the shuffle. Absolute links count; relative ones stay on their
    host. A host and the domain right above it, if that has a dot, are linked both ways
    once, since the domain's owner answers for both.
    """
    links = (pages.filter("host <> '' AND html IS NOT NULL")
             .select(F.col("host").alias("src"), F.explode(F.transform(
                 F.regexp_extract_all("html", F.lit(LINK), F.lit(1)),
                 lambda h: F.translate(h, UPPER, LOWER))).alias("dst")))
    above = (pages.select("host").distinct()
             .select(F.col("host").alias("src"),
                     F.expr("substring(host, instr(host, '.') + 1)").alias("dst"))
             .filter("instr(dst, '.') > 0"))
    both = above.unionByName(above.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (links.unionByName(both).filter("src <> dst")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING,
              tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) of every host that either reaches.

    `seeds`: (kind, host, seed), kind `trust` or `distrust`. Both walks are one table, so a
    step is one join. A walk restarts with probability 1 - damping, and from hosts without
    links always. These restarts only scale a walk, so they are left out of the steps, and
    each walk is divided by its sum at the end: both have one scale. The number of steps
    follows from the tolerance: what is missing after k steps is at most damping^k.
    """
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"),
                     F.col("src").alias("dst"), "weight"))
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("all_"))
    edges = cut_lineage(edges.join(total, ["kind", "src"]).select(
        "kind", "src", "dst", (F.col("weight") / F.col("all_")).alias("share")))
    whole = seeds.groupBy("kind").agg(F.sum("seed").alias("all_"))
    start = cut_lineage(seeds.join(whole, "kind").filter("seed > 0").select(
        "kind", "host", (F.col("seed") / F.col("all_") * (1 - damping)).alias("rank")))
    ranks = start
    for step in range(1, math.ceil(math.log(tolerance) / math.log(damping)) + 1):
        moved = (ranks.withColumnRenamed("host", "src").join(edges, ["kind", "src"])
                 .groupBy("kind", "dst").agg((F.sum(F.col("rank") * F.col("share")) * damping)
                                             .alias("rank"))
                 .withColumnRenamed("dst", "host"))
        ranks = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT_EVERY == 0:
            ranks = cut_lineage(ranks)
    sums = ranks.groupBy("kind").agg(F.sum("rank").alias("all_"))  # two rows
    ranks = ranks.join(sums, "kind").withColumn("rank", F.col("rank") / F.col("all_"))
    value = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return ranks.groupBy("host").agg(value("trust").alias("trust"),
                                     value("distrust").alias("distrust"))


def judge(pages: DataFrame, rules: DataFrame, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    A rule fits if the host is its host or below it and the path starts with its path; of
    several the longest counts, then the first in order. Pages without a rule get their
    host's verdict: block if distrust > ratio x trust, else allow, also where both are equal,
    for hosts that neither walk reaches and for urls without a host. Null markup has no links, repeated
    rows are each judged, other columns are not read, empty tables give no rows.
    """
    parts = url_parts(pages.select("page_id", "url", "html"))
    hosts = parts.select("host").distinct()
    ruled = cut_lineage(hosts.join(host_rules(hosts, rules), "host", "left"))
    rule = F.expr("get(filter(rules, r -> startswith(path, r.start)), 0)")
    plain = (parts.select("page_id", "host", "path").join(ruled, "host")
             .withColumn("found", rule)
             .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                     F.col("found.verdict").alias("said")))
    shares = (plain.filter("said IS NOT NULL").groupBy("host", "said")
              .agg(F.count(F.lit(1)).alias("n")))
    of_host = shares.groupBy("host").agg(F.sum("n").alias("all_"))
    seeds = (shares.join(of_host, "host").select(
        F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host",
        (F.col("n") / F.col("all_")).alias("seed")))
    ranks = cut_lineage(propagate(host_links(parts), seeds))
    known = ruled.join(ranks, "host", "left").select(
        "host", "rules", F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    return (parts.select("page_id", "host", "path").join(known, "host")
            .withColumn("found", rule)
            .select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                    F.coalesce(F.col("found.verdict"), F.when(
                        F.col("distrust") > ratio * (1 + TIE) * F.col("trust"), "block")
                        .otherwise("allow")).alias("verdict"), "trust", "distrust"))


# The same over the rules above. The rank after k steps is the sum of k + 1 terms, each of
# which is the one before moved along the links, so a recursion over the terms suffices.
JUDGE_SQL = f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS rid, page_id, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
u AS (
  SELECT rid, page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM p),
rules(rule, said) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in RULES)}),
fit AS (
  SELECT rid, rule, said FROM u JOIN rules
  ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
     AND starts_with(path, substr(rule, instr(rule, '/')))
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rule) DESC, rule) = 1),
above AS (
  SELECT src, dst FROM (SELECT DISTINCT host AS src, substr(host, instr(host, '.') + 1) AS dst FROM u)
  WHERE instr(dst, '.') > 0),
links AS (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)),
                                  '{UPPER}', '{LOWER}') AS dst FROM u WHERE host <> ''
    UNION ALL SELECT src, dst FROM above UNION ALL SELECT dst, src FROM above)
  WHERE src <> dst GROUP BY ALL),
edges AS (
  SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share
  FROM (SELECT 'trust' AS kind, src, dst, weight FROM links
        UNION ALL SELECT 'distrust', dst, src, weight FROM links)),
seeds AS (
  SELECT CASE WHEN said = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host,
         count(*) / sum(count(*)) OVER (PARTITION BY host) AS seed
  FROM u JOIN fit USING (rid) GROUP BY host, said),
start AS (SELECT kind, host, seed / sum(seed) OVER (PARTITION BY kind) AS rank FROM seeds),
walk AS (
  SELECT 0 AS step, kind, host, rank FROM start
  UNION ALL
  SELECT step + 1, walk.kind, dst, sum(rank * share) * {DAMPING} FROM walk JOIN edges
  ON walk.kind = edges.kind AND host = src
  WHERE step < {math.ceil(math.log(TOLERANCE) / math.log(DAMPING))} GROUP BY step, walk.kind, dst),
ranks AS (
  SELECT kind, host, sum(rank) / sum(sum(rank)) OVER (PARTITION BY kind) AS rank
  FROM walk GROUP BY kind, host),
of_host AS (
  SELECT host, sum(rank) FILTER (kind = 'trust') AS trust, sum(rank) FILTER (kind = 'distrust') AS distrust
  FROM ranks GROUP BY host),
known AS (
  SELECT u.*, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM u LEFT JOIN of_host USING (host))
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN distrust > {RATIO * (1 + TIE)!r} * trust THEN 'block' ELSE 'allow' END) AS verdict,
       round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM known LEFT JOIN fit USING (rid)
"""
