"""Host reputation by empirical Bayes: labelled page outcomes shrunk from host to registered domain to suffix.

A page with a label is good or bad. At each level the bad rate of a node is beta-binomial: its prior has the mean of
the node above it and a strength estimated from the spread of the level's own counts (moments). The posterior of a
host gives the verdict: a page is blocked where even the lower bound of its host's bad rate is above the limit.
Listed rules (host, path) go before the reputation; the longest that fits wins.

Defined cases: a null address or one without ``://`` has empty host and path and the reputation of the empty host;
several labels of one page count once, as bad if one is; pages without label still count as pages of their host; no
labels at all give the neutral rate 0.5 with strength 2; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costweave.llm.common import table
from costweave.llm.registry import query

#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Blocked above this bad rate, judged at the lower end of the posterior, so many standard deviations below its mean.
BAD_LIMIT = 0.25
BOUND_SD = 1.645
#: Strength of a prior where the counts do not show one, and its limits.
STRENGTH, LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1.0, 1000.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: from there up to ``?``, ``#``, the end."""
    found = F.locate("://", url) > 0
    rest = F.substring_index(url, "://", 1)
    after = url.substr(F.length(rest) + 4, F.length(url))
    bare = F.regexp_extract(after, r"^([^?#]*)", 1)
    host = F.translate(F.regexp_extract(bare, r"^([^/]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(bare, r"^[^/]*(.*)$", 1)
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. A rule fits its host and the hosts below it."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for at, start, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):  # later ones win
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def shrink_level(nodes: DataFrame, level: str, above: str | None) -> DataFrame:
    """(level, above, n, bad) with the parent's posterior mean to the posterior mean and strength of each node.

    The strength s of the level's prior follows from the counts: with expected variance m (1 - m) / n inside a node,
    the surplus of the squared distances from m measures the spread v between nodes, and s = m (1 - m) / v - 1.
    """
    inside = F.col("__m") * (1 - F.col("__m"))
    spread = nodes.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("__m"), F.lit(2.0)) - inside).alias("__over"),
        F.sum((F.col("n") - 1) * inside).alias("__room"),
    )
    rho = F.try_divide(F.col("__over"), F.col("__room"))
    strength = F.when(rho > 0, F.try_divide(F.lit(1.0), rho) - 1.0).otherwise(F.lit(MOST_STRENGTH))
    fitted = spread.select(
        F.least(
            F.lit(MOST_STRENGTH),
            F.greatest(F.lit(LEAST_STRENGTH), F.when(F.col("__room") > 0, strength).otherwise(F.lit(STRENGTH))),
        )
    ).scalar()
    mean = (F.col("bad") + F.col("__s") * F.col("__m")) / (F.col("n") + F.col("__s"))
    keys = [level] + ([above] if above else [])
    return nodes.withColumn("__s", fitted).select(*keys, "n", "bad", "__s", mean.alias("mean"))


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad 0/1 or null) rows to one row per host: n, bad, posterior mean, standard deviation, lower bound.

    Rows meet as counts per host, combined inside the tasks; registered domain and suffix are sums of hosts. The last
    label of a host is its suffix, the last two its registered domain.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2)).withColumn(
        "suffix", F.substring_index("host", ".", -1)
    )
    bad, n = F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    root = hosts.agg((bad + STRENGTH / 2) / (n + STRENGTH)).scalar()
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = shrink_level(hosts.groupBy("suffix").agg(*sums).withColumn("__m", root), "suffix", None)
    above = suffixes.select("suffix", F.col("mean").alias("__m"))
    domains = shrink_level(hosts.groupBy("domain", "suffix").agg(*sums).join(above, "suffix"), "domain", "suffix")
    above = domains.select("domain", F.col("mean").alias("__m"))
    judged = shrink_level(hosts.join(above, "domain"), "host", "domain")
    total = F.col("n") + F.col("__s")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    return judged.select(
        "host", "n", "bad", "mean", F.greatest(F.lit(0.0), F.col("mean") - F.lit(BOUND_SD) * deviation).alias("lower")
    )


def judge_pages(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, url) and (page_id, bad) to host, path, rule, verdict and the host's bound, one row per page."""
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    once = labels.where("page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").cast("long").alias("bad"))
    reputation = host_reputation(split.join(once, "page_id", "left").select("host", "bad"))
    rule, listed = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") > BAD_LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(reputation.select("host", "lower"), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(listed, own).alias("verdict"), "lower"
    )


def sql_level(name: str, source: str, keys: str) -> str:
    return f"""
{name}_s AS (
  SELECT least({MOST_STRENGTH}e0, greatest({LEAST_STRENGTH}e0, CASE WHEN room > 0 THEN
    CASE WHEN over / room > 0 THEN 1e0 / (over / room) - 1e0 ELSE {MOST_STRENGTH}e0 END ELSE {STRENGTH}e0 END)) AS s
  FROM (SELECT sum(n * pow(bad / n - m, 2e0) - m * (1 - m)) FILTER (n > 0) AS over,
    sum((n - 1) * m * (1 - m)) FILTER (n > 0) AS room FROM {source})),
{name} AS (SELECT {keys}, n, bad, s, (bad + s * m) / (n + s) AS mean FROM {source}, {name}_s)"""


SQL_URLS = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN
    regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS bare FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(bare, ''), '^([^/]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(bare, ''), '^[^/]*(.*)$', 1) AS path FROM cut),
once AS (
  SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
hosts AS (
  SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS bad
  FROM split LEFT JOIN once USING (page_id) GROUP BY host),
root AS (SELECT (coalesce(sum(bad), 0) + {STRENGTH / 2}e0) / (coalesce(sum(n), 0) + {STRENGTH}e0) AS m FROM hosts),
suffix_m AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, m FROM hosts, root GROUP BY suffix, m),
{sql_level('suffixes', 'suffix_m', 'suffix')},
domain_m AS (
  SELECT domain, suffix, sum(hosts.n) AS n, sum(hosts.bad) AS bad, any_value(mean) AS m
  FROM hosts JOIN suffixes USING (suffix) GROUP BY domain, suffix),
{sql_level('domains', 'domain_m', 'domain')},
host_m AS (SELECT host, hosts.n, hosts.bad, mean AS m FROM hosts JOIN domains USING (domain)),
{sql_level('judged', 'host_m', 'host')},
bound AS (SELECT host, greatest(0e0, mean - {BOUND_SD}e0 * sqrt(mean * (1 - mean) / (n + s + 1))) AS lower FROM judged),
ruled AS (
  SELECT page_id, host, path, lower, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM split JOIN bound USING (host))
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN lower > {BAD_LIMIT}e0 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query("op8_url_filter", SQL_URLS)
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged; a labelled page is bad if toxic or of no quality."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").where(
        "toxic IS NOT NULL OR quality IS NOT NULL"
    )
    labels = labels.select(F.col("doc_id").alias("page_id"), bad.cast("long").alias("bad"))
    return judge_pages(pages, labels).drop("lower")
