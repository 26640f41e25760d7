"""Judge urls by rules, and those without a rule by the reputation of their host.

A host's rate of bad pages is shrunk towards that of its registered domain, the
domain's towards its suffix, and the suffix's towards all: each level has a beta
prior whose mean is the posterior of the level above and whose weight comes from
how far the groups of that level differ (moments of the beta-binomial). A page is
blocked if even the lower bound of its host's rate is high. DataFrame functions
throughout; everything but the last join is on one row per host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.line_runs import LOWER, UPPER
from plumbline.llm.tables import stash

# (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels under which names are registered.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
BAD_RATE = 0.5
# Standard deviations from the posterior mean to its lower bound.
BOUND = 1.645


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits; NULL if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        this = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        found = F.when(fits, this).otherwise(found)
    return found


def host_parts(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the suffix is the last label, or two of LONG_SUFFIXES."""
    long = F.substring_index(host, ".", -2).isin(*LONG_SUFFIXES)
    suffix = F.when(long, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return domain, suffix


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad_mean, bad_low) from ``outcomes`` (host, n, bad): pages labelled, and how many were bad.

    Hosts without labelled pages (n = 0) take their domain's posterior.
    """
    domain, suffix = host_parts(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))

    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    # One labelled good and one bad page more, so that an unlabelled table has a rate too.
    suffixes = _shrunk(suffixes.withColumn("prior", F.lit(((bad or 0) + 1) / ((n or 0) + 2))))
    above = suffixes.select("suffix", F.col("mean").alias("prior"))
    domains = _shrunk(domains.join(above, "suffix"))
    above = domains.select("suffix", "domain", F.col("mean").alias("prior"))
    hosts = _shrunk(hosts.join(above, ["suffix", "domain"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    return hosts.select("host", F.col("mean").alias("bad_mean"), (F.col("mean") - BOUND * spread).alias("bad_low"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """Add ``weight`` and ``mean`` to (..., n, bad, prior).

    With m = E[bad] / E[n] and q = E[bad (bad - 1)] / E[n (n - 1)], a beta-binomial
    has weight (m - q) / (q - m²). Groups that do not differ at all give a large
    weight, single pages none: it is kept between 1 and 1000.
    """
    sums = groups.select(F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad")).agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"),
        F.sum(F.col("bad") * (F.col("bad") - 1)).alias("bad_pairs"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"),
    ).first()
    weight = 1000.0
    if sums.n and sums.pairs:
        m, q = sums.bad / sums.n, sums.bad_pairs / sums.pairs
        if q > m * m:
            weight = min(max((m - q) / (q - m * m), 1.0), 1000.0)
    mean = (F.col("bad") + F.lit(weight) * F.col("prior")) / (F.col("n") + F.lit(weight))
    return groups.withColumn("weight", F.lit(weight)).withColumn("mean", mean)


def judge_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    bad_col: str | None = None,
) -> DataFrame:
    """(id, host, path, rule, verdict, bad_mean, bad_low) for every page.

    Labelled pages, from which hosts get their reputation, are those a rule
    judges (block is bad), or, where ``bad_col`` is named, those in which this
    boolean is not NULL. A NULL url or one without ``://`` has an empty host,
    which is a group like any other. Repeated rows count each.
    """
    url = F.col(url_col).cast("string")
    parts = pages.select(
        F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"),
        (F.col(bad_col) if bad_col else F.lit(None).cast("boolean")).alias("given"),
    )
    judged = parts.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules))
    bad = F.col("given") if bad_col else F.col("hit.verdict") == "block"
    outcomes = judged.groupBy("host").agg(
        F.count(bad).alias("n"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("bad")
    )
    known = reputation(stash(outcomes, "hosts"))
    by_host = F.when(F.col("bad_low") >= BAD_RATE, "block").otherwise("allow")
    return judged.join(known, "host").select(
        "id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", by_host).alias("verdict"), "bad_mean", "bad_low",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = judge_urls(pages)
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("bad_mean", 6).alias("bad_mean"))


def _level(name: str, counts: str, keys: str, prior: str) -> str:
    return f"""
{name}_w AS (
  SELECT CASE WHEN m IS NULL OR q IS NULL OR q <= m * m THEN 1000.0
         ELSE least(greatest((m - q) / (q - m * m), 1.0), 1000.0) END AS weight
  FROM (SELECT sum(bad) / nullif(sum(n), 0) AS m, sum(bad * (bad - 1)) / nullif(sum(n * (n - 1)), 0) AS q
        FROM (SELECT n::DOUBLE AS n, bad::DOUBLE AS bad FROM {counts}))),
{name} AS (
  SELECT c.*, w.weight, (c.bad + w.weight * p.prior) / (c.n + w.weight) AS mean
  FROM {counts} c, {name}_w w, ({prior}) p WHERE {keys})"""


OP7_SQL = f"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
ruled AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS given
  FROM judged),
labels_of AS (SELECT host, string_split(host, '.') AS l FROM (SELECT DISTINCT host FROM ruled)),
host_n AS (
  SELECT r.host, array_to_string(l[-2:], '.') AS domain, l[-1] AS suffix,
    count(given) AS n, count(*) FILTER (WHERE given = 'block') AS bad
  FROM ruled r JOIN labels_of USING (host) GROUP BY ALL),
domain_n AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM host_n GROUP BY ALL),
suffix_n AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domain_n GROUP BY ALL),
{_level("suffixes", "suffix_n", "true", "SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS prior FROM suffix_n")},
{_level("domains", "domain_n", "c.suffix = p.suffix", "SELECT suffix, mean AS prior FROM suffixes")},
{_level("hosts", "host_n", "c.suffix = p.suffix AND c.domain = p.domain", "SELECT suffix, domain, mean AS prior FROM domains")}
SELECT page_id, host, path, rule, round(mean, 6) AS bad_mean,
  coalesce(given, CASE WHEN mean - {BOUND} * sqrt(mean * (1 - mean) / (hosts.n + weight + 1)) >= {BAD_RATE}
    THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN hosts USING (host)
"""
