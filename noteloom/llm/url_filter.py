"""URL verdicts from fixed rules and, where none fits, host reputation.

Reputation is empirical Bayes over labelled pages: the good share of a host is
shrunk towards its registered domain, that towards its suffix, and that towards
all pages. At each level the strength of the beta prior comes from the spread
of the children's shares (method of moments). A url is allowed when the lower
bound of its host's posterior reaches LEAST. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import joined_by_key, table, written

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
Z = 1.0
LEAST = 0.5
TWO_PART = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)).otherwise("")
    path = F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null for none."""
    found = None
    for verdict, r_host, r_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        hit = F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit) if found is None else found.when(fits, hit)
    return found


def _places(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    parts = F.split(host, r"\.")
    two = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), ".")
    long = two.isin(*TWO_PART)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.element_at(parts, -1))


def _strength(level: DataFrame) -> float:
    """The prior's strength from children (n, g) around the means of their
    parents (mean). With S1 = sum of n and S2 = sum of n(n - 1), moments give
    the correlation rho of two outcomes of a child, and the strength 1/rho - 1,
    held to [1, 1000]; 10 where no child has two labelled pages."""
    v = F.col("mean") * (1 - F.col("mean"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) * v)
    d = F.col("g") - F.col("n") * F.col("mean")
    excess = F.sum(d * d - F.col("n") * v)
    rho = F.least(F.greatest(F.round(excess / pairs, 6), F.lit(0.000999)), F.lit(0.5))
    return level.where("n > 0").agg(F.coalesce(F.when(pairs > 0, F.round(1 / rho - 1, 4)), F.lit(10.0)).alias("s")).first()["s"]


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, pages, n, posterior mean and lower bound of every host in pages.

    pages: host, page_id. labels: page_id, good (0/1; null: unlabelled). A page
    labelled several times counts each time. The hosts are written once; of each
    level only the strength of its prior, one number, comes to the driver.
    """
    marks = labels.where("page_id is not null and good is not null").select(F.col("page_id").alias("k"), F.col("good").cast("long").alias("good"))
    marks = marks.groupBy("k").agg(F.count("*").alias("n"), F.sum("good").alias("g"))
    domain, suffix = _places(F.col("host"))
    none = F.lit(0)
    grouped = pages.join(marks, F.col("page_id") == F.col("k"), "left").groupBy("host").agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), none).alias("n"), F.coalesce(F.sum("g"), none).alias("g"))
    hosts = written(grouped.select("host", domain.alias("domain"), suffix.alias("suffix"), "pages", "n", "g"), "op4-hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.count("*").alias("hosts")), "op4-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.count("*").alias("domains"), F.sum("hosts").alias("hosts"))
    suffixes = written(suffixes, "op4-suffixes")
    top = suffixes.agg(((F.coalesce(F.sum("g"), none) + 1) / (F.coalesce(F.sum("n"), none) + 2)).alias("mean"), F.sum("domains").alias("domains"), F.sum("hosts").alias("hosts")).first()

    def shrunk(level: DataFrame) -> DataFrame:
        s = F.lit(_strength(level))
        return level.withColumn("b", F.col("n") + s).withColumn("mean", F.round((F.col("g") + s * F.col("mean")) / F.col("b"), 9))

    by_suffix = shrunk(suffixes.withColumn("mean", F.lit(top["mean"]))).select(F.col("suffix").alias("ps"), "domains", "mean")
    level = written(joined_by_key(domains, "suffix", by_suffix, "ps", "domains", top["domains"] or 0).select("domain", "n", "g", "hosts", "mean"), "op4-domain-means")
    by_domain = shrunk(level).select(F.col("domain").alias("pd"), "hosts", "mean")
    level = written(joined_by_key(hosts, "domain", by_domain, "pd", "hosts", top["hosts"] or 0).select("host", "pages", "n", "g", "mean"), "op4-host-means")
    low = F.round(F.col("mean") - F.lit(Z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("b") + 1)), 6)
    return shrunk(level).select("host", "pages", "n", "mean", low.alias("low"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, low: one row for each input row.

    Null urls and urls without '://' have an empty host and path, match no rule
    and are judged like one host. Repeated rows are judged alike; a null page_id
    has no label; of rules of one length a block goes first. Without labels every
    host has the posterior of an even prior. An empty table gives an empty
    result. Only page_id and url, and of labels doc_id and quality, are read: a
    label is taken for that of the page whose page_id is its doc_id.
    """
    host, path = split_url(F.col("u"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("u")).select("page_id", host.alias("host"), path.alias("path"))
    marks = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.col("quality").alias("good"))
    known = written(reputation(base.select("page_id", "host"), marks).select(F.col("host").alias("h"), "pages", "low"), "op4-known")
    total = known.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    hit = match_rules(F.col("host"), F.col("path"), rules)
    learnt = F.when(F.col("low") >= LEAST, "allow").otherwise("block")
    return (
        joined_by_key(base, "host", known, "h", "pages", total)
        .withColumn("hit", hit)
        .select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), learnt).alias("verdict"), "low")
    )


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Verdicts for every page's url."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


OP4_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
base AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
parts AS (
  SELECT base.*, string_split(host, '.') AS p FROM base),
named AS (
  SELECT page_id, host, path, array_to_string(p[greatest(len(p) - 1, 1):], '.') AS two,
         array_to_string(p[greatest(len(p) - 2, 1):], '.') AS three, p[len(p)] AS one FROM parts),
placed AS (
  SELECT page_id, host, path,
         CASE WHEN two IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','co.jp','com.br','co.nz','co.in') THEN three ELSE two END AS domain,
         CASE WHEN two IN ('co.uk','org.uk','ac.uk','gov.uk','com.au','co.jp','com.br','co.nz','co.in') THEN two ELSE one END AS suffix FROM named),
hosts AS (
  SELECT host, domain, suffix, count(l.quality) AS n, coalesce(sum(CAST(l.quality AS BIGINT)), 0)::BIGINT AS g
  FROM placed LEFT JOIN labels l ON l.doc_id = placed.page_id GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(g)::BIGINT AS g FROM domains GROUP BY ALL),
suffix_in AS (
  SELECT suffix, n, g, ((SELECT coalesce(sum(g), 0) FROM suffixes) + 1)::DOUBLE / ((SELECT coalesce(sum(n), 0) FROM suffixes) + 2)::DOUBLE AS mean FROM suffixes),
s_top AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * (mean * (1 - mean))) > 0 THEN round(1 / least(greatest(round(
    sum((g - n * mean) * (g - n * mean) - n * (mean * (1 - mean))) / sum(n * (n - 1) * (mean * (1 - mean))), 6), 0.000999::DOUBLE), 0.5::DOUBLE) - 1, 4) END, 10.0::DOUBLE) AS s
  FROM suffix_in WHERE n > 0),
suffix_out AS (SELECT suffix, round((g + s * mean) / (n + s), 9) AS mean FROM suffix_in, s_top),
domain_in AS (SELECT d.domain, d.suffix, d.n, d.g, o.mean FROM domains d JOIN suffix_out o USING (suffix)),
s_suffix AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * (mean * (1 - mean))) > 0 THEN round(1 / least(greatest(round(
    sum((g - n * mean) * (g - n * mean) - n * (mean * (1 - mean))) / sum(n * (n - 1) * (mean * (1 - mean))), 6), 0.000999::DOUBLE), 0.5::DOUBLE) - 1, 4) END, 10.0::DOUBLE) AS s
  FROM domain_in WHERE n > 0),
domain_out AS (SELECT domain, round((g + s * mean) / (n + s), 9) AS mean FROM domain_in, s_suffix),
host_in AS (SELECT h.host, h.n, h.g, o.mean FROM hosts h JOIN domain_out o USING (domain)),
s_domain AS (SELECT coalesce(CASE WHEN sum(n * (n - 1) * (mean * (1 - mean))) > 0 THEN round(1 / least(greatest(round(
    sum((g - n * mean) * (g - n * mean) - n * (mean * (1 - mean))) / sum(n * (n - 1) * (mean * (1 - mean))), 6), 0.000999::DOUBLE), 0.5::DOUBLE) - 1, 4) END, 10.0::DOUBLE) AS s
  FROM host_in WHERE n > 0),
host_mean AS (SELECT host, n + s AS b, round((g + s * mean) / (n + s), 9) AS mean FROM host_in, s_domain),
host_out AS (SELECT host, round(mean - 1.0::DOUBLE * sqrt(mean * (1 - mean) / (b + 1)), 6) AS low FROM host_mean),
judged AS (
  SELECT page_id, b.host, path, low,
    CASE WHEN (b.host = 'example.org' OR ends_with(b.host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (b.host = 'example.org' OR ends_with(b.host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (b.host = 'com' OR ends_with(b.host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (b.host = 'com' OR ends_with(b.host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (b.host = 'org' OR ends_with(b.host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM base b LEFT JOIN host_out USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN low >= 0.5 THEN 'allow' ELSE 'block' END AS verdict, low
FROM judged
"""
