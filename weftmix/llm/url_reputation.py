"""URL filters: empirical-Bayes host reputation.

Rules (host, path prefix, verdict) decide the pages they fit; those decisions
are the labelled outcomes. Every other page is judged by its host: counts of
allowed and blocked pages are shrunk through beta-binomial priors from the
whole table to the public suffix, from there to the registered domain and
from there to the host. The strength of each level's prior comes from the
over-dispersion of the counts around the parent mean (method of moments). A
page is blocked when even the upper posterior bound of its host's share of
allowed pages stays under ``min_rate``; a host of which little is known keeps
a wide bound and passes.

Defined results: a null url, or one without ``://``, has an empty host and
path and is judged by the table-wide prior; repeated rows count as often as
they stand there; without any rule-labelled page the prior is 1/2 and
everything passes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.llm.common import UPPER, ascii_lower, cut, table

#: (host, path prefix, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Public suffixes of two labels; any other host's suffix is its last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
Z = 1.64
MIN_RATE = 0.5
LEAST_RHO, MOST_RHO = 0.001, 0.999


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def by_length(rules) -> list:
    """Longest rule first, so the first that fits wins."""
    return sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))


def rule_columns(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null when none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in reversed(by_length(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """(public suffix, registered domain): the suffix and one label before it."""
    two = F.substring_index(host, ".", -2)
    wide = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(wide, two).otherwise(F.substring_index(host, ".", -1))
    domain = F.when(wide, F.substring_index(host, ".", -3)).otherwise(two)
    return suffix, domain


def _strength(units: DataFrame) -> float:
    """Prior strength of a level from its units' counts (n, k) and parent mean m."""
    m = F.col("m")
    got = units.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * m, 2) - F.col("n") * m * (1 - m)).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("base")).first()
    rho = got["over"] / got["base"] if got["base"] else MOST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return 1.0 / rho - 1.0


def _mean(strength: float) -> Column:
    return (F.lit(strength) * F.col("m") + F.col("k")) / (F.lit(strength) + F.col("n"))


def host_reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """(host, n, k, mean, low, high) from outcomes (host, y): y 1 allowed, 0
    blocked, null unlabelled. Only three pairs of sums reach the driver."""
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = cut(outcomes.groupBy("host").agg(F.count("y").alias("n"),
                                             F.coalesce(F.sum("y"), F.lit(0)).alias("k"))
                .select("host", suffix.alias("suffix"), domain.alias("domain"), "n", "k"))
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    root = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = ((root["k"] or 0) + 1.0) / ((root["n"] or 0) + 2.0)

    suffixes = suffixes.withColumn("m", F.lit(p0))
    s1 = _strength(suffixes)
    domains = domains.join(suffixes.select("suffix", _mean(s1).alias("m")), "suffix")
    s2 = _strength(domains)
    hosts = hosts.join(domains.select("domain", "suffix", _mean(s2).alias("m")), ["suffix", "domain"])
    s3 = _strength(hosts)
    a = F.lit(s3) * F.col("m") + F.col("k")
    b = F.lit(s3) * (1 - F.col("m")) + F.col("n") - F.col("k")
    sd = F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return cut(hosts.select("host", "n", "k", (a / (a + b)).alias("mean"),
                            (a / (a + b) - z * sd).alias("low"), (a / (a + b) + z * sd).alias("high")))


def judge_urls(pages: DataFrame, rules=RULES, z: float = Z, min_rate: float = MIN_RATE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and the host's
    posterior (mean, low, high). A hot host's pages meet one reputation row;
    both sides of that join come straight from a scan or a checkpoint, so AQE
    can split it."""
    host, path = url_parts(F.col("url"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = (pages.select("page_id", host.alias("host"), path.alias("path"))
              .select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule")))
    y = F.when(F.col("by_rule") == "allow", 1).when(F.col("by_rule") == "block", 0)
    rep = host_reputation(judged.select("host", y.alias("y")), z)
    return judged.join(rep, "host").select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(F.col("high") < min_rate, "block").otherwise("allow")).alias("verdict"),
        "mean", "low", "high")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    def fits(h, p):
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    order = by_length(RULES)
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    wide = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

    def strength(t):
        return (f"(SELECT 1 / least({MOST_RHO}, greatest({LEAST_RHO}, coalesce(sum((k - n * m) * (k - n * m) - n * m * (1 - m))"
                f" / nullif(sum(n * (n - 1) * m * (1 - m)), 0), {MOST_RHO}))) - 1 AS s FROM {t})")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{UPPER.lower()}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM p),
h0 AS (SELECT host, string_split(host, '.') AS parts, count(by_rule) AS n,
              count(*) FILTER (by_rule = 'allow') AS k FROM j GROUP BY host),
h1 AS (SELECT host, n, k, parts, array_to_string(parts[-2:], '.') AS two FROM h0),
h AS (SELECT host, n, k, CASE WHEN two IN ({wide}) THEN two ELSE parts[-1] END AS suffix,
             CASE WHEN two IN ({wide}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain FROM h1),
d AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s AS (SELECT *, ((SELECT sum(k) FROM s0) + 1.0::DOUBLE) / ((SELECT sum(n) FROM s0) + 2.0::DOUBLE) AS m FROM s0),
s1 AS {strength('s')},
d1 AS (SELECT d.*, (s1.s * s.m + s.k) / (s1.s + s.n) AS m FROM d JOIN s USING (suffix), s1),
s2 AS {strength('d1')},
h2 AS (SELECT h.*, (s2.s * d1.m + d1.k) / (s2.s + d1.n) AS m FROM h JOIN d1 USING (suffix, domain), s2),
s3 AS {strength('h2')},
ab AS (SELECT host, s3.s * m + k AS a, s3.s * (1 - m) + n - k AS b FROM h2, s3),
rep AS (SELECT host, a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS high FROM ab)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN high < {MIN_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN rep USING (host)"""


SQL = _sql()
