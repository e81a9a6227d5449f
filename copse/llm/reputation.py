"""URL filters: rules by host and path, then empirical-Bayes reputation of hosts.

Outcomes of labelled pages are counted by host. A host's share of good pages is shrunk towards that of its registered
domain, a domain's towards that of its suffix, and a suffix's towards the overall share, each through a beta-binomial
prior whose strength is estimated from how much the units of that level differ beyond chance. A host without labelled pages
has the distribution that its domain gives to hosts, else its suffix, else all of them. A host is blocked if the posterior
bound of its share lies below the limit. Built-in functions only.

The bound is the posterior mean and ``z`` posterior standard deviations (a normal approximation, kept within 0 and 1), as
Spark has no quantiles of the beta distribution.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import fresh, table, written


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, where the url's path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)

#: Suffixes of two labels that registered domains are cut by; any other suffix is the last label. A default for callers
#: that have no list of their own to pass.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz", "co.za", "com.cn")


@dataclass(frozen=True)
class Prior:
    """z: the bound lies so many standard deviations from the posterior mean. min_share: hosts that are surely below it go.
    strength: least and largest weight of a prior, in pages."""

    z: float = 1.645
    min_share: float = 0.5
    strength: tuple[float, float] = (2.0, 1000.0)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: The suffix that all addresses have, which are no names.
ADDRESS = "(address)"


def bare(name: Column) -> Column:
    """A host without user, port and closing dots: what reputation belongs to."""
    return F.regexp_extract(name, r"^(?:.*@)?(\[[^\]]*\]?|[^:]*?)\.*(?::.*)?$", 1)


def _is_address(name: Column) -> Column:
    return name.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")


def suffix(name: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), ADDRESS).when(two.isin(*long_suffixes), two).otherwise(F.substring_index(name, ".", -1))


def registered_domain(name: Column, long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> Column:
    """The label before the suffix and the suffix; the whole host where it has no more than that or is an address."""
    two = F.substring_index(name, ".", -2)
    return F.when(_is_address(name), name).when(two.isin(*long_suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def matching_rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none fits."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host_ == r.host) | host_.endswith("." + r.host)) & path_.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def reputations(outcomes: DataFrame, hosts: DataFrame | None = None, prior: Prior = Prior(), long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """One row for each host of ``outcomes`` (host string, good int), and of ``hosts`` if given: n_labelled, n_good, mean,
    lower and upper bound of the posterior, and level: host, domain, suffix or overall, the lowest that has labelled pages.

    Outcomes other than 0 and 1 (nulls too) are left out; empty and null hosts have no row. The counts by host are the only
    pass over the outcomes; they are combined before they are shuffled, so that a host with a third of all pages is one row
    from each task.
    The strength of a level's prior comes from the moments of its units: with shares p_i of n_i pages around the mean m
    of their parents, s = (m(1-m) - v) / v where v is the variance beyond chance, kept within the limits of ``prior``.
    A share that is a level below the one known has the variances of both levels: m(1-m) times 1/(s+1) of the lower one, or
    r = 1/(t+1) + t/(t+1) * that where the level above, of strength t, is unknown as well, and so on.
    """
    lo, hi = prior.strength
    named = lambda df: df.withColumn("host", bare(F.col("host"))).filter("host <> ''")
    placed = lambda df: df.withColumn("domain", registered_domain(F.col("host"), long_suffixes)).withColumn("suffix", suffix(F.col("host"), long_suffixes))
    by_host = named(outcomes).filter(F.col("good").isin(0, 1)).groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("good").cast("double").alias("k"))
    by_host = written(placed(by_host), "outcomes_by_host")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    overall = by_suffix.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).select(((F.col("k") + 1) / (F.col("n") + 2)).alias("m")).first()
    m0 = overall["m"]  # null without any outcome: then nothing is known of any host

    def shrunk(level: DataFrame, m: Column) -> tuple[DataFrame, float]:
        """level: n, k, columns of its own; adds mean, the posterior's, and weight, its pages and the prior's strength."""
        extra = (F.col("k") / F.col("n") - m) ** 2 - m * (1 - m) / F.col("n")  # unbiased for the variance beyond chance
        row = level.agg(F.sum(F.col("n") * extra).alias("v"), F.sum(F.col("n") * m * (1 - m)).alias("c"), F.sum("n").alias("n")).first()
        s = hi
        if row["n"] and row["v"] > 0:
            v, c = row["v"] / row["n"], row["c"] / row["n"]
            s = min(hi, max(lo, (c - v) / v))
        return level.withColumn("mean", (F.col("k") + s * m) / (F.col("n") + s)).withColumn("weight", F.col("n") + s), s

    suffixes, s_suffix = shrunk(by_suffix, F.lit(m0).cast("double"))
    suffixes = written(suffixes.select("suffix", F.col("mean").alias("suffix_mean")), "suffixes")
    domains, s_domain = shrunk(by_domain.join(suffixes, "suffix"), F.col("suffix_mean"))
    domains = written(domains.select("domain", F.col("mean").alias("domain_mean")), "domains")
    known, s_host = shrunk(by_host.join(domains, "domain"), F.col("domain_mean"))
    of_host = 1 / (s_host + 1)
    of_domain = 1 / (s_domain + 1) + s_domain / (s_domain + 1) * of_host
    of_suffix = 1 / (s_suffix + 1) + s_suffix / (s_suffix + 1) * of_domain
    every = known.select("host")
    if hosts is not None:
        every = every.union(named(hosts.select("host"))).distinct()
    every = placed(every).join(known.select("host", "n", "k", F.col("mean").alias("host_mean"), "weight"), "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    steps = (("host", "host_mean", 1 / (F.col("weight") + 1)), ("domain", "domain_mean", F.lit(of_host)), ("suffix", "suffix_mean", F.lit(of_domain)))
    pick = lambda value, last: F.coalesce(*[F.when(F.col(x[1]).isNotNull(), value(x)) for x in steps], last)
    out = every.withColumns({"mean": pick(lambda x: F.col(x[1]), F.lit(m0).cast("double")), "spread": pick(lambda x: x[2], F.lit(of_suffix)), "level": pick(lambda x: F.lit(x[0]), F.lit("overall"))})
    off = prior.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) * F.col("spread"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.filter("mean is not null").select(
        "host", whole("n").alias("n_labelled"), whole("k").alias("n_good"), "mean", F.greatest(F.lit(0.0), F.col("mean") - off).alias("lower"), F.least(F.lit(1.0), F.col("mean") + off).alias("upper"), "level",
    )


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, prior: Prior = Prior(), url: str = "url", long_suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """Add host, path, rule, verdict, reputation and reputation_upper to every row of ``pages``.

    A rule's verdict holds; elsewhere a host is blocked if the upper posterior bound of its share of good pages is below
    ``prior.min_share``, whether it has labelled pages itself or not. Urls that are null or have no ``://`` (host and path
    empty), and all where there is no outcome at all, have no reputation and are allowed. Repeated rows are judged alike.
    Columns of ``pages`` whose names clash with the new ones give way to them. ``outcomes`` has one row for each labelled
    page: host and good. Each distinct host is judged once; pages meet it in one join.
    """
    made = ("host", "path", "rule", "verdict", "reputation", "reputation_upper")
    kept = [c for c in pages.columns if c.lower() not in made]
    hidden, r = fresh([*pages.columns, *made], "host_of_reputation", "fit")
    hosts = pages.select(host(F.col(f"`{url}`")).alias("host")).distinct()
    known = written(reputations(outcomes, hosts, prior, long_suffixes), "reputations").select(F.col("host").alias(hidden), F.col("mean").alias("reputation"), F.col("upper").alias("reputation_upper"))
    out = pages.select(*[F.col(f"`{c}`") for c in kept], host(F.col(f"`{url}`")).alias("host"), path(F.col(f"`{url}`")).alias("path"))
    out = out.join(known, bare(F.col("host")) == F.col(hidden), "left").drop(hidden)
    out = out.withColumn(r, matching_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("reputation_upper") < prior.min_share, "block").otherwise("allow")
    return out.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col(f"{r}.text").alias("rule"),
        F.coalesce(F.col(f"{r}.verdict"), method).alias("verdict"), "reputation", "reputation_upper",
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host and good of every page whose url names a labelled document: the digits after the language in its path."""
    at = F.regexp_extract(path(F.col("url")), r"^/[^/]*/([0-9]{1,18})", 1)
    of = pages.select(host(F.col("url")).alias("host"), F.when(at != "", at).cast("long").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    return of.join(labels.select("doc_id", F.col("quality").alias("good")), "doc_id").select("host", "good")


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by RULES and by the labelled outcomes of its host."""
    pages = table(spark, sf_dir, "pages")
    out = judged(pages.select("page_id", "url"), page_outcomes(pages, table(spark, sf_dir, "labels")))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("reputation", 6).alias("reputation"), F.round("reputation_upper", 6).alias("reputation_upper"))


OP2_SQL = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                          ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fit AS (SELECT page_id, max_by(h || r.p, length(h || r.p)) AS rule, max_by(v, length(h || r.p)) AS rule_verdict
        FROM p JOIN rules r ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, r.p) GROUP BY page_id),
b AS (SELECT page_id, path, regexp_extract(host, '^(?:.*@)?(\[[^\]]*\]?|[^:]*?)\.*(?::.*)?$', 1) AS host FROM p),
o AS (SELECT host, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k
      FROM (SELECT host, try_cast(regexp_extract(path, '^/[^/]*/([0-9]{1,18})', 1) AS BIGINT) AS doc_id FROM b) JOIN labels USING (doc_id)
      WHERE quality IN (0, 1) AND host <> '' GROUP BY host),
hs AS (SELECT *, CASE WHEN ip THEN host WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
              CASE WHEN ip THEN '(address)' WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix
       FROM (SELECT DISTINCT host, string_split(host, '.') AS l, regexp_matches(host, '^([0-9]+(\.[0-9]+){3}|\[.*)$') AS ip,
                    array_to_string(string_split(host, '.')[-2:], '.') IN
                    ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.in', 'co.nz', 'co.za', 'com.cn') AS long FROM b WHERE host <> '')),
h AS (SELECT o.*, domain, suffix FROM o JOIN hs USING (host)),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
a AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM s),
s1 AS (SELECT suffix, n, k, m FROM s, a),
s2 AS (SELECT sum(n * ((k / n - m) ** 2 - m * (1 - m) / n)) / sum(n) AS v, sum(n * m * (1 - m)) / sum(n) AS c FROM s1),
s3 AS (SELECT suffix, (k + w * m) / (n + w) AS mean FROM s1, (SELECT CASE WHEN v > 0 THEN least(1000, greatest(2, (c - v) / v)) ELSE 1000 END AS w FROM s2)),
d1 AS (SELECT domain, n, k, mean AS m FROM d JOIN s3 USING (suffix)),
d2 AS (SELECT sum(n * ((k / n - m) ** 2 - m * (1 - m) / n)) / sum(n) AS v, sum(n * m * (1 - m)) / sum(n) AS c FROM d1),
d3 AS (SELECT domain, (k + w * m) / (n + w) AS mean FROM d1, (SELECT CASE WHEN v > 0 THEN least(1000, greatest(2, (c - v) / v)) ELSE 1000 END AS w FROM d2)),
h1 AS (SELECT host, n, k, mean AS m FROM h JOIN d3 USING (domain)),
h2 AS (SELECT sum(n * ((k / n - m) ** 2 - m * (1 - m) / n)) / sum(n) AS v, sum(n * m * (1 - m)) / sum(n) AS c FROM h1),
wt AS (SELECT s2.*, d2.v AS dv, d2.c AS dc, h2.v AS hv, h2.c AS hc FROM s2, d2, h2),
w AS (SELECT CASE WHEN v > 0 THEN least(1000, greatest(2, (c - v) / v)) ELSE 1000 END AS ws,
             CASE WHEN dv > 0 THEN least(1000, greatest(2, (dc - dv) / dv)) ELSE 1000 END AS wd,
             CASE WHEN hv > 0 THEN least(1000, greatest(2, (hc - hv) / hv)) ELSE 1000 END AS wh FROM wt),
h3 AS (SELECT host, (k + wh * m) / (n + wh) AS mean, 1 / (n + wh + 1) AS spread FROM h1, w),
r0 AS (SELECT hs.host, coalesce(h3.mean, d3.mean, s3.mean, a.m) AS mean,
              CASE WHEN h3.mean IS NOT NULL THEN h3.spread WHEN d3.mean IS NOT NULL THEN 1 / (wh + 1)
                   WHEN s3.mean IS NOT NULL THEN 1 / (wd + 1) + wd / (wd + 1) / (wh + 1)
                   ELSE 1 / (ws + 1) + ws / (ws + 1) * (1 / (wd + 1) + wd / (wd + 1) / (wh + 1)) END AS spread
       FROM hs LEFT JOIN h3 USING (host) LEFT JOIN d3 USING (domain) LEFT JOIN s3 USING (suffix), a, w),
r AS (SELECT host, mean, least(1.0, mean + 1.645 * sqrt(mean * (1 - mean) * spread)) AS upper FROM r0 WHERE mean IS NOT NULL)
SELECT p.page_id, p.host, p.path, rule, coalesce(rule_verdict, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS reputation, round(upper, 6) AS reputation_upper
FROM p JOIN b USING (page_id) LEFT JOIN fit USING (page_id) LEFT JOIN r ON r.host = b.host
"""
