"""Host reputation by empirical Bayes, and url rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.tables import ascii_lower

#: Suffixes of two labels, unless the caller gives a table; every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LEVELS = ("suffix", "domain", "host")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port, for the levels of reputation."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*\z", "")


def _labels(name: Column, suffixes, more: int) -> Column:
    """The longest suffix of the table that name ends in, else its last label, with `more` labels before it; addresses are whole."""
    out = F.substring_index(name, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in suffixes if "." in s}):
        tail = F.substring_index(name, ".", -n)
        out = F.when(tail.isin(*[s for s in suffixes if s.count(".") + 1 == n]), F.substring_index(name, ".", -n - more)).otherwise(out)
    return F.when(name.rlike(r"^([0-9]+\.){3}[0-9]+\z") | name.startswith("["), name).otherwise(out)


def suffix_of(name: Column, suffixes=SUFFIXES) -> Column:
    return _labels(name, suffixes, 0)


def domain_of(name: Column, suffixes=SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more."""
    return _labels(name, suffixes, 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (verdict, host/path) that fits, as a struct, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the pooled bad share, and the beta prior's strength by the method of moments.

    With g groups of n pages, b of them bad, and pooled share p: S = sum(b^2 / n) - N p^2 is
    (g - 1) p (1 - p) if all groups are alike; the excess gives the variance between groups.
    """
    sums = groups.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("nn"), F.sum("b").alias("bb"), F.sum(F.col("b") * F.col("b") / F.col("n")).alias("bbn"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    sums = sums.withColumn("p", (F.coalesce("bb", F.lit(0)) + 0.5) / (F.coalesce("nn", F.lit(0)) + 1.0))
    spread = F.try_divide(F.col("bbn") - F.col("nn") * F.col("p") * F.col("p") - (F.col("g") - 1) * F.col("p") * (1 - F.col("p")), F.col("nn") - F.try_divide("n2", "nn"))
    k = F.try_divide(F.col("p") * (1 - F.col("p")), F.greatest(spread, F.lit(1e-9))) - 1
    return sums.select("g", "p", F.coalesce(F.least(F.greatest(k, F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0)).alias("k"))


def host_reputation(outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """Posterior bad share of every host in outcomes (host, bad boolean; null: not labelled).

    suffixes: those of two labels and more; a host is one without user and port (see name_of).

    Each level's share is shrunk through a beta prior centred on the level above: all pages,
    suffix, registered domain, host. Strengths come from the spread of that level's groups.
    Returns host, n, b, mean, sd of the host's beta posterior. A host without labelled pages
    has its prior, from the nearest of domain, suffix and all pages that has any; with no
    labels at all, mean and sd are null. Null hosts are left out. Counts are aggregated before
    each shuffle; parents come by joins on their name.
    """
    hosts = outcomes.filter("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("b"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes)).withColumn("domain", domain_of(F.col("host"), suffixes))
    groups = {level: hosts.filter("n > 0").groupBy(level).agg(F.sum("n").alias("n"), F.sum("b").alias("b")) for level in LEVELS}
    strength = {level: F.broadcast(_strength(groups[level]).select(F.col("g").alias(f"g_{level}"), F.col("p").alias(f"p_{level}"), F.col("k").alias(f"k_{level}"))) for level in LEVELS}  # one row each
    n, b = F.col("n"), F.col("b")
    suffix = groups["suffix"].crossJoin(strength["suffix"]).select("suffix", ((b + F.col("k_suffix") * F.col("p_suffix")) / (n + F.col("k_suffix"))).alias("m_suffix"))
    domain = groups["domain"].withColumn("suffix", suffix_of(F.col("domain"), suffixes)).crossJoin(strength["domain"]).join(suffix, "suffix")
    domain = domain.select("domain", ((b + F.col("k_domain") * F.col("m_suffix")) / (n + F.col("k_domain"))).alias("m_domain"))
    size = n + F.col("k_host")
    prior = F.coalesce("m_domain", "m_suffix", F.when(F.col("g_suffix") > 0, F.col("p_suffix")))
    mean = (b + F.col("k_host") * prior) / size
    return hosts.crossJoin(strength["host"]).crossJoin(strength["suffix"]).join(domain, "domain", "left").join(suffix, "suffix", "left").select("host", "n", "b", mean.alias("mean"), F.sqrt(mean * (1 - mean) / (size + 1)).alias("sd"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = 1.645, most_bad: float = 0.5, url_col: str = "url", id_col: str = "page_id", suffixes=SUFFIXES) -> DataFrame:
    """Verdict on every row of pages: the longest fitting rule's, else by host reputation.

    outcomes: one row per labelled page, (id, bad boolean). A host is blocked when the lower
    bound of its posterior bad share, mean - z sd, exceeds most_bad; hosts without labelled
    pages are judged by their prior alone. Rules look at the host as it stands, reputation at
    its name without user and port. suffixes: the table of suffixes of two labels and more.
    Returns id, host, path, rule, verdict, bad_mean (null: no host, or no outcomes at all).

    Nulls: a null url, or one without ://, has an empty host and path and fits no rule; a null
    id is carried and never labelled. Repeated rows are judged alike; an id labelled more than
    once is bad if any of its labels is. Empty tables give no rows, or no reputations.
    """
    u = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(u).alias("host"), path_of(u).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("name", name_of(F.col("host")))
    labelled = outcomes.toDF("oid", "bad").groupBy("oid").agg(F.max("bad").alias("bad"))
    seen = rows.join(labelled, rows["id"] == labelled["oid"]).filter("name <> ''").select(F.col("name").alias("host"), "bad")
    every = rows.filter("name <> ''").select(F.col("name").alias("host"), F.lit(None).cast("boolean").alias("bad")).distinct()
    known = host_reputation(seen.unionByName(every), suffixes).select(F.col("host").alias("h"), "mean", "sd")
    judged = rows.join(known, rows["name"] == F.col("h"), "left")
    block = F.coalesce(F.col("mean") - z * F.col("sd") > most_bad, F.lit(False))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(block, "block").otherwise("allow")).alias("verdict"), F.col("mean").alias("bad_mean"),
    )


def _level_sql(level: str) -> str:
    """A level's number of groups, pooled share and prior strength."""
    return f"""SELECT g, p, coalesce(least(greatest(p * (1 - p) / greatest((bbn - nn * p * p - (g - 1) * p * (1 - p)) / nullif(nn - n2 / nn, 0), 1e-9) - 1, 1.0), 1000.0), 1000.0) AS k
    FROM (SELECT *, (coalesce(bb, 0) + 0.5) / (coalesce(nn, 0) + 1.0) AS p FROM (SELECT count(*) AS g, CAST(sum(n) AS DOUBLE) AS nn, CAST(sum(b) AS DOUBLE) AS bb, sum(CAST(b AS DOUBLE) * b / n) AS bbn, CAST(sum(n * n) AS DOUBLE) AS n2 FROM g_{level}))"""


#: The url query as SQL: the rules, suffixes and bounds of the query stand here as values of their own.
ORACLE = rf"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
named AS (SELECT *, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*\z', '') AS name FROM u),
cuts AS (SELECT name, string_split(name, '.') AS ls, regexp_matches(name, '^([0-9]+\.){{3}}[0-9]+\z') OR starts_with(name, '[') AS address FROM (SELECT DISTINCT name FROM named WHERE name <> '')),
sized AS (SELECT *, CASE WHEN array_to_string(ls[-2:], '.') IN ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') THEN 2 ELSE 1 END AS m FROM cuts),
levels AS (SELECT name, CASE WHEN address THEN name WHEN m = 2 THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix,
    CASE WHEN address THEN name WHEN m = 2 THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain FROM sized),
o AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
g_host AS (SELECT l.name, l.suffix, l.domain, count(*) AS n, CAST(sum(bad) AS BIGINT) AS b FROM named u JOIN o ON page_id = doc_id JOIN levels l ON l.name = u.name GROUP BY ALL),
g_domain AS (SELECT domain, any_value(suffix) AS suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b FROM g_host GROUP BY domain),
g_suffix AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b FROM g_host GROUP BY suffix),
s_host AS ({_level_sql("host")}), s_domain AS ({_level_sql("domain")}), s_suffix AS ({_level_sql("suffix")}),
m_suffix AS (SELECT suffix, (b + k * p) / (n + k) AS m FROM g_suffix CROSS JOIN s_suffix),
m_domain AS (SELECT d.domain, (d.b + k * s.m) / (d.n + k) AS m FROM g_domain d CROSS JOIN s_domain JOIN m_suffix s ON s.suffix = d.suffix),
priors AS (SELECT l.name, coalesce(h.n, 0) AS n, coalesce(h.b, 0) AS b, coalesce(d.m, s.m, CASE WHEN t.g > 0 THEN t.p END) AS prior
    FROM levels l CROSS JOIN s_suffix t LEFT JOIN g_host h ON h.name = l.name LEFT JOIN m_domain d ON d.domain = l.domain LEFT JOIN m_suffix s ON s.suffix = l.suffix),
m_host AS (SELECT name, (b + k * prior) / (n + k) AS m, n + k + 1 AS size FROM priors CROSS JOIN s_host),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN m - 1.645 * sqrt(m * (1 - m) / size) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN m_host h ON r.name = h.name
"""
