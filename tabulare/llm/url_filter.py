"""URL filter: path rules first, then an empirical-Bayes reputation of the host.

Rules (host, path, verdict) fit their host and all its subdomains if the
url's path starts with the rule's; the longest rule wins. Urls that no rule
fits are judged by their host's share of bad pages: labelled outcomes are
shrunk through beta-binomial priors from the suffix to the registered domain
to the host. Each level's prior mean is the posterior mean of the level
above, its strength comes from the spread of the shares at that level
(moment estimate of the intra-class correlation). A host is blocked if the
lower bound of its posterior share of bad pages is above ``BLOCK_ABOVE``;
hosts without labels inherit their domain's belief, so few labels never block.

Scale: everything is a grouped sum with map-side combine over hosts, domains
and suffixes, and joins that may split a hot host; per-host facts are joined
back to the urls once. Rules are a bounded parameter (a few thousand at most)
and broadcast. Three numbers per level reach the driver.

Defined results for odd input: NULL urls and urls without ``://`` have an
empty host and path, and are judged as the host ``""``; labels that are NULL
or name no page do not count; repeated rows are judged alike and count once
each; without labels every prior is ``PRIOR_BAD``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulare.llm.common import materialize

RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_RULES = 10_000
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")   # below a two-letter suffix, part of the suffix
BLOCK_ABOVE = 0.5
Z = 1.645                  # one-sided 95 % bound, normal approximation of the beta posterior
PRIOR_BAD = 0.1
LEAST_RHO, MOST_RHO = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it has none."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.regexp_extract(url, _URL, 2)


def domain_parts(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels and the last, or one more below suffixes like ``co.uk``."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    deep = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.get(labels, n - 2).isin(*SECOND_LEVEL)
    address = host.rlike(r"^[0-9.]+$|^\[")
    take = lambda k: F.array_join(F.slice(labels, F.greatest(n - k, F.lit(0)) + 1, k), ".")
    domain = F.when(address, host).when(deep, take(F.lit(3))).otherwise(take(F.lit(2)))
    suffix = F.when(address, host).when(deep, take(F.lit(2))).otherwise(take(F.lit(1)))
    return domain, suffix


def _strength(groups: DataFrame, parent_mean: float) -> float:
    """Prior strength ``1 / rho - 1`` from ``(n, bad)`` per group."""
    s = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - parent_mean, F.lit(2.0))).alias("s")).first()
    free = (s["n"] or 0) - (s["nn"] or 0) / (s["n"] or 1) - (s["k"] - 1)
    spread = parent_mean * (1 - parent_mean)
    rho = ((s["s"] or 0.0) / spread - (s["k"] - 1)) / free if free > 0 and spread > 0 else LEAST_RHO
    return 1 / min(max(rho, LEAST_RHO), MOST_RHO) - 1


def host_reputation(hosts: DataFrame, prior_bad: float = PRIOR_BAD) -> DataFrame:
    """``host, mean, bound`` from ``(host, n, bad)``: posterior share of bad pages and its lower bound."""
    domain, suffix = domain_parts(F.col("host"))
    h = materialize(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "url-hosts")
    d = materialize(h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    s = materialize(d.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-suffixes")
    all_n, all_bad = s.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    mean = (all_bad + prior_bad) / (all_n + 1)
    post = lambda k, m: (k * m + F.col("bad")) / (k + F.col("n"))
    ks, kd, kh = (_strength(x, mean) for x in (s, d, h))
    s = s.select("suffix", post(ks, F.lit(mean)).alias("above"))
    d = d.join(s, "suffix").select("suffix", "domain", post(kd, F.col("above")).alias("above"))
    m = post(kh, F.col("above"))
    out = h.join(d, ["suffix", "domain"]).select("host", m.alias("mean"), (kh + F.col("n")).alias("weight"))
    return out.select("host", "mean", (F.col("mean") - Z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def fitting_rules(hosts: DataFrame, rules: tuple = RULES) -> DataFrame:
    """``host, rules``: the rules whose host is the host or a parent of it."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = hosts.sparkSession
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "rule_host string, rule_path string, rule_verdict string")
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (hosts.select("host", F.explode(parents).alias("rule_host")).join(F.broadcast(table), "rule_host")
                 .groupBy("host").agg(F.collect_list(F.struct("rule_host", "rule_path", "rule_verdict")).alias("rules")))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, block_above: float = BLOCK_ABOVE) -> DataFrame:
    """Per row ``page_id, host, path, rule, verdict``; ``outcomes`` has ``page_id, bad`` (0 or 1)."""
    host, path = url_parts(F.col("url"))
    urls = materialize(pages.select("page_id", host.alias("host"), path.alias("path")), "url-parts")
    good = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").select("page_id", F.col("bad").cast("long").alias("bad"))
    seen = urls.join(good, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = urls.groupBy("host").agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad"))
    hosts = hosts.unionByName(seen).groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    belief = materialize(host_reputation(hosts), "url-belief")
    facts = materialize(belief.join(fitting_rules(belief.select("host"), rules), "host", "left"), "url-facts")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(
        F.length(F.concat(r["rule_host"], r["rule_path"])).alias("size"), F.concat(r["rule_host"], r["rule_path"]).alias("rule"),
        r["rule_verdict"].alias("verdict"))))
    judged = urls.join(facts, "host").withColumn("best", best)
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(
        F.col("best.verdict"), F.when(F.col("bound") > block_above, "block").otherwise("allow")).alias("verdict"))


ORACLE_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
h0 AS (
  SELECT u.host, count(l.quality) AS n, coalesce(sum(1 - l.quality), 0) AS bad
  FROM u LEFT JOIN labels l ON u.page_id = l.doc_id GROUP BY u.host),
h1 AS (SELECT *, string_split(host, '.') AS ls, regexp_matches(host, '^[0-9.]+$|^\[') AS ip FROM h0),
h2 AS (SELECT *, len(ls) > 2 AND length(ls[-1]) = 2 AND ls[-2] IN ('ac','co','com','edu','gov','net','org') AS deep FROM h1),
h AS (SELECT host, n, bad,
        CASE WHEN ip THEN host WHEN deep THEN array_to_string(ls[-3:], '.') ELSE array_to_string(ls[-2:], '.') END AS domain,
        CASE WHEN ip THEN host WHEN deep THEN array_to_string(ls[-2:], '.') ELSE ls[-1] END AS suffix FROM h2),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
g AS (SELECT (coalesce(sum(bad), 0) + 0.1::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM s),
st AS (
  SELECT lvl, count(*) AS k, sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS nn, sum(n * (bad / n - (SELECT m FROM g)) ** 2) AS ss
  FROM (SELECT 's' AS lvl, n, bad FROM s UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 'h', n, bad FROM h) WHERE n > 0 GROUP BY lvl),
rho AS (SELECT lvl, CASE WHEN n - nn / n - (k - 1) > 0 THEN (ss / ((SELECT m * (1 - m) FROM g)) - (k - 1)) / (n - nn / n - (k - 1)) ELSE 0.001 END AS r FROM st),
kk AS (SELECT lvl, 1 / least(greatest(r, 0.001::DOUBLE), 0.5::DOUBLE) - 1 AS k FROM rho),
k3 AS (SELECT coalesce(max(k) FILTER (lvl = 's'), 999) AS ks, coalesce(max(k) FILTER (lvl = 'd'), 999) AS kd, coalesce(max(k) FILTER (lvl = 'h'), 999) AS kh FROM kk),
sp AS (SELECT suffix, (ks * m + bad) / (ks + n) AS a FROM s, g, k3),
dp AS (SELECT d.suffix, d.domain, (kd * sp.a + bad) / (kd + n) AS a FROM d JOIN sp USING (suffix), k3),
hp AS (SELECT h.host, (kh * dp.a + bad) / (kh + n) AS mean, kh + n AS w FROM h JOIN dp USING (suffix, domain), k3),
rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fit AS (
  SELECT u.page_id, u.host, u.path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(rh || rp) DESC, rh || rp DESC) AS rn
  FROM (SELECT DISTINCT * FROM u) u JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp))
SELECT u.page_id, u.host, u.path, fit.rule AS rule,
       coalesce(fit.rv, CASE WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (w + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN hp USING (host) LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM u.page_id AND fit.host = u.host AND fit.path = u.path AND fit.rn = 1
"""
