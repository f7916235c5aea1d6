"""URL filters by empirical-Bayes host reputation. DataFrame expressions only.

Labelled page outcomes are counted per host, registered domain and suffix. A beta-binomial prior is carried down: the
overall rate is the suffixes' prior mean, a suffix's posterior mean is its domains' prior mean, and a domain's its
hosts'. How strongly each level is pulled (the prior's size) is estimated from how much the level's rates spread beyond
binomial noise (method of moments), within PRIOR_MIN..PRIOR_MAX. A page is allowed if the lower posterior bound of its
host's good rate, mean - z * sd, reaches ``threshold``: LOSS_BAD / (LOSS_BAD + LOSS_GOOD), from what a bad page that is
let in costs against a good page that is kept out. With equal losses a host needs better than even odds.

Outcomes are an argument of ``judge``. Without them, pages that a rule decides are the labelled ones.

Rules (host, path prefix) go before reputation; the longest fitting rule decides. Up to INLINE_RULES are one expression;
more, or a table of them, are joined on the host's endings.

A host's suffix is its last label, or its last two where a table of suffixes has them, or where the last is a country's
(two letters) and the one before is one of GENERIC. A user name, a port and a final dot are no part of it. An IP address is
its own domain, of the suffix ``ip``.

Defined results: a null url or one without ``://`` has an empty host and path and the reputation of the empty suffix;
very long urls are taken whole; a null page_id is a page like any other; extra columns stay, those named as a result go;
without any labelled page the rate is 1/2 and the bound that of the prior alone; repeated rows each get a result; hosts
that hold a third of all pages are counted in partial sums and joined by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut

#: Fixed rules: verdict, rule (host, then path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Labels that with a country's make a suffix.
GENERIC = ("ac", "co", "com", "edu", "gov", "net", "org")
IP = r"^([0-9]+\.){3}[0-9]+$|^\["
PRIOR_MIN, PRIOR_MAX = 2.0, 200.0
Z = 1.0
LOSS_BAD, LOSS_GOOD = 1.0, 1.0
THRESHOLD = LOSS_BAD / (LOSS_BAD + LOSS_GOOD)
INLINE_RULES = 200
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWERED)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user name, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def suffix_of(site: Column) -> Column:
    """The suffix by rule."""
    labels = F.split(site, r"\.")
    last, before = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    long = (F.length(last) == 2) & F.coalesce(before, F.lit("")).isin(*GENERIC)
    return F.when(site.rlike(IP), "ip").when(long, F.concat_ws(".", before, last)).otherwise(last)


def endings(site: Column) -> Column:
    """All endings of whole labels."""
    labels = F.split(site, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def domain_of(site: Column, suffix: Column) -> Column:
    """The suffix and one label before it; the suffix itself if there is none; an IP address."""
    labels, n = F.split(site, r"\."), F.size(F.split(suffix, r"\.")) + 1
    named = F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.least(n, F.size(labels))), ".")
    return F.when(suffix == "ip", site).otherwise(named)


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """``hosts`` (host, each once) with suffix and domain; the longest ending in ``suffixes`` (suffix) goes before the rule."""
    hosts = hosts.withColumn("site", site_of(F.col("host")))
    suffix = suffix_of(F.col("site"))
    if suffixes is not None:
        listed = hosts.select("host", F.explode(endings(F.col("site"))).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix")
        hosts = hosts.join(listed.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("listed")), "host", "left")
        suffix = F.coalesce("listed", suffix)
    return hosts.withColumn("suffix", suffix).withColumn("domain", domain_of(F.col("site"), F.col("suffix"))).drop("site", "listed")


def with_rule(pages: DataFrame, rules=RULES, inline: int = INLINE_RULES) -> DataFrame:
    """``pages`` (host, path) with ``rule`` (the longest that fits, or null) and ``rule_verdict``; ``rules``: (verdict, rule)
    rows or a table of them. Of one rule with two verdicts the later in order counts."""
    if isinstance(rules, DataFrame) or len(rules) > inline:
        return _with_rule_table(pages, rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, rule string"))
    if not rules:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    fitting = []
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fitting.append(F.when(fits, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.greatest(*fitting) if len(fitting) > 1 else fitting[0]
    return pages.withColumn("_best", best).withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def _with_rule_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    named = rules.select(F.split_part("rule", F.lit("/"), F.lit(1)).alias("ending"), F.struct(F.length("rule").alias("size"), "rule", "verdict").alias("_rule"))
    named = named.withColumn("_path", F.expr("substring(_rule.rule, length(ending) + 1)"))
    urls = pages.select("host", "path").distinct()
    fits = urls.withColumn("ending", F.explode(endings(F.col("host")))).join(named, "ending").where(F.col("path").startswith(F.col("_path")))
    best = fits.groupBy("host", "path").agg(F.max("_rule").alias("_best"))
    return pages.join(best, ["host", "path"], "left").withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")}).drop("_best")


def _prior_size(level: DataFrame, mean: str) -> DataFrame:
    """One row: m, the size of the level's beta prior. ``level``: n, k and the prior mean of every group."""
    p, n = F.col(mean), F.col("n")
    noise, spread = F.sum(p * (1 - p)), F.sum(n * (F.col("k") / n - p) * (F.col("k") / n - p))
    # E[n (k/n - p)^2] = p (1 - p) (1 + (n - 1) / (m + 1))
    room = F.sum((n - 1) * p * (1 - p))
    excess = F.greatest((spread - noise) / room, F.lit(1 / (PRIOR_MAX + 1)))
    m = F.when(room > 0, 1 / excess - 1).otherwise(F.lit(PRIOR_MAX))
    return level.where("n > 0").agg(F.round(F.greatest(F.lit(PRIOR_MIN), F.least(F.lit(PRIOR_MAX), F.coalesce(m, F.lit(PRIOR_MAX)))), 6).alias("m"))


def reputation(pages: DataFrame, z: float = Z, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, k, alpha, beta, mean, bound) of every host of ``pages`` (host, good: true, false or null if unlabelled).

    Each level is written once, and the next ones read that."""
    hosts = pages.groupBy("host").agg(F.count("good").alias("n"), F.count_if(F.col("good")).alias("k"))
    hosts = cut(with_domains(hosts, suffixes), "hosts")

    def total(df, *keys):
        return cut(df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k")), keys[-1])

    domains = total(hosts, "suffix", "domain")
    endings = total(domains, "suffix")
    overall = endings.agg(((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("p0"))

    def shrink(level: DataFrame, prior: str, out: str) -> DataFrame:
        sized = level.withColumn("m", _prior_size(level, prior).scalar())
        return sized.withColumn(out, (F.col("m") * F.col(prior) + F.col("k")) / (F.col("m") + F.col("n")))

    endings = cut(shrink(endings.withColumn("p0", overall.scalar()), "p0", "p_suffix").select("suffix", "p_suffix"), "suffix-rates")
    domains = cut(shrink(domains.join(endings, "suffix"), "p_suffix", "p_domain").select("suffix", "domain", "p_domain"), "domain-rates")
    hosts = shrink(cut(hosts.join(domains, ["suffix", "domain"]), "host-rates"), "p_domain", "mean")
    alpha, beta = F.col("m") * F.col("p_domain") + F.col("k"), F.col("m") * (1 - F.col("p_domain")) + F.col("n") - F.col("k")
    sized = F.col("alpha") + F.col("beta")
    return (
        hosts.withColumns({"alpha": alpha, "beta": beta})
        .withColumn("bound", F.round(F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (sized + 1)), 6))
        .select("host", "n", "k", F.round("alpha", 6).alias("alpha"), F.round("beta", 6).alias("beta"), F.round("mean", 6).alias("mean"), "bound")
    )


def judge(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, z: float = Z, good: Column | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """``pages`` (url) with host, path, rule, verdict, mean and bound.

    ``good`` labels a page's outcome (boolean, null for unlabelled); by default a page that a rule decides is labelled by
    the rule's verdict.
    """
    clash = [c for c in ("host", "path", "rule", "verdict", "rule_verdict", "_good", "bound", "mean", "_best") if c in pages.columns and c != "url"]
    label = {} if good is None else {"_good": good}
    seen = with_rule(pages.withColumns(label).drop(*clash).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}), rules)
    outcome = (F.col("rule_verdict") == "allow") if good is None else F.col("_good")
    known = reputation(seen.select("host", outcome.alias("good")), z, suffixes).select("host", "mean", "bound")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block"))
    return seen.join(known, "host").withColumn("verdict", verdict).drop("_good", "rule_verdict")


#: The same in DuckDB.
SQL = f"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWERED}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, (SELECT max_by(rule, length(rule)) FROM (VALUES {", ".join(f"('{r}')" for _, r in RULES)}) AS rules(rule)
    WHERE (host = split_part(rule, '/', 1) OR host LIKE '%.' || split_part(rule, '/', 1))
      AND starts_with(path, substr(rule, strpos(rule, '/')))) AS rule
  FROM parsed),
judged AS (
  SELECT *, CASE rule {" ".join(f"WHEN '{r}' THEN '{v}'" for v, r in RULES)} END AS rule_verdict FROM ruled),
hosts AS (
  SELECT host, count(rule_verdict) AS n, count(*) FILTER (WHERE rule_verdict = 'allow') AS k,
    string_split(regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(:[0-9]*)?$', ''), '.') AS labels
  FROM judged GROUP BY host),
named AS (
  SELECT *, CASE suffix WHEN 'ip' THEN array_to_string(labels, '.') ELSE array_to_string(list_slice(labels, -(len(string_split(suffix, '.')) + 1), -1), '.') END AS domain
  FROM (SELECT *, CASE WHEN regexp_matches(array_to_string(labels, '.'), '{IP}') THEN 'ip'
    WHEN length(labels[-1]) = 2 AND coalesce(labels[-2], '') IN ({", ".join(f"'{s}'" for s in GENERIC)}) THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix FROM hosts)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
overall AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p FROM suffixes),
s0 AS (SELECT s.*, p FROM suffixes s, overall),
s1 AS (SELECT suffix, (m * p + k) / (m + n) AS p FROM s0, (SELECT {{size}} AS m FROM s0 WHERE n > 0)),
d0 AS (SELECT d.*, p FROM domains d JOIN s1 USING (suffix)),
d1 AS (SELECT suffix, domain, (m * p + k) / (m + n) AS p FROM d0, (SELECT {{size}} AS m FROM d0 WHERE n > 0)),
h0 AS (SELECT h.*, p FROM named h JOIN d1 USING (suffix, domain)),
h1 AS (SELECT host, (m * p + k) / (m + n) AS mean, m + n AS sized FROM h0, (SELECT {{size}} AS m FROM h0 WHERE n > 0)),
h2 AS (SELECT host, round(mean, 6) AS mean, round(mean - {Z} * sqrt(mean * (1 - mean) / (sized + 1)), 6) AS bound FROM h1)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN bound >= {THRESHOLD} THEN 'allow' ELSE 'block' END) AS verdict, mean, bound
FROM judged JOIN h2 USING (host)
""".replace(
    "{size}",
    f"""round(greatest({PRIOR_MIN}, least({PRIOR_MAX}, coalesce(CASE WHEN sum((n - 1) * p * (1 - p)) > 0 THEN
  1 / greatest((sum(n * (k / n - p) * (k / n - p)) - sum(p * (1 - p))) / sum((n - 1) * p * (1 - p)), {1 / (PRIOR_MAX + 1)}) - 1
  ELSE {PRIOR_MAX} END, {PRIOR_MAX}))), 6)""",
)
