"""Operator 8: URL filter by empirical-Bayes host reputation.

Outcomes of labelled pages (bad or not) are counted once by host, and the counts stored;
they add up to registered domains and public suffixes. Rates shrink down the tree: the suffix
toward all pages, the domain toward its suffix, the host toward its domain. Each level's beta
prior has the parent's posterior mean and a strength estimated from that level by the
moments of the beta-binomial. A page is dropped where the lower bound of its host's posterior (mean
less Z standard deviations) exceeds MAX_BAD: bad beyond doubt, so that a host with few
labels is never dropped for bad luck.

Public suffixes come from a table of rules in the public suffix list's own notation (names,
*.names, !names), or, where none is given, from a few rules: a usual second level below a
two-letter country (com.au), a known hosting service (github.io), else the last label.

Results by case. Null URL, or one without a host: host null, judged by the rate of all
pages in verdicts; keep_good keeps it. Addresses in digits or brackets: their own domain, the suffix empty.
Several labels of one page: bad if any says so. Null labels: don't count. No label at
all, or an empty table of labels: rate 0.5 with the weakest prior, everything stays. Empty pages: empty result.
Very long URLs: whole. Repeated rows: one result each, and each is an outcome. Ties: none
arise. Extra columns: ignored by verdicts, kept by keep_good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import free_name, stored

MAX_BAD = 0.5
Z = 1.645
#: Bounds of a prior's strength in labelled pages.
WEAKEST, STRONGEST = 1.0, 1000.0
SECOND = "ac ad art asn assn biz cat club co com coop ed edu edunet eng ernet firm fin gen go gob gok gov gouv govt gub gv id idv ind inf info int iwi k12 lg ltd me med mil mod muni name ne net nhs nic nom nt or org plc police pro pub rec res sch sld store tm tv web".split()
HOSTING = "appspot.com azurewebsites.net blogspot.com cloudfront.net firebaseapp.com fly.dev github.io githubusercontent.com gitlab.io herokuapp.com myshopify.com neocities.org netlify.app netlify.com onrender.com pages.dev readthedocs.io substack.com surge.sh tumblr.com vercel.app web.app weebly.com wixsite.com wordpress.com workers.dev".split()


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port, final dot or a leading www; null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", ""), F.lit(""))


def is_address(host: Column) -> Column:
    return host.rlike(r"^(?:[0-9.]+|\[.*)$")


def suffix_of(host: Column) -> Column:
    """Public suffix by the built-in rules; empty for an address."""
    last_two, last = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"([^.]+)$", 1)
    second = last_two.rlike(rf"^(?:{'|'.join(SECOND)})\.[a-z][a-z]$") | last_two.isin(*HOSTING)
    return F.when(is_address(host), F.lit("")).when(second, last_two).otherwise(last)


def suffixes_by_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and suffix of distinct hosts by rules(rule): an exception's parent, else the longest rule's match, else the last label."""
    named = hosts.filter("host IS NOT NULL").select("host", is_address(F.col("host")).alias("address"), F.split("host", r"\.").alias("l"))
    cut = named.filter("NOT address").select("host", "l", F.explode(F.sequence(F.lit(1), F.size("l"))).alias("k"))
    backward = F.array_join(F.slice("l", F.size("l") - F.col("k") + 1, F.col("k")), ".")
    parent = F.when(F.col("k") > 1, F.array_join(F.slice("l", F.size("l") - F.col("k") + 2, F.col("k") - 1), "."))
    kinds = F.array(F.struct(backward.alias("rule"), F.lit(0).alias("back")), F.struct(F.concat(F.lit("*."), parent).alias("rule"), F.lit(0).alias("back")), F.struct(F.concat(F.lit("!"), backward).alias("rule"), F.lit(1).alias("back")))
    asked = cut.select("host", "l", "k", F.inline(kinds))
    known = rules.select(F.lower(F.trim("rule")).alias("rule")).filter("rule <> ''").distinct()
    best = asked.join(known, "rule").groupBy("host").agg(F.max(F.struct("back", "k")).alias("best"))
    size = F.coalesce(F.col("best.k") - F.col("best.back"), F.lit(1))
    suffix = F.array_join(F.slice("l", F.greatest(F.lit(1), F.size("l") - size + 1), size), ".")
    return named.join(best, "host", "left").select("host", F.when(F.col("address"), F.lit("")).otherwise(suffix).alias("suffix"))


def domain_of(host: Column, suffix: Column) -> Column:
    """Registered domain: the suffix and one label before it; the host itself where there is none."""
    before = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when((suffix == "") | (host == suffix), host).otherwise(F.concat(F.regexp_extract(before, r"([^.]+)$", 1), F.lit("."), suffix))


def outcomes_of(labels: DataFrame) -> DataFrame:
    """page_id and bad (0 or 1): low quality or toxic."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))


def strength(level: DataFrame) -> float:
    """Of a level's prior, from n, y and the parents' rates p: the over-dispersion of its counts around them."""
    n, y, p = F.col("n"), F.col("y"), F.col("p")
    r = level.agg(F.sum((y - n * p) * (y - n * p) - n * p * (1 - p)).alias("over"), F.sum(n * (n - 1) * p * (1 - p)).alias("scale")).first()
    if not r["scale"]:
        return WEAKEST
    rho = r["over"] / r["scale"]
    return STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, 1 / rho - 1))


def reputations(hosts: DataFrame, labelled: DataFrame, max_bad: float = MAX_BAD, z: float = Z) -> tuple[DataFrame, tuple[float, float]]:
    """n_labelled, bad_rate, lower_bound and keep of every host of hosts(host, domain, suffix), by labelled(host, domain, suffix, bad); and rate and bound where there is no host."""
    counts = stored(labelled.filter("host IS NOT NULL AND bad IS NOT NULL").groupBy("host", "domain", "suffix").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("y")), "hosts")
    everyone = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    p0 = (everyone[1] + WEAKEST / 2) / (everyone[0] + WEAKEST)
    sums = [F.sum(c).alias(c) for c in "ny"]

    def posterior(level: DataFrame, name: str) -> tuple[DataFrame, float]:
        m = strength(level)
        return stored(level.withColumn(name, (F.col("y") + m * F.col("p")) / (F.col("n") + m)).drop("n", "y", "p"), name), m

    by_suffix, _ = posterior(counts.groupBy("suffix").agg(*sums).withColumn("p", F.lit(p0)), "rate_s")
    by_domain, _ = posterior(counts.groupBy("domain", "suffix").agg(*sums).join(by_suffix.withColumnRenamed("rate_s", "p"), "suffix"), "rate_d")
    m = strength(counts.join(by_domain.withColumnRenamed("rate_d", "p"), ["domain", "suffix"]))
    own = hosts.join(counts.select("host", "n", "y"), "host", "left").join(by_domain, ["domain", "suffix"], "left").join(by_suffix, "suffix", "left")
    n, y, p = F.coalesce("n", F.lit(0.0)), F.coalesce("y", F.lit(0.0)), F.coalesce("rate_d", "rate_s", F.lit(p0))
    own = own.select("host", "domain", "suffix", n.alias("n"), ((y + m * p) / (n + m)).alias("mean"), (n + m).alias("size"))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("size") + 1))
    rows = own.select("host", "domain", "suffix", F.col("n").cast("bigint").alias("n_labelled"), F.round("mean", 6).alias("bad_rate"), F.round(bound, 6).alias("lower_bound"), (bound <= max_bad).alias("keep"))
    return rows, (p0, p0 - z * (p0 * (1 - p0) / (m + 1)) ** 0.5)


def _named(pages: DataFrame, rules: DataFrame | None) -> DataFrame:
    """page_id, host, suffix and domain."""
    named = pages.select("page_id", host_of(pages["url"]).alias("host"))
    if rules is None:
        named = named.withColumn("suffix", suffix_of(F.col("host")))
    else:
        named = named.join(stored(suffixes_by_rules(named.select("host").distinct(), rules), "suffixes"), "host", "left")
    return named.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def verdicts(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, z: float = Z, rules: DataFrame | None = None) -> DataFrame:
    """page_id, host, domain, suffix, n_labelled, bad_rate, lower_bound and keep for every row of pages. Hosts are judged once each."""
    named = _named(pages, rules)
    hosts = named.filter("host IS NOT NULL").select("host", "domain", "suffix").distinct()
    judged, (rate, bound) = reputations(hosts, named.join(outcomes.select("page_id", "bad"), "page_id"), max_bad, z)
    judged = stored(judged.drop("domain", "suffix"), "judged")
    none = {"n_labelled": F.lit(0).cast("bigint"), "bad_rate": F.round(F.lit(rate), 6), "lower_bound": F.round(F.lit(bound), 6), "keep": F.lit(bound <= max_bad)}
    return named.join(judged, "host", "left").select("page_id", "host", "domain", "suffix", *[F.coalesce(c, x).alias(c) for c, x in none.items()])


def keep_good(pages: DataFrame, outcomes: DataFrame, max_bad: float = MAX_BAD, z: float = Z, rules: DataFrame | None = None) -> DataFrame:
    """pages without those of hosts that are bad beyond doubt; all columns stay."""
    gone = verdicts(pages, outcomes, max_bad, z, rules).filter("NOT keep AND host IS NOT NULL").select(F.col("host").alias(free_name(pages, "qs_host"))).distinct()
    return pages.join(gone, host_of(pages["url"]) == gone[gone.columns[0]], "left_anti")


def oracle(max_bad: float = MAX_BAD, z: float = Z) -> str:
    """DuckDB SQL for verdicts over the tables pages and labels, written apart from the code above: levels as windows over rows of hosts."""
    usual = "|".join(SECOND)
    hosting = ", ".join(f"'{h}'" for h in HOSTING)
    prior = lambda over, scale: f"CASE WHEN coalesce({scale}, 0) = 0 THEN {WEAKEST} WHEN {over} <= 0 THEN {STRONGEST} ELSE least({STRONGEST}, greatest({WEAKEST}, {scale} / {over} - 1)) END"
    moments = "sum(power(bads - total * base, 2) - total * base * (1 - base)) AS over, sum(total * (total - 1) * base * (1 - base)) AS scale"
    return rf"""
WITH u AS (SELECT page_id, lower(url) AS url FROM pages),
v AS (SELECT page_id, nullif(regexp_replace(rtrim(regexp_extract(url, '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]+)', 1), '.'), '^www\.', ''), '') AS host FROM u),
x AS (SELECT *, string_split(host, '.') AS l FROM v),
s AS (SELECT page_id, host, l, CASE WHEN regexp_matches(host, '^([0-9.]+|\[.*)$') THEN ''
  WHEN len(l) >= 2 AND (regexp_matches(l[-1], '^[a-z]{{2}}$') AND regexp_matches(l[-2], '^({usual})$') OR l[-2] || '.' || l[-1] IN ({hosting})) THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix FROM x),
pg AS (SELECT page_id, host, suffix, CASE WHEN suffix = '' OR suffix = host THEN host ELSE list_extract(l, -1 - len(string_split(suffix, '.'))) || '.' || suffix END AS domain FROM s),
oc AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
hs AS (SELECT host, domain, suffix, count(*)::DOUBLE AS total, sum(bad)::DOUBLE AS bads FROM pg JOIN oc ON doc_id = page_id WHERE host IS NOT NULL GROUP BY ALL),
al AS (SELECT (coalesce(sum(bads), 0) + {WEAKEST} / 2) / (coalesce(sum(total), 0) + {WEAKEST}) AS base FROM hs),
s1 AS (SELECT suffix, sum(total) AS total, sum(bads) AS bads, any_value(base) AS base FROM hs, al GROUP BY suffix),
s2 AS (SELECT suffix, (bads + k * base) / (total + k) AS rate FROM s1, (SELECT {prior("over", "scale")} AS k FROM (SELECT {moments} FROM s1))),
d1 AS (SELECT domain, h.suffix, sum(total) AS total, sum(bads) AS bads, any_value(rate) AS base FROM hs h JOIN s2 ON h.suffix = s2.suffix GROUP BY 1, 2),
d2 AS (SELECT domain, suffix, (bads + k * base) / (total + k) AS rate FROM d1, (SELECT {prior("over", "scale")} AS k FROM (SELECT {moments} FROM d1))),
h1 AS (SELECT h.*, d2.rate AS base FROM hs h JOIN d2 USING (domain, suffix)),
hk AS (SELECT {prior("over", "scale")} AS k FROM (SELECT {moments} FROM h1)),
j AS (SELECT pg.*, coalesce(h1.total, 0) AS n, coalesce(h1.bads, 0) AS y, k, coalesce(h1.base, d2.rate, s2.rate, al.base) AS base FROM pg CROSS JOIN hk CROSS JOIN al LEFT JOIN h1 USING (host) LEFT JOIN d2 ON d2.domain = pg.domain AND d2.suffix = pg.suffix LEFT JOIN s2 ON s2.suffix = pg.suffix),
m AS (SELECT *, (y + k * base) / (n + k) AS mean FROM j),
b AS (SELECT *, mean - {z} * sqrt(mean * (1 - mean) / (n + k + 1)) AS low FROM m)
SELECT page_id, host, domain, suffix, n::BIGINT AS n_labelled, round(mean, 6) AS bad_rate, round(low, 6) AS lower_bound, low <= {max_bad} AS keep FROM b
"""
