"""URL filtering: fixed rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted per host. A host's rate of bad pages is shrunk
through three levels, each the prior of the next: all pages, the public suffix, the registered
domain, the host. A prior's weight in pages is fitted to the counts of its level by the method of
moments of the beta-binomial. A host is blocked when the lower bound of its beta posterior passes a
threshold; a host without labels has its domain's posterior. Suffixes and domains follow rules of the
form of the public suffix list, an input whose default holds the registries' best-known ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict): a rule is a host and a path, and fits the host and its subdomains below the path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Second-level public suffixes by country, as published by the registries. The last label alone is always one.
SECOND_LEVEL = {
    "ar": "com edu gob gov int mil net org", "at": "ac co gv or", "au": "asn com edu gov id net org", "br": "com edu gov mil net org",
    "cn": "ac com edu gov mil net org", "co": "com edu gov mil net nom org", "id": "ac co go mil net or sch web", "il": "ac co gov k12 muni net org",
    "in": "ac co edu firm gen gov ind mil net nic org res", "jp": "ac ad co ed go gr lg ne or", "kr": "ac co go mil ne or pe re sc",
    "mx": "com edu gob net org", "my": "com edu gov mil name net org", "nz": "ac co cri geek gen govt health iwi kiwi maori mil net org parliament school",
    "ph": "com edu gov mil net org", "pl": "com edu gov net org", "sg": "com edu gov net org", "th": "ac co go in mi net or", "tr": "com edu gov mil net org",
    "tw": "com edu gov mil net org", "ua": "com edu gov net org", "uk": "ac co gov ltd me net nhs org plc police", "za": "ac co edu gov law mil net nom org school web",
}
#: Every label below these is a suffix, but for the names after the exclamation mark.
WILDCARDS = ["*.ck", "!www.ck", "*.bd", "*.er", "*.fk", "*.jm", "*.kh", "*.mm", "*.np", "*.pg", "*.sch.uk"]
SUFFIXES = [f"{x}.{country}" for country, names in SECOND_LEVEL.items() for x in names.split()] + WILDCARDS
#: A host is blocked if its rate of bad pages is above THRESHOLD with a posterior probability of more than 1 - TAIL.
THRESHOLD, TAIL = 0.5, 0.05
#: Bounds of a prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Suffix rules up to this many are broadcast.
BROADCAST_RULES = 100_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``."""
    part = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(part(r"(?s)^.*?://([^/?#]*)"), UPPER, LOWER), part(r"(?s)^.*?://[^/?#]*([^?#]*)")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict); null where none fits. Of equally long rules the last by name, then block, is taken."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), *r)):
        name, _, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def host_names(hosts: DataFrame, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(host, suffix, domain) of distinct ``hosts``: public suffix and registered domain.

    ``suffixes`` are rules as the public suffix list writes them: names, ``*.name`` for any label below a name,
    ``!name`` for an exception; the longest fitting rule holds, an exception before all others, and the last
    label where none fits. User and port are not part of a name; addresses in numbers are one name.
    """
    rules = [(r.lstrip("!").removeprefix("*."), 2 if r[0] == "!" else r.startswith("*.") + 0) for r in suffixes]
    deepest = max((r.count(".") + 1 for r, _ in rules), default=1)
    rules = hosts.sparkSession.createDataFrame(sorted(set(rules)) or [("", 0)], "tail string, kind int")
    if rules.count() <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    name = F.regexp_replace(F.regexp_extract("host", r"(?s)^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1), r"\.$", "")
    df = hosts.select("host", name.alias("name")).withColumn("labels", F.split("name", r"\."))
    df = df.withColumn("k", F.size("labels")).withColumn("number", F.col("name").rlike(r"^(?:\[.*|[0-9]+(?:\.[0-9]+){3})$"))
    last = lambda n: F.array_join(F.slice("labels", F.greatest(F.col("k") - n + 1, F.lit(1)), F.least(n, F.col("k"))), ".")
    tails = df.select("host", "k", "labels", F.explode(F.sequence(F.lit(1), F.least(F.lit(deepest), F.col("k")))).alias("n")).select("host", "k", "n", last(F.col("n")).alias("tail"))
    met = tails.join(rules, "tail").where("kind <> 1 or n < k").groupBy("host").agg(F.max(F.when(F.col("kind") == 2, F.col("n") - 1)).alias("not_below"), F.max(F.col("n") + (F.col("kind") == 1).cast("int")).alias("longest"))
    n = F.coalesce("not_below", "longest", F.lit(1))
    found = df.join(met, "host", "left").withColumn("n", F.when(F.col("number"), F.col("k")).otherwise(n))
    return found.select("host", last(F.col("n")).alias("suffix"), last(F.col("n") + 1).alias("domain"))


def beta_cdf(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(rate <= x) of beta distributions, by the continued fraction of the incomplete beta function."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    out = np.where(a <= 0, 1.0, 0.0)
    at = (a > 0) & (b > 0)
    turned = x > (a[at] + 1) / (a[at] + b[at] + 2)  # the fraction converges on this side
    p, q, y = np.where(turned, b[at], a[at]), np.where(turned, a[at], b[at]), np.where(turned, 1 - x, x)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones(len(p)), 1 / (1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 100_000):
        before = h
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / (1 + step * d), 1 + step / c
            h = h * d * c
        if np.all(np.abs(h - before) <= 1e-14 * np.abs(h)):
            break
    out[at] = np.where(turned, 1 - front * h, front * h)
    return out


def _weight(level: DataFrame, over: str) -> DataFrame:
    """For each ``over``, its pages and bad pages, and the weight that its members' prior deserves."""
    g = level.groupBy(over).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").cast("double").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"))
    pq = F.col("bad") / F.col("n") * (1 - F.col("bad") / F.col("n"))
    spread = F.col("bb") - F.col("bad") * F.col("bad") / F.col("n") - pq * (F.col("k") - 1)
    most = pq * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
    like = F.when((most > 0) & (spread > 0), spread / most)
    weight = F.coalesce(F.least(F.greatest(1 / like - 1, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)), F.lit(MOST_WEIGHT))
    return g.select(over, F.col("n").alias(f"{over}_n"), F.col("bad").alias(f"{over}_bad"), weight.alias(f"{over}_w"))


def reputation(hosts: DataFrame, outcomes: DataFrame, threshold: float = THRESHOLD, tail: float = TAIL, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(host, bad_rate, doubt, blocked) for each distinct host of ``hosts``.

    ``outcomes`` has (host, bad boolean) for each labelled page. ``doubt`` is the posterior probability that
    the rate is at most ``threshold``; below ``tail``, which is to say that the lower posterior bound is
    above the threshold, the host is blocked. Without any outcome, nothing is.
    Counts are doubles of whole numbers, so sums do not depend on their order.
    """
    counted = stored(outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad")))
    names = stored(host_names(hosts.select("host").union(counted.select("host")).distinct(), suffixes))
    by_host = counted.join(names, "host")
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes_, domains = _weight(by_domain, "suffix"), _weight(by_host, "domain")
    top = _weight(by_suffix.withColumn("top", F.lit(1)), "top").first()  # one row
    m0, w0 = (top["top_bad"] / top["top_n"], top["top_w"]) if top else (0.0, MOST_WEIGHT)
    df = names.join(hosts.select("host").distinct(), "host", "left_semi").join(counted, "host", "left").join(domains, "domain", "left").join(suffixes_, "suffix", "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    w = lambda name: F.coalesce(F.col(name), F.lit(MOST_WEIGHT))
    m1 = (c("suffix_bad") + w0 * m0) / (c("suffix_n") + w0)
    m2 = (c("domain_bad") + w("suffix_w") * m1) / (c("domain_n") + w("suffix_w"))
    df = df.select("host", (c("bad") + w("domain_w") * m2).alias("a"), (c("n") + w("domain_w")).alias("t"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, t = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a / t), pa.array(beta_cdf(threshold, a, t - a))], ["host", "bad_rate", "doubt"])

    return df.mapInArrow(judged, "host string, bad_rate double, doubt double").withColumn("blocked", F.col("doubt") < tail)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    ``outcomes`` has (url, bad). Null and malformed urls have an empty host and path, and are judged as
    the host "". Null page ids and repeated rows stay; an empty table gives no rows; other columns are
    not read. The reputation is joined by host; the join's skewed partitions are split at run time.
    """
    host, path = split_url(F.col("url"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "says": says})
    # stored, so that both sides of the join are plain shuffles and the partitions of a hot host can be split
    known = stored(reputation(judged.select("host"), outcomes.select(split_url(F.col("url"))[0].alias("host"), "bad"), threshold, suffixes=suffixes).select("host", "blocked"))
    blocked = F.when(F.col("blocked"), "block").otherwise("allow")
    return judged.join(known, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("says", blocked).alias("verdict"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad) of the pages whose document, numbered in the url's path, is labelled; bad if any of its labels is low or toxic."""
    number = F.regexp_extract(split_url(F.col("url"))[1], r"/(\d{1,18})(?:[./]|$)", 1)
    numbered = pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    bad = F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))))
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(bad.alias("bad"))
    return numbered.join(known, "doc_id").select("url", "bad")


def op9_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = stored(page_outcomes(pages, table(spark, sf_dir, "labels")))
    return judge_urls(pages, outcomes)


def _level(name: str, over: str, source: str) -> str:
    return f"""{name} AS (SELECT {over}, n AS {over}_n, bad AS {over}_bad,
    coalesce(least(greatest(1 / CASE WHEN most > 0 AND spread > 0 THEN spread / most END - 1, {LEAST_WEIGHT}), {MOST_WEIGHT}), {MOST_WEIGHT}) AS {over}_w
  FROM (SELECT *, bb - bad * bad / n - bad / n * (1 - bad / n) * (k - 1) AS spread, bad / n * (1 - bad / n) * (n - nn / n - (k - 1)) AS most
    FROM (SELECT {over}, sum(n) AS n, sum(bad) AS bad, count(*)::DOUBLE AS k, sum(n * n) AS nn, sum(bad * bad / n) AS bb FROM {source} GROUP BY {over})))"""


_HOST = r"lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''))"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_ORDERED = sorted(RULES, key=lambda r: (-len(r[0]), *r))
_RULES = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{{{i}}}'" for i, (h, p) in enumerate(r.split("/", 1) for r, _ in _ORDERED))
_TAILS = ", ".join(f"('{r.lstrip('!').removeprefix('*.')}', {2 if r[0] == '!' else int(r.startswith('*.'))})" for r in SUFFIXES)
_LAST = "array_to_string(labels[greatest(k - {0} + 1, 1):], '.')"
_NAMES = f"""labelled AS (SELECT *, len(labels) AS k FROM (SELECT host, name, string_split(name, '.') AS labels
    FROM (SELECT host, regexp_replace(regexp_extract(host, '(?s)^(?:.*@)?(\\[[^\\]]*\\]|[^:]*)', 1), '\\.$', '') AS name FROM (SELECT DISTINCT host FROM p)))),
tails AS (SELECT host, k, i AS n, {_LAST.format('i')} AS tail FROM labelled, range(1, {max(r.count('.') for r in SUFFIXES) + 2}) g(i) WHERE i <= k),
longest AS (SELECT host, coalesce(max(CASE WHEN kind = 2 THEN n - 1 END), max(n + (kind = 1)::INT)) AS n FROM tails JOIN (VALUES {_TAILS}) r(tail, kind) USING (tail) WHERE kind <> 1 OR n < k GROUP BY host),
sized AS (SELECT labelled.*, CASE WHEN regexp_matches(name, '^(?:\\[.*|[0-9]+(?:\\.[0-9]+){{3}})$') THEN k ELSE coalesce(n, 1) END AS m FROM labelled LEFT JOIN longest USING (host)),
names AS (SELECT host, {_LAST.format('m')} AS suffix, {_LAST.format('(m + 1)')} AS domain FROM sized)"""
#: P(rate <= THRESHOLD) by 400 steps of the continued fraction, on the side where it converges.
_SIDE = f"""SELECT host, a, b, {THRESHOLD} > (a + 1) / (a + b + 2) AS turned FROM (SELECT host, rate * t AS a, (1 - rate) * t AS b FROM rated)"""
_STEPS = """list_transform(range(1, 401), lambda i: {'step': CASE WHEN i % 2 = 1 THEN ((i + 1) // 2) * (q - (i + 1) // 2) * y / ((p + i) * (p + i + 1)) ELSE -(p + i // 2) * (p + q + i // 2) * y / ((p + i) * (p + i + 1)) END, 'c': 0::DOUBLE, 'd': 0::DOUBLE, 'h': 0::DOUBLE})"""
_FRACTION = f"""list_reduce({_STEPS}, lambda s, x: {{'step': 0::DOUBLE, 'c': 1 + x.step / s.c, 'd': 1 / (1 + x.step * s.d), 'h': s.h * (1 + x.step / s.c) / (1 + x.step * s.d)}},
    {{'step': 0::DOUBLE, 'c': 1::DOUBLE, 'd': 1 / (1 - (p + q) * y / (p + 1)), 'h': 1 / (1 - (p + q) * y / (p + 1))}}).h"""
OP9_SQL = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
known AS (SELECT doc_id, max((coalesce(quality = 0, false) OR coalesce(toxic = 1, false))::INT)::DOUBLE AS bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
counted AS (SELECT host, count(*)::DOUBLE AS n, sum(known.bad) AS bad
  FROM (SELECT host, TRY_CAST(nullif(regexp_extract(path, '/(\\d{{1,18}})(?:[./]|$)', 1), '') AS BIGINT) AS doc_id FROM p) JOIN known USING (doc_id) GROUP BY host),
{_NAMES},
by_host AS (SELECT * FROM counted JOIN names USING (host)),
by_domain AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM by_host GROUP BY ALL),
by_suffix AS (SELECT suffix, 1 AS top, sum(n) AS n, sum(bad) AS bad FROM by_domain GROUP BY ALL),
{_level("tops", "top", "by_suffix")},
{_level("suffixes", "suffix", "by_domain")},
{_level("domains", "domain", "by_host")},
m AS (SELECT host, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(domain_n, 0) AS dn, coalesce(domain_bad, 0) AS db, coalesce(domain_w, {MOST_WEIGHT}) AS dw,
    coalesce(suffix_n, 0) AS sn, coalesce(suffix_bad, 0) AS sb, coalesce(suffix_w, {MOST_WEIGHT}) AS sw, coalesce((SELECT top_w FROM tops), {MOST_WEIGHT}) AS aw,
    coalesce((SELECT top_bad / top_n FROM tops), 0) AS m0
  FROM names LEFT JOIN counted USING (host) LEFT JOIN domains USING (domain) LEFT JOIN suffixes USING (suffix)),
rated AS (SELECT host, (bad + dw * ((db + sw * ((sb + aw * m0) / (sn + aw))) / (dn + sw))) / (n + dw) AS rate, n + dw AS t FROM m),
sides AS (SELECT host, a, b, turned, CASE WHEN turned THEN b ELSE a END AS p, CASE WHEN turned THEN a ELSE b END AS q, CASE WHEN turned THEN 1 - {THRESHOLD} ELSE {THRESHOLD} END AS y FROM ({_SIDE})),
below AS (SELECT host, a, b, turned, exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * ln(y) + q * ln(1 - y)) / p * {_FRACTION} AS side FROM sides WHERE a > 0 AND b > 0),
doubts AS (SELECT host, CASE WHEN s.a <= 0 THEN 1 WHEN s.b <= 0 THEN 0 WHEN s.turned THEN 1 - side ELSE side END AS doubt FROM sides s LEFT JOIN below USING (host))
SELECT page_id, host, path, CASE {_RULES.format(*(r for r, _ in _ORDERED))} END AS rule,
  CASE {_RULES.format(*(v for _, v in _ORDERED))} WHEN doubt < {TAIL} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN doubts USING (host)
"""
