"""URL filter by host reputation: beta-binomial shrinkage from suffix to registered domain to host.

Labelled pages (bad or not) are counted per host. The rate of a suffix is shrunk to the overall rate,
that of a registered domain (the last two labels) to its suffix, that of a host to its domain; how
strongly follows from how much the rates differ among the children of one level, estimated from the
data. A host is blocked when the lower bound of its posterior bad rate is above a limit.

Explicit rules (host/path prefixes) come first, the longest that fits. NULL urls and urls without
``://`` have an empty host and path; they are judged as the host "". Hosts without labelled pages get
their domain's prior. Repeated pages are judged one by one; labels that repeat count as bad if any is.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.text import LOWER, UPPER, kept, whole


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    pattern: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.pattern.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


RULES = (
    UrlRule("allow", "org/"),
    UrlRule("block", "example.org/es/"),
    UrlRule("block", "example.org/en/1"),
    UrlRule("allow", "com/fr/"),
    UrlRule("block", "com/de/"),
)
#: A host is blocked when its bad rate is above LIMIT with the certainty of SIGMAS standard deviations.
LIMIT, SIGMAS = 0.25, 1.0
#: Bounds of the correlation between pages of one child, so that the prior's strength stays finite.
LEAST_RHO, MOST_RHO = 0.0001, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def _strength(children: DataFrame, rate: float) -> float:
    """Prior strength of one level by moments: how much more than binomially the children's rates vary."""
    spread = rate * (1 - rate)
    row = children.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - F.lit(rate), F.lit(2))).alias("s"), F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")
    ).first()
    if not row["k"] or row["n"] <= row["k"] or spread <= 0:
        return 1 / MOST_RHO - 1
    rho = (row["s"] / spread - row["k"]) / (row["n"] - row["k"])
    return 1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1


def _placed(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """Hosts with their registered domain and suffix.

    Without a table of suffixes these are the last two labels and the last one. With one (a column ``suffix``,
    such as co.uk), the suffix is the longest of the table that the host ends in, else the last label, and the
    domain has one label more; a port is left aside. Every ending of a host is looked up by an equal join.
    """
    if suffixes is None:
        return hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    names = hosts.select("host", F.regexp_replace("host", ":[0-9]*$", "").alias("name"))
    endings = names.select("host", "name", F.explode(F.sequence(F.lit(1), F.size(F.split("name", "[.]")))).alias("labels"))
    known = suffixes.select(F.translate("suffix", UPPER, LOWER).alias("ending")).distinct()
    found = endings.withColumn("ending", F.expr("substring_index(name, '.', -labels)")).join(known, "ending")
    longest = found.groupBy("host").agg(F.max("labels").alias("labels"))
    placed = names.join(longest, "host", "left").withColumn("labels", F.coalesce("labels", F.lit(1)))
    ending = lambda more: F.expr(f"substring_index(name, '.', -(labels + {more}))")
    return hosts.join(placed.select("host", ending(1).alias("domain"), ending(0).alias("suffix")), "host")


def reputations(pages: DataFrame, limit: float = LIMIT, sigmas: float = SIGMAS, suffixes: DataFrame | None = None) -> DataFrame:
    """Hosts with (n, bad, rate, low, verdict) from pages (host, bad), where bad is NULL if the page has no label.

    ``suffixes`` is an optional table of public suffixes; see ``_placed``.
    """
    counted = F.sum(F.when(F.col("bad").isNotNull(), 1).otherwise(0)).alias("n")
    hosts = kept(pages.groupBy("host").agg(counted, F.sum(F.coalesce(F.col("bad").cast("bigint"), F.lit(0))).alias("bad")), "hosts")
    hosts = _placed(hosts, suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = (total["bad"] + 1.0) / (total["n"] + 2.0)
    ks, kd, kh = (_strength(level, rate) for level in (tops, domains, hosts))
    tops = tops.select("suffix", ((F.col("bad") + F.lit(ks) * rate) / (F.col("n") + F.lit(ks))).alias("suffix_rate"))
    domains = domains.join(tops, "suffix").select("domain", ((F.col("bad") + F.lit(kd) * F.col("suffix_rate")) / (F.col("n") + F.lit(kd))).alias("domain_rate"))
    alpha = F.col("bad") + F.lit(kh) * F.col("domain_rate")
    both = F.col("n") + F.lit(kh)
    mean = alpha / both
    low = mean - F.lit(sigmas) * F.sqrt(mean * (1 - mean) / (both + 1))
    judged = hosts.join(domains, "domain").select("host", "n", "bad", mean.alias("rate"), low.alias("low"))
    return kept(judged.withColumn("verdict", F.when(F.col("low") > limit, "block").otherwise("allow")), "reputations")


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[UrlRule] = RULES, limit: float = LIMIT, sigmas: float = SIGMAS, suffixes: DataFrame | None = None) -> DataFrame:
    """Pages (page_id, url) with host, path, rule and verdict; outcomes are (page_id, bad); ``suffixes`` as for ``reputations``."""
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = outcomes.where("page_id is not null").groupBy(F.col("page_id").alias("_page_id")).agg(F.max(F.col("bad").cast("int")).alias("bad"))
    hosts = reputations(parts.join(known, F.col("page_id") == F.col("_page_id"), "left").select("host", "bad"), limit, sigmas, suffixes)
    rule = F.lit(None).cast("string")
    verdict = F.col("_verdict")
    for r in sorted(rules, key=lambda r: len(r.pattern)):
        rule = F.when(r.fits(F.col("host"), F.col("path")), r.pattern).otherwise(rule)
        verdict = F.when(r.fits(F.col("host"), F.col("path")), r.verdict).otherwise(verdict)
    named = hosts.select(F.col("host").alias("_host"), F.col("verdict").alias("_verdict"), F.col("low").alias("bad_rate_low"))
    joined = parts.join(named, F.col("host") == F.col("_host"), "left")
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
