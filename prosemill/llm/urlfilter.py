"""URL filters with empirical-Bayes host reputation, in DataFrame functions only.

Labelled outcomes of pages (bad or not) are counted per host, per registered
domain and per suffix. Each level's rate is shrunk to the level above by a
beta-binomial prior whose strength is estimated from the spread between the
groups of that level about their parents' rates (moments), so a host with few
outcomes takes the rate of its domain and a domain with few the rate of its
suffix. A host is blocked when the lower bound of its posterior bad rate is over
the limit. Explicit rules come first; the longest fitting one wins.

Scale: one row per host leaves the map side; hot hosts are pre-aggregated, and
pages meet their host's verdict in a join whose hot keys can be split. The host
counts are written once and read again by all levels. Only sums of whole levels
(a dozen numbers) go to the driver.

Defined results: a null url or one without `://` has empty host and path and is
judged as the empty host; a page without an outcome counts nowhere; repeated
rows repeat and count repeatedly; a null page id has no outcome; a page with
differing outcomes is bad; without any outcome the bad rate is 0.5 with a bound
under the limit, so nothing is blocked by the method; other columns of the pages,
whatever their names, are not read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Action, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Public suffixes of two labels.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "ac.jp", "go.jp", "com.br", "com.cn", "com.mx", "co.in", "co.kr", "co.za")


@dataclass(frozen=True)
class ReputationRules:
    #: Largest lower bound of the bad rate that is let through.
    max_bad: float = 0.3
    #: Standard deviations between the posterior mean and its bound.
    width: float = 1.645
    #: Bounds of the estimated prior strengths, in outcomes.
    min_strength: float = 2.0
    max_strength: float = 1000.0


def _rest(url: Column) -> Column:
    """What stands after the first `://`; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    """Outcomes of the groups in ``rows`` under each parent, and what the moments of their rates need."""
    n, k = F.col("n"), F.col("k")
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.count_if(n > 0).alias("g"), F.coalesce(F.sum(n * n), F.lit(0)).alias("nn"), F.coalesce(F.sum(F.when(n > 0, k * k / n)), F.lit(0.0)).alias("kk")
    )


def _strength(parents: DataFrame, rules: ReputationRules) -> float:
    """Prior strength of a level by beta-binomial moments about each parent's own rate, from the sums of ``_sums``."""
    p = F.col("k") / F.col("n")
    spread, free = F.col("kk") - F.col("k") * p, F.col("g") - 1
    s = parents.filter("n > 0 and g > 1").agg(F.sum(spread - p * (1 - p) * free).alias("excess"), F.sum(p * (1 - p) * (F.col("n") - F.col("nn") / F.col("n") - free)).alias("room")).first()
    if not s.room or s.room <= 0 or s.excess <= 0:
        return rules.max_strength
    return min(max(s.room / s.excess - 1, rules.min_strength), rules.max_strength)


def _shrunk(single, n, k, strength: float, mean, weight) -> tuple[Column, Column]:
    """Mean and weight of a group: its outcomes and, up to ``strength``, the parent's evidence other than them; an only group takes the parent's."""
    prior = F.least(F.lit(strength), weight - n)
    return F.when(single, mean).otherwise((k + prior * mean) / (n + prior)), F.when(single, weight).otherwise(n + prior)


def host_reputation(hosts: DataFrame, rules: ReputationRules | None = None) -> DataFrame:
    """From (host, n outcomes, k bad) to host, posterior ``mean`` and ``bound`` of the bad rate.

    The strength of each level is estimated about the rates of its parents: hosts
    within domains, domains within suffixes, suffixes within the whole. A prior
    never weighs more than the outcomes behind it that are not the group's own, so
    one outcome cannot speak for its host, its domain and its suffix in turn.
    """
    rules = rules or ReputationRules()
    hosts = hosts.select("host", "n", "k", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
    domains = _sums(hosts, "suffix", "domain")
    suffixes = _sums(domains, "suffix")
    total = _sums(suffixes)
    c, b, a = (_strength(x, rules) for x in (domains, suffixes, total))
    t = total.first()
    base, everything = F.lit((t.k + 1) / (t.n + 2)), F.lit(float(t.n + 2))
    n, k = F.col("n"), F.col("k")
    mean, weight = _shrunk((n > 0) & F.lit(t.g == 1), n, k, a, base, everything)
    suffixes = suffixes.select("suffix", F.col("g").alias("suffix_g"), mean.alias("suffix_mean"), weight.alias("suffix_weight"))
    mean, weight = _shrunk((n > 0) & (F.col("suffix_g") == 1), n, k, b, F.col("suffix_mean"), F.col("suffix_weight"))
    domains = domains.join(suffixes, "suffix").select("domain", F.col("g").alias("domain_g"), mean.alias("domain_mean"), weight.alias("domain_weight"))
    mean, weight = _shrunk((n > 0) & (F.col("domain_g") == 1), n, k, c, F.col("domain_mean"), F.col("domain_weight"))
    found = hosts.join(domains, "domain").select("host", mean.alias("mean"), weight.alias("weight"))
    return found.select("host", "mean", (F.col("mean") - rules.width * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, page_col: str = "page_id", url_col: str = "url", rules=RULES, reputation: ReputationRules | None = None) -> DataFrame:
    """Per page: id, ``host``, ``path``, the fitting ``rule``, ``verdict``, and the host's ``mean`` and ``bound``.

    ``outcomes`` has the columns page and bad (boolean), in this order.
    """
    reputation = reputation or ReputationRules()
    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(page_col).alias("__page"), host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.select(F.col(outcomes.columns[0]).alias("__page"), F.col(outcomes.columns[1]).cast("boolean").alias("__bad")).filter("__bad is not null").groupBy("__page").agg(F.max("__bad").alias("__bad"))
    hosts = seen.select("__page", "host").join(known, "__page", "left").groupBy("host").agg(F.count("__bad").alias("n"), F.count_if("__bad").alias("k"))
    judged = host_reputation(written(hosts, "hosts"), reputation)
    rule = verdict = None
    for r in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule = F.when(fits, F.lit(r[1] + r[2])) if rule is None else rule.when(fits, F.lit(r[1] + r[2]))
        verdict = F.when(fits, F.lit(r[0])) if verdict is None else verdict.when(fits, F.lit(r[0]))
    own = F.when(F.coalesce(F.col("bound") > reputation.max_bad, F.lit(False)), "block").otherwise("allow")
    return seen.join(judged, "host", "left").select(
        F.col("__page").alias(page_col),
        "host",
        "path",
        (F.lit(None).cast("string") if rule is None else rule).alias("rule"),
        (own if verdict is None else verdict.otherwise(own)).alias("verdict"),
        "mean",
        "bound",
    )
