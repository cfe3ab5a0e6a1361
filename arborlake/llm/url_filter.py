"""URL filtering: explicit rules first, then the reputation of the host.

Reputation is empirical Bayes over labelled page outcomes. The rate of bad pages is shrunk from
host to registered domain to suffix to all pages, each level by a beta-binomial prior whose
strength is fitted to the spread of that level's rates. A page is blocked when the lower
posterior bound of its host's rate is beyond a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint, join_by_hot_key

#: A rule: host, path prefix, verdict.
Rule = tuple[str, str, str]
DEFAULT_RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both are empty without ``://`` or for null."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    parts = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(parts, r"^[^/?#]*", 0)
    path = F.regexp_extract(parts, r"^[^/?#]*(/[^?#]*)", 1)
    return ascii_lower(host), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none fits.

    A rule fits its host and all subdomains when the path starts with the rule's.
    """
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


#: Labels under which two-letter country suffixes register names, as in co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
_TWO_LABELS = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$"


def registered_domain(host: Column) -> Column:
    """The suffix and the label before it."""
    return F.when(F.regexp_like(host, F.lit(_TWO_LABELS)), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column) -> Column:
    return F.when(F.regexp_like(host, F.lit(_TWO_LABELS)), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _strength(low: float, high: float) -> Column:
    """A prior's weight in pages, by moments of the beta-binomial, from sums over a level.

    A level of g groups can't show that its groups are more alike than g - 1 pages would, so that is the most; where
    the spread can't be told, as for a single group or pages that are all good or all bad, the weakest prior holds.
    """
    p = F.try_divide(F.sum("bad"), F.sum("n"))
    n, k = F.sum("n").cast("double"), F.count(F.lit(1)).cast("double")
    spread = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - n * p * p
    noise = p * (1 - p)
    rho = F.try_divide(spread - noise * (k - 1), noise * (n - F.sum(F.col("n") * F.col("n")).cast("double") / n - (k - 1)))
    fitted = F.try_divide(F.lit(1.0), F.greatest(rho, F.lit(1e-9))) - 1
    return F.coalesce(F.greatest(F.lit(low), F.least(fitted, k - 1, F.lit(high))), F.lit(low))


def _posterior(mean: str, var: str, k: str) -> tuple[Column, Column]:
    """Mean and variance of a group's rate, from its ``n`` pages, ``bad`` ones, and its parent's mean and variance."""
    n, weight = F.col("n"), F.col("n") + F.col(k)
    m = (F.col("bad") + F.col(k) * F.col(mean)) / weight
    return m, m * (1 - m) / (n + F.col(k) + 1) + F.col(k) * F.col(k) / (weight * weight) * F.col(var)


def _told(k: str) -> tuple[Column, Column]:
    """What groups tell their parent: pages of one group tell less the more alike they are, ``k`` + 1 pages' worth at most."""
    share = (F.col(k) + 1) / (F.col("n") + F.col(k))
    return F.sum(F.col("n") * share).alias("n"), F.sum(F.col("bad") * share).alias("bad")


def host_reputation(
    pages: DataFrame,
    outcomes: DataFrame,
    z: float = 1.64,
    weakest: float = 1.0,
    strongest: float = 200.0,
) -> DataFrame:
    """Posterior of the bad-page rate for each host of ``pages``.

    ``pages`` has a column ``host``; ``outcomes`` has ``host`` and ``bad`` (0 or 1). Returns
    ``host``, ``pages`` (how many), ``n`` and ``bad`` (outcomes), ``rate`` (posterior mean), ``low`` and ``high`` (bounds, ``z``
    posterior deviations from the mean). All pages have a uniform prior. A host without outcomes has its domain's
    rate; a domain without outcomes its suffix's; without any outcome the rate is a half. Each level adds to the
    variance what it hasn't seen itself and what its parent's rate leaves open, so bounds widen from level to level
    where there are no outcomes; and the pages of one host, alike as they are, tell its domain little, so a bad host doesn't
    condemn its suffix.

    Counts are summed per host in each task before they are shuffled, and all later levels are
    sums over hosts, so a host with a third of all pages is one row per task.
    """
    by_host = (
        pages.select("host", F.lit(1).alias("pages"), F.lit(0).alias("n"), F.lit(0).alias("bad"))
        .unionByName(outcomes.select("host", F.lit(0).alias("pages"), F.lit(1).alias("n"), F.col("bad").cast("int").alias("bad")))
        .groupBy("host")
        .agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    by_host = checkpoint(
        by_host.select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "pages", "n", "bad")
    )
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # one row: broadcast
    strengths = [
        level.where("n > 0").agg(_strength(weakest, strongest).alias(name))
        for level, name in ((by_host, "k_host"), (by_domain, "k_domain"), (by_suffix, "k_suffix"))
    ]
    fitted = F.broadcast(checkpoint(strengths[0].join(F.broadcast(strengths[1])).join(F.broadcast(strengths[2]))))
    domains = by_host.join(fitted).groupBy("domain", "suffix", "k_domain", "k_suffix").agg(*_told("k_host"))
    suffixes = domains.groupBy("suffix", "k_suffix").agg(*_told("k_domain"))
    n0 = F.coalesce(F.sum("n"), F.lit(0)) + 2.0
    root = suffixes.agg(*_told("k_suffix")).agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1.0) / n0).alias("m0"), n0.alias("n0"))
    root = root.select("m0", (F.col("m0") * (1 - F.col("m0")) / (F.col("n0") + 1)).alias("v0"))
    m, v = _posterior("m0", "v0", "k_suffix")
    suffixes = suffixes.join(F.broadcast(root)).select("suffix", m.alias("m1"), v.alias("v1"))
    m, v = _posterior("m1", "v1", "k_domain")
    domains = domains.join(suffixes, "suffix").select("domain", m.alias("m2"), v.alias("v2"))
    m, v = _posterior("m2", "v2", "k_host")
    hosts = by_host.join(domains, "domain").join(fitted).select("host", "pages", "n", "bad", m.alias("rate"), v.alias("var"))
    half = F.lit(z) * F.sqrt("var")
    low, high = F.greatest(F.lit(0.0), F.col("rate") - half), F.least(F.lit(1.0), F.col("rate") + half)
    return hosts.select("host", "pages", "n", "bad", "rate", low.alias("low"), high.alias("high"))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = DEFAULT_RULES,
    outcomes: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every url: ``page_id, host, path, rule, verdict`` and ``bad_rate, bad_low``.

    The longest rule that fits decides. Where none fits, the page is blocked when the lower
    posterior bound of its host's bad-page rate exceeds ``threshold``. ``outcomes`` (``host``,
    ``bad``) are the labelled pages; by default these are the pages that a rule decides. Null or
    odd urls have an empty host, which is judged like any other. Repeated rows stay. Other
    columns are ignored. The pages of a host with a thousandth of all pages or more aren't shuffled.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, told = rule_for(F.col("host"), F.col("path"), rules)
    judged = checkpoint(parsed.withColumns({"rule": rule, "told": told}))
    if outcomes is None:
        outcomes = judged.where("told is not null").select("host", (F.col("told") == "block").cast("int").alias("bad"))
    reputation = checkpoint(host_reputation(judged, outcomes).select("host", "pages", "rate", "low").where("pages > 0"))
    return join_by_hot_key(judged, reputation, ["host"], "pages").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("told", F.when(F.col("low") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("rate").alias("bad_rate"),
        F.col("low").alias("bad_low"),
    )
