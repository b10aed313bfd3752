"""URL filters: empirical-Bayes host reputation.

Labelled page outcomes are counted for each host, registered domain and public
suffix. Each level's share of bad pages has a beta prior whose mean is the
posterior mean one level up (suffix under the whole table, domain under its
suffix, host under its domain) and whose strength is estimated from the spread of
the level's own counts (beta-binomial moments). A host is blocked when a lower
bound of its posterior share exceeds a limit. Explicit rules come first.

Everything is column expressions and joins on small count tables; the pages
themselves are joined once, on the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.common import LOWER, UPPER
from labelmill.session import materialise

# Host up to the first of / ? #, path up to the first of ? #.
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")

DEFAULT_STRENGTH = 10.0
LEAST_RHO, MOST_RHO = 0.001, 0.999


def host_of(url: Column) -> Column:
    """Host with A-Z lower-cased; empty for a null url or one without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Path without query and fragment; empty for a null url or one without ``://``."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    last, two = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(last)


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label more (the host itself if there is none)."""
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none fits.

    ``rules`` are ``(verdict, host + path)``. A rule fits its host and all subdomains when the path
    starts with the rule's path.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = text.find("/")
        name, start = text[:at], text[at:]
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, parent: list[str]) -> DataFrame:
    """One row: the prior strength (sum of the beta's parameters) of children with counts ``(n, bad)`` under their parents."""
    groups = children.groupBy(*parent).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("b2n"), F.count("*").alias("k"),
    )
    mean = F.col("bad") / F.col("n")
    variance = mean * (1 - mean)
    sums = groups.agg(
        F.sum(F.col("b2n") - F.col("bad") * mean).alias("spread"), F.sum(variance * (F.col("k") - 1)).alias("binomial"),
        F.sum(variance * (F.col("n") - F.col("n2") / F.col("n") - (F.col("k") - 1))).alias("room"),
    )
    rho = F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), (F.col("spread") - F.col("binomial")) / F.col("room")))
    return sums.select(F.when(F.col("room") > 0, (1 - rho) / rho).otherwise(F.lit(DEFAULT_STRENGTH)).alias("strength"))


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior of each host's share of bad pages.

    ``outcomes`` is ``(host string, bad boolean)``, one row per labelled page (rows with a null are not
    outcomes); ``hosts`` is ``(host)``, the hosts to judge, each once. Returns ``(host, domain, suffix, n_labelled,
    n_bad, mean, bound)`` with ``bound = mean - z * deviation`` of the beta posterior. Without any outcome, every
    mean is 0.5. A host never labelled has its domain's or suffix's mean.
    """
    counts = materialise(
        outcomes.filter(F.col("host").isNotNull() & F.col("bad").isNotNull()).groupBy("host")
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col("bad").cast("double")).alias("bad"))
        .select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"),
        "outcomes",
    )
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    overall = suffixes.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).first()
    mean0 = overall["bad"] / overall["n"] if overall["n"] else 0.5
    m_suffix = _strength(suffixes.withColumn("all", F.lit(1)), ["all"]).first()[0]
    m_domain = _strength(domains, ["suffix"]).first()[0]
    m_host = _strength(counts, ["suffix", "domain"]).first()[0]
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    shrunk = lambda k, n, strength, mean: (known(k) + strength * mean) / (known(n) + strength)
    judged = (
        hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"))
        .join(suffixes.select("suffix", F.col("n").alias("n_s"), F.col("bad").alias("b_s")), "suffix", "left")
        .join(domains.select("domain", F.col("n").alias("n_d"), F.col("bad").alias("b_d")), "domain", "left")
        .join(counts.select("host", F.col("n").alias("n_h"), F.col("bad").alias("b_h")), "host", "left")
        .withColumn("mean_s", shrunk("b_s", "n_s", F.lit(m_suffix), F.lit(mean0)))
        .withColumn("mean_d", shrunk("b_d", "n_d", F.lit(m_domain), F.col("mean_s")))
        .withColumn("mean", shrunk("b_h", "n_h", F.lit(m_host), F.col("mean_d")))
    )
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (known("n_h") + F.lit(m_host) + 1))
    return judged.select(
        "host", "domain", "suffix", known("n_h").cast("bigint").alias("n_labelled"), known("b_h").cast("bigint").alias("n_bad"),
        "mean", (F.col("mean") - z * deviation).alias("bound"),
    )


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = (), most_bad: float = 0.3, z: float = 1.645
) -> DataFrame:
    """A verdict for every url.

    ``pages`` needs ``page_id`` and ``url``; other columns are ignored. Returns one row per row of ``pages``:
    ``(page_id, host, path, rule, verdict, n_labelled, mean, bound)``. The verdict is the longest rule's, else
    ``block`` when the bound of the host's posterior share of bad pages exceeds ``most_bad``, else ``allow``. A url
    that is null or has no ``://`` has an empty host and is judged by that host's (rare) outcomes.
    """
    url = F.col("url")
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    # Written, so that both sides of the join on the host are dealt by it and a hot host's pages can be split.
    judged = materialise(reputation(outcomes, parts.select("host").distinct(), z), "reputation")
    rule, verdict = matching_rule(F.col("host"), F.col("path"), list(rules))
    own = F.when(F.col("bound") > most_bad, "block").otherwise("allow")
    return parts.join(judged, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "n_labelled", "mean", "bound"
    )
