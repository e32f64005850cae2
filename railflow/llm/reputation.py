"""URL filters (11): rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted per host. The bad rate of a host has a beta prior whose mean is the posterior
mean of its registered domain, which in turn is shrunk towards its public suffix, and that towards all outcomes. How
strongly a level is shrunk is read off the data: the over-dispersion of its nodes' rates around their parents' means, beyond
what binomial noise explains, gives the strength of the level's beta-binomial prior (moments, one aggregate per
level). A host is blocked when its posterior holds, with probability ``confidence``, that more than ``limit`` of its pages
are bad; a host without outcomes has its domain's (or suffix's) prior and is judged alike.

Rules name a host, all its subdomains with it, and the beginning of a path; the longest rule that fits decides, and a page
without a rule takes its host's verdict. Pages are judged by distinct (host, beginning of the path): rules meet those in hash joins
on (suffix of the host, beginning of the path), for the few lengths that the rules of that suffix have. Only counts per host, domain and
suffix are shuffled, after a partial aggregate; three numbers a level go through the driver.

Defined cases: a null URL, or one without ``://``, has an empty host and path; outcomes with a null verdict, or without a
host, are not counted; without any outcomes no host is blocked; of two equal rules that disagree ``block`` holds; repeated pages
give equal rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railflow.staging import stage

LIMIT = 0.5
CONFIDENCE = 0.95
WEAKEST, STRONGEST = 1.0, 1e3  # bounds of a prior's strength, in pages
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public suffixes of more than one label in common use.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "com.cn", "com.hk", "com.tw",
    "com.sg", "co.in", "co.za", "com.tr", "com.br", "com.ar", "com.mx", "blogspot.com", "github.io",
)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _last(labels: Column, n: int) -> Column:
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), F.lit(n)), ".")


def with_domains(hosts: DataFrame, suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """Add ``domain`` (registered) and ``suffix`` of ``host``; user names and ports don't count, an IP address is its own domain."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(name, "\\.")
    wide = _last(labels, 2).isin(list(suffixes))
    address = name.rlike("^[0-9.]+$") | name.startswith("[")
    return hosts.withColumn("domain", F.when(address, name).when(wide, _last(labels, 3)).otherwise(_last(labels, 2))).withColumn(
        "suffix", F.when(address, F.lit("")).when(wide, _last(labels, 2)).otherwise(_last(labels, 1))
    )


def _strength(nodes: DataFrame) -> float:
    """Strength of the prior of a level from its nodes' ``n``, ``bad`` and parent mean ``mean``: moments of the beta-binomial."""
    spread = F.pow(F.col("bad") / F.col("n") - F.col("mean"), 2) / (F.col("mean") * (1 - F.col("mean")))
    got = nodes.filter("n > 0 and mean > 0 and mean < 1").agg(
        F.sum(F.col("n") * spread - 1).alias("above"), F.sum(F.col("n") - 1).alias("pairs")
    ).first()
    if not got["pairs"]:
        return WEAKEST
    overlap = got["above"] / got["pairs"]  # correlation of two outcomes of one node
    return min(max(1 / overlap - 1, WEAKEST), STRONGEST) if overlap > 0 else STRONGEST


def _shrunk(nodes: DataFrame, strength: float) -> Column:
    return (F.col("mean") * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))


def beta_tail(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """Probability that a beta(a, b) variable is above ``x`` (regularised incomplete beta function, continued fraction)."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    turned = x > (a + 1) / (a + b + 2)  # there the other tail converges
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log = np.array([math.lgamma(s + t) - math.lgamma(s) - math.lgamma(t) for s, t in zip(p.tolist(), q.tolist(), strict=True)])
    front = np.exp(log + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c = np.ones(len(p))
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for k in range(1, 100_000):
        changed = np.zeros(len(p))
        for term in (k * (q - k) * z / ((p + 2 * k - 1) * (p + 2 * k)), -(p + k) * (p + q + k) * z / ((p + 2 * k) * (p + 2 * k + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total *= c * d
            changed = np.maximum(changed, np.abs(c * d - 1))
        if not len(changed) or changed.max() < 1e-14:
            break
    below = front * total
    return np.where(turned, below, 1 - below)


def reputations(
    outcomes: DataFrame, hosts: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE, suffixes: Iterable[str] = SUFFIXES
) -> DataFrame:
    """Posterior of every host of ``hosts`` (``host``): ``n`` and ``bad`` outcomes, beta parameters ``alpha`` and ``beta``,
    ``p_bad`` (probability that its bad rate is above ``limit``) and ``blocked``. ``outcomes``: ``host``, ``is_bad`` (boolean)."""
    seen = outcomes.filter("host <> '' and is_bad is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bad").cast("bigint")).alias("bad")
    )
    known = stage(with_domains(seen, suffixes), "host-outcomes")
    total = known.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    root = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    by_suffix = known.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(root))
    of_suffix = stage(by_suffix.select("suffix", _shrunk(by_suffix, _strength(by_suffix)).alias("mean")), "suffix-means")
    by_domain = known.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(of_suffix, "suffix")
    of_domain = stage(by_domain.select("domain", _shrunk(by_domain, _strength(by_domain)).alias("mean")), "domain-means")
    strength = _strength(known.join(of_domain, "domain"))

    every = with_domains(hosts.select("host").distinct(), suffixes).join(known.select("host", "n", "bad"), "host", "left")
    prior = every.join(of_domain.withColumnRenamed("mean", "_d"), "domain", "left").join(of_suffix.withColumnRenamed("mean", "_s"), "suffix", "left")
    mean = F.coalesce("_d", "_s", F.lit(root))
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    posterior = prior.select("host", n.alias("n"), bad.alias("bad"), (mean * strength + bad).alias("alpha"), ((1 - mean) * strength + n - bad).alias("beta"))

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(p_bad=beta_tail(rows["alpha"].to_numpy(), rows["beta"].to_numpy(), limit))

    judged = posterior.mapInPandas(tails, "host string, n bigint, bad bigint, alpha double, beta double, p_bad double")
    enough = F.lit(bool(total["n"])) & (F.col("p_bad") >= confidence)
    return judged.withColumn("blocked", enough & (F.col("host") != ""))


def fitting_rules(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """The longest rule that fits each of the ``keys`` (``host``, ``head``: the beginning of the path), where there is one:
    ``host``, ``head``, ``rule``, ``verdict``. ``rules``: ``host``, ``path``, ``verdict`` (allow or block)."""
    own = rules.groupBy(F.col("host").alias("_name"), F.col("path").alias("_start")).agg(F.max("verdict").alias("verdict"))
    own = stage(own, "rules")
    labels = own.agg(F.max(F.size(F.split("_name", "\\.")))).first()[0] or 0
    lengths = own.select("_name", F.length("_start").alias("_length")).distinct()
    parts = F.split("host", "\\.")
    names = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(labels, 1)))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    tried = keys.select("host", "head", F.explode(names).alias("_name")).join(lengths, "_name").filter(F.length("head") >= F.col("_length"))
    met = tried.withColumn("_start", F.expr("substring(head, 1, _length)")).join(own, ["_name", "_start"])
    rule = F.concat("_name", "_start")
    longest = F.max(F.struct(F.length(rule).alias("length"), "verdict", rule.alias("rule"))).alias("_best")
    return met.groupBy("host", "head").agg(longest).select("host", "head", "_best.rule", "_best.verdict")


def judge(
    pages: DataFrame, rules: DataFrame, outcomes: DataFrame, limit: float = LIMIT, confidence: float = CONFIDENCE, suffixes: Iterable[str] = SUFFIXES
) -> DataFrame:
    """All columns of ``pages`` in the struct ``page``, with ``host``, ``path``, ``rule`` (or null) and ``verdict``. ``outcomes``:
    ``url``, ``is_bad``."""
    width = rules.agg(F.max(F.length("path"))).first()[0] or 0
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"))
    url = F.col("page.url")
    own = own.select("page", host(url).alias("host"), path(url).alias("path")).withColumn("head", F.substring("path", 1, width))
    keys = stage(own.select("host", "head").distinct(), "url-keys")
    known = reputations(outcomes.select(host(F.col("url")).alias("host"), "is_bad"), keys, limit, confidence, suffixes)
    by_host = known.select("host", F.when(F.col("blocked"), "block").otherwise("allow").alias("_own"))
    verdicts = keys.join(fitting_rules(keys, rules), ["host", "head"], "left").join(by_host, "host")
    verdicts = stage(verdicts.select("host", "head", "rule", F.coalesce("verdict", "_own").alias("verdict")), "url-verdicts")
    return own.join(verdicts, ["host", "head"]).select("page", "host", "path", "rule", "verdict")


#: The rules that the contract fixes: host, path, verdict.
CONTRACT_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``is_bad`` of the labelled pages: a label belongs to the page of its number; low quality or toxic is bad."""
    bad = (F.coalesce(F.min("quality"), F.lit(1)) == 0) | (F.coalesce(F.max("toxic"), F.lit(0)) == 1)
    own = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(bad.alias("is_bad"))
    return pages.select("page_id", "url").join(own, "page_id").select("url", "is_bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row per page."""
    own = pages.select("page_id", "url")
    judged = judge(own, rules_table(pages.sparkSession, CONTRACT_RULES), page_outcomes(own, labels))
    return judged.select("page.page_id", "host", "path", "rule", "verdict")
