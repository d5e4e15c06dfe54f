"""URL filter by empirical-Bayes host reputation, with explicit rules on top. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (rule, verdict): a host and its subdomains, then the start of a path; the longest rule that fits wins.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Labels that together with a country's two letters make one public suffix.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")


@dataclass(frozen=True)
class ReputationConfig:
    """A host is blocked if, by its posterior, its share of bad pages exceeds ``limit`` with a chance of ``sure`` at least.
    ``strength``: bounds of the pages that a level's prior counts for, which is estimated; ``root``: share and weight
    in pages of the prior above all suffixes. ``nodes``: points of the integral over the posterior."""

    limit: float = 0.5
    sure: float = 0.95
    strength: tuple[float, float] = (1.0, 1000.0)
    root: tuple[float, float] = (0.1, 10.0)
    nodes: int = 512


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or lacks ``://``."""
    # (?s) lets a dot match line ends: a url is taken as it stands
    after = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(after, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix: the last label is the suffix, or the last two if they are one of ``SECOND`` under two letters."""
    two = F.substring_index(host, ".", -2)
    long = two.rlike(rf"^({'|'.join(SECOND)})\.[a-z]{{2}}\z") & (host != two)
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(two), F.when(long, two).otherwise(F.substring_index(host, ".", -1))


def _strength(units: DataFrame, cfg: ReputationConfig) -> float:
    """Pages that a prior counts for, by moments: (n, k, p) are outcomes, bad ones and the parent's share.

    Shares of n pages scatter about p by p (1 - p) (1 + (n - 1) r) / n; the prior counts for 1 / r - 1.
    """
    flat = F.col("p") * (1 - F.col("p"))
    r = units.filter("n > 0").agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), F.lit(2)) - flat).alias("over"), F.sum((F.col("n") - 1) * flat).alias("room")).first()
    low, high = cfg.strength
    if not r.over or not r.room or r.over <= 0:
        return high
    return min(high, max(low, r.room / r.over - 1))


def host_reputation(outcomes: DataFrame, cfg: ReputationConfig = ReputationConfig()) -> DataFrame:
    """(host, mean, below) from (host, bad): beta-binomial shrinkage suffix <- root, domain <- suffix, host <- domain.

    ``bad`` is 0, 1 or null. Each level's posterior mean is the prior mean of the one below; how many pages a prior counts for is estimated
    for each level from how its shares scatter. ``below`` is the posterior's chance that the share is at most ``limit``.
    """
    tmp = Scratch(outcomes.sparkSession, "hosts")
    hosts = outcomes.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("k"))
    domain, suffix = levels(F.col("host"))
    hosts = tmp.save(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")  # read for each level
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    p0 = ((total.k or 0.0) + cfg.root[0] * cfg.root[1]) / ((total.n or 0.0) + cfg.root[1])

    def shrunk(units: DataFrame) -> DataFrame:
        s = _strength(units, cfg)
        return units.withColumn("a", F.col("k") + F.col("p") * s).withColumn("b", F.col("n") - F.col("k") + (1 - F.col("p")) * s)

    mean = F.col("a") / (F.col("a") + F.col("b"))
    summed = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = shrunk(summed("suffix").withColumn("p", F.lit(p0))).select("suffix", mean.alias("p"))
    domains = shrunk(summed("domain", "suffix").join(suffixes, "suffix")).select("domain", mean.alias("p"))
    out = shrunk(hosts.join(domains, "domain"))
    # sine squared of the nodes is the share, so that the posterior has no steep end
    at = f"(j + 0.5) * pi() / {2 * cfg.nodes}"
    logs = F.expr(f"transform(sequence(0, {cfg.nodes - 1}), j -> (2 * a - 1) * ln(sin({at})) + (2 * b - 1) * ln(cos({at})))")
    mass = F.expr("transform(logs, x -> exp(x - array_max(logs)))")
    share = F.expr("aggregate(mass, double(0), (s, x) -> s + x)")
    low = F.expr(f"aggregate(transform(mass, (x, j) -> if(pow(sin({at}), 2) <= {cfg.limit}, x, double(0))), double(0), (s, x) -> s + x)")
    return out.withColumn("logs", logs).withColumn("mass", mass).select("host", mean.alias("mean"), (low / share).alias("below"))


def judge_urls(pages: DataFrame, labels: DataFrame, cfg: ReputationConfig = ReputationConfig(), rules=RULES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): host, path, rule, verdict, bad_share, below.

    ``labels`` (doc_id, quality) judge the pages of these ids: quality 0 is a bad outcome. Outcomes of null
    quality or id don't count, of a page labelled more than once each counts, and a host without outcomes takes its
    domain's or suffix's prior. A null url has host and path empty and counts for the empty host.
    Hosts are few against pages: they are joined as per-host counts, and a hot host is counted before it is dealt out.
    """
    host, path = split_url(F.col("url"))
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 0).cast("int").alias("bad")).filter("_id is not null and bad is not null")
    seen = pages.join(bad, F.col("page_id").cast("long") == F.col("_id"), "left").select("host", "bad")
    known = host_reputation(seen, cfg).withColumnRenamed("host", "_host")
    out = pages.join(known, F.col("host") == F.col("_host"), "left")
    method = F.when(F.col("below") <= 1 - cfg.sure, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), F.col("mean").alias("bad_share"), "below")
