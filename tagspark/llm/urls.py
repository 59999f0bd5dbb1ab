"""URL filter: rules for hosts, and the empirical-Bayes reputation of hosts that no rule names.

A labelled page is good or bad. The share of bad pages of a suffix, a registered domain and a host is a beta-binomial
posterior each, whose prior is the level above: the corpus for suffixes, the suffix for domains, the domain for hosts.
Prior strengths are fitted to all groups of a level by moments, so a level whose members differ little shrinks
them much. A page is blocked where the lower bound of its host's posterior is over the limit: few labels never block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..sources.sinks import stage
from .rows import pick

#: Fixed values: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Second labels that belong to the suffix where a two-letter country label follows.
SECOND_LABELS = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Blocked where the share of bad pages is over LIMIT by DEVIATIONS standard deviations of its posterior.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of a fitted prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def split_url(pages: DataFrame) -> DataFrame:
    """`pages` (with url) and host (A-Z lowered) and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    rows = pages.withColumn("_rest", F.coalesce(rest, F.lit("")))
    host = F.regexp_extract("_rest", r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return rows.withColumns({"host": lowered, "path": F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1)}).drop("_rest")


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as `host/path`, and its verdict; nulls where none does. Equal lengths: name order."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def levels(rows: DataFrame) -> DataFrame:
    """With suffix and domain of `host`: the last label, or two where a second label and a country follow, and one more."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    double = (n >= 3) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, F.when(n >= 2, F.lit(-2)).otherwise(F.lit(-1))).isin(SECOND_LABELS)
    size = F.when(double, F.lit(2)).otherwise(F.lit(1))
    tail = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    return rows.withColumns({"suffix": tail(size), "domain": tail(size + 1)})


def shrunk(groups: DataFrame, key: str, above: DataFrame | dict, up: str | None = None) -> DataFrame:
    """(key, mean, strength, n, bad): posterior of each group's bad share under the prior of the group above it.

    `groups` has key, up, n, bad; `above` has up, mean and strength (or is the one that all groups have, by name), and
    gives each group the posterior of all its other members. The prior is as strong as the spread of this level's shares beyond that of draws allows, by
    moments, and no stronger than what it was learned from.
    """
    if isinstance(above, dict):
        met = groups.withColumns({f"_{c}": F.lit(above[c]) for c in ("mean", "strength")})
    else:
        met = lookup(groups, above.select(up, *[F.col(c).alias(f"_{c}") for c in ("mean", "strength")]), [up], "inner")
    left = F.greatest(F.col("_strength") - F.col("n"), F.lit(WEAKEST))
    met = met.withColumn("_left", left).withColumn("_prior", F.greatest(F.col("_mean") * F.col("_strength") - F.col("bad"), F.lit(0.0)) / F.col("_left"))
    met = met.withColumn("_prior", F.least(F.greatest("_prior", F.lit(1e-4)), F.lit(1 - 1e-4)))
    spread = met.agg(
        F.sum((F.col("bad") / F.col("n") - F.col("_prior")) ** 2 * F.col("n")).alias("seen"),
        F.sum(F.col("_prior") * (1 - F.col("_prior"))).alias("drawn"),
        F.sum((F.col("n") - 1) * F.col("_prior") * (1 - F.col("_prior"))).alias("more"),
    ).first()
    seen, drawn, more = (spread[k] or 0.0 for k in ("seen", "drawn", "more"))
    # the mean of seen is drawn + more * rho, where rho = 1 / (strength + 1)
    rho = (seen - drawn) / more if more > 0 else 0.0
    fitted = min(max(1.0 / rho - 1.0 if rho > 0 else STRONGEST, WEAKEST), STRONGEST)
    strength = F.least(F.lit(fitted), F.col("_left"))
    mean = (F.col("_prior") * strength + F.col("bad")) / (strength + F.col("n"))
    return met.select(key, mean.alias("mean"), (strength + F.col("n")).alias("strength"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> dict[str, DataFrame]:
    """By level, (name, mean, strength) of all labelled hosts, domains and suffixes.

    `pages` has page_id and host, `outcomes` page_id and bad (0 or 1); without outcomes no level has rows. The
    corpus's own share starts from one good and one bad page. A page counts once for each host that it stands with, however
    often its row or its outcome is repeated; outcomes that differ make it bad.
    """
    once = outcomes.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    labelled = pages.filter("host <> ''").select("page_id", "host").distinct().join(once, "page_id")
    hosts = stage(levels(labelled.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    corpus = {"mean": (whole["bad"] + 1) / (whole["n"] + 2), "strength": float(whole["n"] + 2)}
    of_suffix = stage(shrunk(suffixes, "suffix", corpus), "suffixes")
    of_domain = stage(shrunk(domains, "domain", of_suffix, "suffix"), "domains")
    return {"host": stage(shrunk(hosts, "host", of_domain, "domain"), "reputations"), "domain": of_domain, "suffix": of_suffix}


def bound(mean: Column, strength: Column, deviations: float = DEVIATIONS) -> Column:
    """The lower bound of a beta posterior, by its mean and variance."""
    return F.greatest(mean - deviations * F.sqrt(mean * (1 - mean) / (strength + 1)), F.lit(0.0))


def judged(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, deviations: float = DEVIATIONS) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_share, bad_bound) of every row of `pages` (page_id, url).

    A rule decides where one fits. Else the host's reputation does, or that of its domain or suffix for a host without
    labels; pages of hosts without any, and urls without a host, are allowed. `outcomes`: (page_id, bad).
    """
    rows = split_url(pick(pages, "page_id", "url"))
    known = reputations(rows, pick(outcomes, "page_id", "bad"))
    rows = levels(rows)
    for level, table in known.items():
        side = table.select(F.col(level), F.col("mean").alias(f"_{level}_mean"), F.col("strength").alias(f"_{level}_strength"))
        rows = lookup(rows, side, [level], "left")
    mean = F.coalesce(*[F.col(f"_{k}_mean") for k in known])
    strength = F.coalesce(*[F.col(f"_{k}_strength") for k in known])
    rule, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    low = bound(mean, strength, deviations)
    by_method = F.when(low > limit, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, by_method).alias("verdict"), F.round(mean, 6).alias("bad_share"), F.round(low, 6).alias("bad_bound"))
