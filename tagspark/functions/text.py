"""String expressions: key trimming, blanks, shown numbers."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_all(c) -> Column:
    """Strip every kind of white space; `trim` alone strips spaces only."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key(c) -> Column:
    """A join key: stripped, a missing value read as the empty string."""
    return F.coalesce(trim_all(c), F.lit(""))


def filled(c) -> Column:
    """The stripped value, null where nothing is left."""
    t = trim_all(c)
    return F.when(t != "", t)


def percent_shown(rate) -> Column:
    """A 0-1 rate as a whole percentage, halves up; a real but tiny rate is never 0%, a near-total one never 100%."""
    pct = F.round(rate * 100, 0).cast("bigint")
    return (
        F.when(rate.isNull(), F.lit(None).cast("string"))
        .when((pct == 0) & (rate > 0), "<1%")
        .when((pct == 100) & (rate < 1), ">99%")
        .otherwise(F.concat(pct.cast("string"), F.lit("%")))
    )


def grouped_digits(c) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(c, 0)


def natural_key(text: str) -> list:
    """Sort key for column headings: digits compare as numbers, case is ignored."""
    return [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in re.split(r"(\d+)", text.casefold()) if p]


def counted(n: Column, noun: str) -> Column:
    """`1 sample`, `2 samples`."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))
