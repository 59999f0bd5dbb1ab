"""The specificity score and the count a cutoff asks for.

The score of a count n against a reference r is 100 * (1 - I_x(n + 1, r + 3)) with x = 0.925. For whole n
that is the distribution function of a negative binomial with size r + 3, so the smallest n reaching a cutoff
is that distribution's quantile: one running sum finds it, also where r is a fractional median.

A score's work does not grow with the reference: past TABLE_SIZE it is a quadrature of a fixed number of points.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import terms as t

SEARCH_CEILING = 1 << 30
TABLE_SIZE = 512
NODES = 40  # of the quadrature of a far score
REACH = 40  # spreads from the mean beyond which a double holds nothing of the distribution
UNREACHED = (1 << 63) - 1  # stands where no count reaches the cutoff
# the best score a zero count can reach; at or below it silent cells cannot be counted by arithmetic
ZERO_COUNT_SCORE = 100.0 * (1.0 - t.BETA_X) ** t.BETA_B


def count_to_reach(cutoff: float, reference: float) -> int | None:
    """Smallest count whose score against `reference` reaches `cutoff`; None where no count to SEARCH_CEILING does."""
    if cutoff >= 100.0:
        return None
    b = float(reference) + t.BETA_B
    target = cutoff / 100.0
    mean, spread = b * t.BETA_X / (1 - t.BETA_X), math.sqrt(b * t.BETA_X) / (1 - t.BETA_X)
    first = max(0, int(mean - REACH * spread))
    if first > SEARCH_CEILING:
        return None
    j = np.arange(first, int(mean + REACH * spread) + REACH, dtype=float)
    steps = np.log((b + j[:-1]) / (j[:-1] + 1.0)) + math.log(t.BETA_X)
    log_mass = np.concatenate([[0.0], np.cumsum(steps)])
    mass = np.exp(log_mass - log_mass.max())
    mass /= mass.sum()
    # the smaller side is summed from its thin end, so a cutoff next to 100 is not lost in rounding
    reached = np.cumsum(mass) >= target if target <= 0.5 else np.cumsum(mass[::-1])[::-1] - mass <= 1.0 - target
    found = first + int(np.argmax(reached))
    return found if found <= SEARCH_CEILING else None


@functools.lru_cache(maxsize=32)
def needed_counts(cutoff: float, size: int = TABLE_SIZE) -> tuple:
    """`count_to_reach` for every whole reference below `size`."""
    return tuple(count_to_reach(cutoff, r) for r in range(size))


def specificity_score(n: Column, r: Column) -> Column:
    """The score as a column, for whole counts.

    Either tail of the binomial on n + r + 3 trials gives it; the shorter one is summed, in logs so that a large
    count does not underflow.
    """
    n, r = n.cast("double"), r.cast("double")
    trials = n + r + t.BETA_B
    log_odds = float(np.log((1 - t.BETA_X) / t.BETA_X))

    def running(start: Column, last: Column, step) -> Column:
        seed = F.struct(start.alias("lt"), F.exp(start).alias("s"))

        def grow(acc, j):
            lt = acc["lt"] + step(j.cast("double"))
            return F.struct(lt.alias("lt"), (acc["s"] + F.exp(lt)).alias("s"))

        terms = F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(terms, seed, grow, lambda acc: acc["s"])

    # fewer than r + 3 successes of probability 0.075
    short = running(
        trials * float(np.log(t.BETA_X)),
        r + (t.BETA_B - 1),
        lambda j: F.log((trials - j + 1) / j) + log_odds,
    )
    # at most n failures before success r + 3
    long = running(
        (r + t.BETA_B) * float(np.log(1 - t.BETA_X)),
        n,
        lambda j: F.log((r + t.BETA_B + j - 1) / j) + float(np.log(t.BETA_X)),
    )
    near = F.when(n < r, F.lit(100.0) * long).otherwise(F.greatest(F.lit(0.0), F.lit(100.0) * (1 - short)))
    # fewer than half of over a thousand trials fail: the score is below 1e-280
    return F.when(r < TABLE_SIZE, near).when(n < r, F.lit(0.0)).otherwise(_far_score(n, r))


def _far_score(n: Column, r: Column) -> Column:
    """The score past TABLE_SIZE: the beta density of (r + 3, n + 1) over the tail that 0.075 cuts off, by quadrature.

    The density is near normal there, and ten spreads of it at NODES points are exact to double precision, whatever the
    reference. It is taken relative to its mode, so that no digits go in large logarithms.
    """
    x = 1 - t.BETA_X
    k, rest = r + (t.BETA_B - 1), n
    mode = k / (k + rest)
    spread = F.sqrt(mode * (1 - mode) / (k + rest))
    far = F.when(mode < x, F.least(F.lit(1.0), F.greatest(mode + 10 * spread, x + 5 * spread))).otherwise(
        F.greatest(F.lit(0.0), F.least(mode - 10 * spread, x - 5 * spread))
    )

    def stirling(v: Column) -> Column:
        return 1 / (12 * v) - 1 / (360 * v * v * v)

    peak = (k + rest + 1) * F.exp(stirling(k + rest) - stirling(k) - stirling(rest)) * F.sqrt((k + rest) / (2 * math.pi * k * rest))
    at, weight = np.polynomial.legendre.leggauss(NODES)
    nodes = F.array(*[F.struct(F.lit(float((1 + a) / 2)).alias("at"), F.lit(float(w / 2)).alias("w")) for a, w in zip(at, weight)])

    def tail(v: Column) -> Column:
        def grow(acc, node):
            place = x + node["at"] * v["width"]
            return acc + node["w"] * F.exp(v["k"] * F.log(place / v["mode"]) + v["rest"] * F.log((1 - place) / (1 - v["mode"])))

        return F.aggregate(nodes, F.lit(0.0), grow) * F.abs(v["width"]) * v["peak"]

    names = {"k": k, "rest": rest, "mode": mode, "width": far - x, "peak": peak}
    # the values of a row are worked out once, then used at every node
    mass = F.transform(F.array(F.struct(*[c.alias(c_name) for c_name, c in names.items()])), tail)[0]
    return F.lit(100.0) * F.when(mode < x, 1 - mass).otherwise(mass)


def reaches(n: Column, r: Column, cutoff: float) -> Column:
    """Whether the score of `n` against `r` is at or above `cutoff`.

    The score rises with the count, so the test is a comparison with the needed count, read from a constant
    array. References past the array are scored, at a cost that does not grow with them.
    """
    needed = needed_counts(float(cutoff))
    if cutoff >= 100.0:
        return F.lit(False)
    # one string literal, folded to an array by the optimizer, keeps the plan small while it is analysed
    table = F.split(F.lit(",".join(str(UNREACHED if c is None else c) for c in needed)), ",").cast("array<bigint>")
    return F.when(r < len(needed), n >= F.element_at(table, (r + 1).cast("int"))).otherwise(
        specificity_score(n, r) >= float(cutoff)
    )


def count_to_reach_column(reference: Column, cutoff: float) -> Column:
    """`count_to_reach` over a column that may hold fractional medians; meant for one row per sample."""
    limit = float(cutoff)

    @F.pandas_udf("bigint")
    def needed(r: pd.Series) -> pd.Series:
        found = {v: count_to_reach(limit, v) for v in r.dropna().unique()}
        return r.map(found).astype("Int64")

    return needed(reference.cast("double"))
