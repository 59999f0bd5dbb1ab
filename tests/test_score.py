import math

import pytest
from pyspark.sql import functions as F

from tagspark.functions.score import ZERO_COUNT_SCORE, count_to_reach, count_to_reach_column, reaches, specificity_score


def exact(n, r):
    """The upper tail of a binomial with n + r + 3 trials."""
    trials = n + r + 3
    low = sum(math.comb(trials, j) * 0.075**j * 0.925 ** (trials - j) for j in range(r + 3))
    return 100 * (1 - low)


def scores(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, r bigint").withColumn("s", specificity_score(F.col("n"), F.col("r")))
    return {(x.n, x.r): x.s for x in df.collect()}


def test_known_scores(spark):
    got = scores(spark, [(0, 0), (49, 0), (48, 0), (120, 5), (60, 6), (500, 60)])
    assert got[0, 0] == pytest.approx(ZERO_COUNT_SCORE, abs=1e-9) == pytest.approx(0.0421875)
    assert got[49, 0] == pytest.approx(75.82, abs=0.01) and got[48, 0] < 75
    assert got[120, 5] == pytest.approx(75.18, abs=0.01)
    assert got[60, 6] == pytest.approx(7.218, abs=0.001)
    assert got[500, 60] == pytest.approx(0.1087, abs=0.0001)


def test_score_against_exact_sum(spark):
    pairs = [(n, r) for n in (0, 1, 3, 10, 40, 200) for r in (0, 1, 2, 7, 30, 90)]
    for (n, r), value in scores(spark, pairs).items():
        assert value == pytest.approx(exact(n, r), abs=1e-8)


def test_large_counts_do_not_underflow(spark):
    got = scores(spark, [(20000, 3), (30000, 2300), (2000, 30000)])
    assert got[20000, 3] == pytest.approx(100.0) and 0 < got[30000, 2300] < 100 and got[2000, 30000] == 0.0


def test_count_to_reach():
    assert count_to_reach(75, 0) == 49 and count_to_reach(75, 5) == 120
    assert count_to_reach(100, 0) is None and count_to_reach(0.01, 0) == 0
    assert count_to_reach(75, 0) < count_to_reach(75, 0.5) < count_to_reach(75, 1)


def test_needed_count_is_the_boundary():
    for r in (0, 1, 6, 33, 100):
        n = count_to_reach(75, r)
        assert exact(n, r) >= 75 > exact(n - 1, r)


def test_threshold_agrees_with_score(spark):
    pairs = [(n, r) for r in (0, 3, 11) for n in range(0, 260, 7)] + [(9000, 600), (11000, 600)]
    df = spark.createDataFrame(pairs, "n bigint, r bigint")
    both = df.select(reaches(F.col("n"), F.col("r"), 75.0).alias("a"), (specificity_score(F.col("n"), F.col("r")) >= 75).alias("b"))
    assert all(x.a == x.b for x in both.collect())


def test_count_column_takes_medians(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (None,)], "r double").select(count_to_reach_column(F.col("r"), 75.0).alias("n"))
    assert [x.n for x in df.collect()] == [49, count_to_reach(75, 0.5), None]


def upper_tail(n, r):
    """The score at a large reference, each term from the one before, relative to the greatest."""
    trials, p = n + r + 3, 0.075
    mean, spread = trials * p, (trials * p * (1 - p)) ** 0.5
    lo, hi = max(0, int(mean - 15 * spread)), min(trials, int(mean + 15 * spread))
    logs = [0.0]
    for j in range(lo, hi):
        logs.append(logs[-1] + math.log((trials - j) * p / ((j + 1) * (1 - p))))
    top = max(logs)
    mass = [math.exp(x - top) for x in logs]
    return 100 * math.fsum(m for j, m in zip(range(lo, hi + 1), mass) if j > r + 2) / math.fsum(mass)


def test_scores_of_large_references(spark):
    pairs = [(round(12.333 * r * f), r) for r in (511, 512, 513, 3000, 50_000, 1_000_000) for f in (0.9, 0.99, 0.999, 1, 1.001, 1.01, 1.1)]
    got = scores(spark, pairs)
    assert all(value == pytest.approx(upper_tail(*pair), abs=1e-7) for pair, value in got.items())
    assert sum(1 < v < 99 for v in got.values()) > 10
    ends = scores(spark, [(10**9, 10**6), (0, 10**6), (10**6, 600), (511, 512), (512, 512)])
    assert ends == {(10**9, 10**6): 100, (0, 10**6): 0, (10**6, 600): 100, (511, 512): 0, (512, 512): pytest.approx(0)}


def test_needed_count_of_large_references():
    for r in (512, 50_000, 1_000_000):
        n = count_to_reach(75, r)
        assert upper_tail(n, r) >= 75 > upper_tail(n - 1, r)
    assert count_to_reach(75, 10**9) is None  # past SEARCH_CEILING


def test_cutoff_next_to_100_is_answered():
    from fractions import Fraction

    x, target = Fraction(925, 1000), Fraction(99.99999999999999 / 100)
    for r in (0, 2, 7):
        mass = reached = (1 - x) ** (r + 3)
        n = 0
        while reached < target:
            n += 1
            mass *= x * (r + 2 + n) / n
            reached += mass
        assert abs(count_to_reach(99.99999999999999, r) - n) <= 1
