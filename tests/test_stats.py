import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.rounding import format_percent, format_stars, round_exact, signed
from tidewatch.functions.stats import (
    shapiro_p,
    t_critical,
    t_expansion_terms,
    t_quantile,
    t_table,
    t_two_sided,
)


def test_t_quantiles():
    for df, expected in ((1, 12.70620474), (2, 4.30265273), (10, 2.22813885),
                         (30, 2.04227246), (120, 1.97993041)):
        assert t_table(0.05)[df - 1] == pytest.approx(expected, abs=1e-8)
    terms = t_expansion_terms(0.05)
    series = sum(c / 128**i for i, c in enumerate(terms))
    assert series == pytest.approx(t_table(0.05)[127], abs=1e-9)
    assert t_quantile(0.975, np.array([1e9]))[0] == pytest.approx(1.959963985, abs=1e-7)


def test_t_tails():
    got = t_two_sided(np.array([2.0, 0.0, 12.7062047, np.nan]), np.array([10, 5, 1, 3]))
    assert got[:3] == pytest.approx([0.07338803, 1.0, 0.05], abs=1e-7)
    assert np.isnan(got[3])


def test_t_critical_column(spark):
    df = spark.createDataFrame([(0,), (3,), (500,)], "n bigint")
    got = [r[0] for r in df.select(F.expr(t_critical("n", 0.05))).collect()]
    assert got[0] is None
    assert got[1:] == pytest.approx([3.18244631, 1.96471984], abs=1e-7)


def test_shapiro_against_published_example():
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    assert shapiro_p(weights, np.ones(11)) == pytest.approx(0.0067, abs=2e-4)
    scores = [NormalDist(3, 1).inv_cdf((i + 0.5) / 40) for i in range(40)]
    assert shapiro_p(scores, np.ones(40)) > 0.9


def listed_shapiro_w(sample):
    """W of a listed sample of more than five values, weight by weight."""
    x, n = np.sort(sample), len(sample)
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    norm, u = m @ m, n ** -0.5
    # Royston's polynomials for the extreme weights.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / norm**0.5], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / norm**0.5], u)
    a = m / ((norm - 2 * m[-1]**2 - 2 * m[-2]**2) / (1 - 2 * last**2 - 2 * second**2)) ** 0.5
    a[0], a[1], a[-2], a[-1] = -last, -second, second, last
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.mark.parametrize("counts", [(3, 4, 6, 5, 2), (30, 60, 110, 70, 30), (61, 242, 383, 242, 72),
                                    (700, 150, 80, 50, 20), (0, 4000, 900, 100, 0)])
def test_shapiro_of_counts_is_that_of_the_list(counts):
    w = listed_shapiro_w(np.repeat(np.arange(1.0, 6), counts))
    log_n, gap = np.log(sum(counts)), np.log(1 - w)
    mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
    spread = np.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    expected = 1 - NormalDist().cdf((gap - mean) / spread)
    assert shapiro_p(np.arange(1, 6), np.array(counts)) == pytest.approx(expected, rel=1e-3, abs=1e-9)


@pytest.mark.parametrize("counts", [(240, 40, 10, 6, 4), (100, 80, 60, 40, 20),
                                    (60, 60, 60, 60, 60), (20, 60, 140, 60, 20)])
def test_large_five_valued_samples_are_never_normal(counts):
    for scale in (1, 1000):
        assert shapiro_p(np.arange(1, 6), np.array(counts) * scale) < 0.001


def test_round_exact_agrees_with_python(spark):
    rnd = random.Random(7)
    values = [2.675, 2.0625, 2.1875, 4.35, -0.5, 0.5, 1.5, 2.5, -2.5, 0.145, 1.005, 0.0, 1e-9]
    values += [rnd.uniform(-5, 5) for _ in range(300)]
    values += [rnd.randrange(-4000, 4000) / 2000 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = df.select("x", F.expr(round_exact("x", digits)).alias("r")).collect()
        assert [r.r for r in got] == [round(r.x, digits) for r in got]
    assert spark.sql(f"SELECT {round_exact('CAST(NULL AS DOUBLE)', 2)}").first()[0] is None


def test_number_texts(spark):
    values = [0.125, -0.0, -0.001, 1.0, -1.235, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.selectExpr(f"{signed('x', 2)} s", f"{format_percent('x')} p",
                        f"{format_stars('x')} r").collect()
    assert [g.s for g in got[:5]] == [f"{v:+.2f}" for v in values[:5]]
    assert [g.p for g in got[:5]] == [f"{v * 100:.1f}%" for v in values[:5]]
    assert [g.r for g in got] == [f"{v:+.2f}★" for v in values[:5]] + ["—"]
    assert got[5].p == "—"
