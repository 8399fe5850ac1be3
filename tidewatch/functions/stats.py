"""Tail probabilities and quantiles.

The t quantile for whole degrees of freedom is a pure column expression. The other
functions are Arrow batch helpers; they only ever see one row per issue.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_NORMAL = NormalDist()
_T_TABLE_SIZE = 128


def normal_quantile(q: float) -> float:
    return _NORMAL.inv_cdf(q)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 500):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + numerator / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out = out * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return out


def _half_step(a: np.ndarray) -> np.ndarray:
    """log gamma(a + 1/2) - log gamma(a); by its series where the difference cancels."""
    near = np.minimum(a, 1e3)
    direct = np.array([math.lgamma(x + 0.5) - math.lgamma(x) for x in near])
    far = np.maximum(a, 1e3)
    series = 0.5 * np.log(far) - 1 / (8 * far) + 1 / (192 * far**3)
    return np.where(a < 1e3, direct, series)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's t; NaN where an input is missing."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    t, v = t[ok], df[ok]
    x = v / (v + t * t)
    a, b = v / 2, np.full_like(v, 0.5)
    log_beta = 0.5 * math.log(math.pi) - _half_step(a)
    swap = x > (a + 1) / (a + b + 2)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    # 1 - x is t^2/(v + t^2), taken directly so nothing cancels for small t.
    y = np.where(swap, t * t / (v + t * t), x)
    one_minus_y = np.where(swap, x, t * t / (v + t * t))
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log(one_minus_y) - log_beta) / p
    part = front * _beta_fraction(p, q, y)
    out[ok] = np.clip(np.where(swap, 1.0 - part, part), 0.0, 1.0)
    return out


def t_quantile(q: float, df: np.ndarray) -> np.ndarray:
    """Quantile q > 0.5 of Student's t.

    Newton steps from the normal quantile: it lies below every t quantile, and the tail
    is convex, so the steps rise towards the solution and cannot overshoot.
    """
    df = np.atleast_1d(np.asarray(df, float))
    out = np.full(df.shape, np.nan)
    ok = np.isfinite(df) & (df > 0)
    if not ok.any():
        return out
    v, tail = df[ok], 2.0 * (1.0 - q)
    log_scale = _half_step(v / 2) - 0.5 * np.log(v * math.pi)
    t = np.full(v.shape, _NORMAL.inv_cdf(q))
    for _ in range(100):
        slope = 2.0 * np.exp(log_scale - (v + 1) / 2 * np.log1p(t * t / v))
        step = (t_two_sided(t, v) - tail) / slope
        t = t + step
        if np.all(np.abs(step) <= 1e-14 * t):
            break
    out[ok] = t
    return out


@lru_cache(maxsize=32)
def t_table(alpha: float) -> tuple[float, ...]:
    """Two-sided critical values for 1, 2, ... degrees of freedom."""
    return tuple(t_quantile(1 - alpha / 2, np.arange(1, _T_TABLE_SIZE + 1)).tolist())


def t_expansion_terms(alpha: float) -> tuple[float, float, float, float, float]:
    """Coefficients of the large-sample expansion of the t quantile in 1/df."""
    z = normal_quantile(1 - alpha / 2)
    return (
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t_critical(df: str, alpha: float) -> str:
    """Two-sided critical value for whole degrees of freedom, as SQL text."""
    table = ", ".join(f"{v!r}D" for v in t_table(alpha))
    series = "0.0D"
    for c in reversed(t_expansion_terms(alpha)):
        series = f"({series} / nullif({df}, 0) + {c!r}D)"
    return (f"(CASE WHEN {df} <= 0 THEN NULL WHEN {df} <= {_T_TABLE_SIZE} "
            f"THEN element_at(array({table}), CAST({df} AS INT)) ELSE {series} END)")


# Ranks at each end whose normal scores are taken one by one.
_EXACT_RANKS = 64


def _score_sums(n: int, lo: int, hi: int) -> tuple[float, float]:
    """Sum and sum of squares of the normal scores of ranks lo..hi (1-based) of n.

    The scores near both ends are summed one by one; between them the sum is the integral
    of the quantile function and of its square, from half a rank below to half a rank
    above, with the first correction term of the midpoint rule.
    """
    total = squares = 0.0
    first, last = max(lo, _EXACT_RANKS + 1), min(hi, n - _EXACT_RANKS)
    for i in [*range(lo, min(hi, first - 1) + 1), *range(max(lo, last + 1, first), hi + 1)]:
        z = _NORMAL.inv_cdf((i - 0.375) / (n + 0.25))
        total, squares = total + z, squares + z * z
    if first <= last:
        step = 1 / (n + 0.25)
        a, b = (_NORMAL.inv_cdf((i - 0.375) * step) for i in (first - 0.5, last + 0.5))
        fa, fb = _NORMAL.pdf(a), _NORMAL.pdf(b)
        total += (fa - fb) / step - step / 24 * (1 / fb - 1 / fa)
        squares += ((_NORMAL.cdf(b) - b * fb) - (_NORMAL.cdf(a) - a * fa)) / step
        squares -= step / 24 * (2 * b / fb - 2 * a / fa)
    return total, squares


def shapiro_p(values: np.ndarray, counts: np.ndarray) -> float:
    """Shapiro-Wilk p-value of a histogram by Royston's 1995 approximation, from 4 values on.

    Only sums of the weights over runs of equal values are needed, so the cost depends on
    the number of distinct values and not on the sample's size.
    """
    order = np.argsort(values)
    values, counts = np.asarray(values, float)[order], np.asarray(counts)[order].astype(int)
    values, counts = values[counts > 0], counts[counts > 0]
    n = int(counts.sum())
    ends = np.cumsum(counts)
    sums = [_score_sums(n, e - c + 1, e) for c, e in zip(counts.tolist(), ends.tolist())]
    norm = sum(q for _, q in sums)
    top, next_top = (_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    u = 1 / math.sqrt(n)
    # Royston's polynomials for the extreme weights.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157,
                       top / math.sqrt(norm)], u)
    extremes = {n: (top, last), 1: (-top, -last)}
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981,
                             next_top / math.sqrt(norm)], u)
        phi = (norm - 2 * top**2 - 2 * next_top**2) / (1 - 2 * last**2 - 2 * second**2)
        extremes |= {n - 1: (next_top, second), 2: (-next_top, -second)}
    else:
        phi = (norm - 2 * top**2) / (1 - 2 * last**2)
    product = 0.0
    for value, (total, _), c, e in zip(values, sums, counts.tolist(), ends.tolist()):
        inside = [x for rank, x in extremes.items() if e - c < rank <= e]
        weight = (total - sum(m for m, _ in inside)) / math.sqrt(phi) + sum(a for _, a in inside)
        product += weight * value
    mean = float(values @ counts) / n
    w = product**2 / float((values - mean) ** 2 @ counts)
    gap = math.log(max(1 - w, 1e-300))
    # Royston's normalizing transformation of 1 - W.
    if n <= 11:
        gamma = -2.273 + 0.459 * n
        if gamma - gap <= 0:
            return 0.0
        score = -math.log(gamma - gap)
        mean = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        spread = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        score = gap
        log_n = math.log(n)
        mean = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n)
        spread = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return 0.5 * math.erfc((score - mean) / spread / math.sqrt(2))


def _normality(counts: pd.DataFrame) -> np.ndarray:
    """Shapiro-Wilk p of bounded rating histograms; NaN where counts are missing."""
    out = np.full(len(counts), np.nan)
    for i, row in enumerate(counts.to_numpy(float)):
        if not np.isnan(row).any():
            n = row.astype(int)
            out[i] = shapiro_p(np.arange(1, 6), n) if (n > 0).sum() > 1 else 0.0
    return out


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """2 P(Z > z), at most 1."""
    return np.array([min(1.0, math.erfc(v / math.sqrt(2))) for v in z])


TAILS = ("normal1", "normal2", "p_t", "p_rank", "effect_tail", "t_value")


def tails(alpha: float):
    """Batch function with every probability an impact row needs, in one Python pass.

    Its argument is a struct with the histograms c1..c5 and o1..o5 (NULL where normality
    is not in question), t, dof, z and effect_z.
    """

    @F.pandas_udf(StructType([StructField(n, DoubleType()) for n in TAILS]))
    def batch(x: pd.DataFrame) -> pd.DataFrame:
        number = {c: x[c].to_numpy(float) for c in ("t", "dof", "z", "effect_z")}
        return pd.DataFrame({
            "normal1": _normality(x[[f"c{v}" for v in range(1, 6)]]),
            "normal2": _normality(x[[f"o{v}" for v in range(1, 6)]]),
            "p_t": t_two_sided(number["t"], number["dof"]),
            "p_rank": _normal_tail(number["z"]),
            "effect_tail": _normal_tail(np.abs(number["effect_z"])),
            "t_value": t_quantile(1 - alpha / 2, number["dof"]),
        })

    return batch
