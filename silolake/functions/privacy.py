"""Differential-privacy accounting for the Gaussian mechanism.

ε of one release uses the analytic Gaussian mechanism condition (Balle & Wang,
ICML 2018): a release with noise σ and L2 sensitivity Δ is (ε, δ)-DP iff

    Φ(Δ/(2σ) − εσ/Δ) − e^ε · Φ(−Δ/(2σ) − εσ/Δ) ≤ δ.

The left side falls monotonically in ε, so the smallest ε is found by bisection.
Rounds compose basically: (Σε, k·δ).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def gaussian_delta(eps: float, sigma: float, sensitivity: float = 1.0) -> float:
    a = sensitivity / (2.0 * sigma)
    b = eps * sigma / sensitivity
    return _phi(a - b) - math.exp(eps) * _phi(-a - b)


def analytic_gaussian_epsilon(sigma: float, delta: float, sensitivity: float = 1.0, tol: float = 1e-10) -> float:
    """Smallest ε ≥ 0 with gaussian_delta(ε) ≤ δ; ∞ for σ ≤ 0, 0 when already δ-private at ε = 0."""
    if sigma <= 0:
        return math.inf
    if gaussian_delta(0.0, sigma, sensitivity) <= delta:
        return 0.0
    lo, hi = 0.0, 1.0
    while gaussian_delta(hi, sigma, sensitivity) > delta:
        lo, hi = hi, hi * 2.0
        if hi > 1e6:
            return math.inf
    while hi - lo > tol * max(1.0, hi):
        mid = 0.5 * (lo + hi)
        if gaussian_delta(mid, sigma, sensitivity) > delta:
            lo = mid
        else:
            hi = mid
    return hi


def compose_epsilons(epsilons: list[float], delta: float) -> tuple[float, float]:
    return float(sum(epsilons)), len(epsilons) * delta


def _epsilon_batch(sigma: pd.Series, delta: pd.Series, sens: pd.Series) -> pd.Series:
    return pd.Series([analytic_gaussian_epsilon(float(s), float(d), float(c)) for s, d, c in zip(sigma, delta, sens)])


def round_epsilon(sigma: Column, delta: Column, sensitivity: Column) -> Column:
    """Vectorised ε column (Arrow-batched pandas UDF; apply to distinct (σ, δ, C) then join back)."""
    from pyspark.sql import SparkSession

    from silolake.session import ship_package
    ship_package(SparkSession.getActiveSession())
    udf = F.pandas_udf(_epsilon_batch, "double")
    return udf(sigma.cast("double"), delta.cast("double"), sensitivity.cast("double"))


def with_round_epsilon(df: DataFrame, sigma: str = "sigma", delta: str = "delta_dp", clip: str = "clip") -> DataFrame:
    """ε per row, computed once per distinct (σ, δ, C) and joined back.

    ``sigma`` is the noise multiplier: the noise added to a sum of sensitivity C is σ·C.
    """
    keys = df.select(sigma, delta, clip).distinct()
    eps = keys.withColumn("epsilon", round_epsilon(F.col(sigma) * F.col(clip), F.col(delta), F.col(clip)))
    return df.join(eps, [sigma, delta, clip], "left")
