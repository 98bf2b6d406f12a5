"""Thermometer bits and the small threshold algebra that encoders share.

A bit is 1 where ``x >= threshold``; null and NaN give 0 (Spark orders NaN above all numbers, so it is kept out).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def probabilities(k: int) -> list[float]:
    """The k interior probabilities i / (k + 1)."""
    return [(i + 1) / (k + 1) for i in range(k)]


def places(probs: list[float], n: int) -> list[tuple[int, float]]:
    """Where the quantiles of n values in order lie: a place and the share of the way to the next."""
    return [(int(p * (n - 1)), p * (n - 1) % 1) for p in probs]


def between(ordered: Sequence[float], place: int, share: float) -> float:
    """The quantile there, rounded as DuckDB's quantile_cont does (one multiply-add), so that equal values tie alike."""
    return math.fma(ordered[place], 1 - share, ordered[place + 1] * share) if share else ordered[place]


def bits(x: Column, thresholds: list[float]) -> Column:
    """array<tinyint> of x against literal thresholds; a plain projection, inside whole-stage codegen."""
    live = x.isNotNull() & ~F.isnan(x)
    return F.array(*((live & (x >= F.lit(float(t)))).cast("tinyint") for t in thresholds)) if thresholds else F.array().cast("array<tinyint>")


def rising(values) -> list[float]:
    """Sorted, each value that isn't above the one before moved 1e-10 above it."""
    out: list[float] = []
    for v in sorted(float(v) for v in values):
        out.append(v if not out or v > out[-1] else out[-1] + 1e-10)
    return out


def midpoints(distinct: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip(distinct[:-1], distinct[1:], strict=True)]


def thinned(values: list[float], n: int) -> list[float]:
    """n values spread evenly over the list, places cut to whole numbers."""
    return values if len(values) <= n else [values[int(i)] for i in np.linspace(0, len(values) - 1, n)]


def probit(p: float) -> float:
    """Inverse normal distribution by the rational approximation of Abramowitz and Stegun, 26.2.23."""
    if p <= 0 or p >= 1:
        return -6.0 if p <= 0 else 6.0
    t = np.sqrt(-2 * np.log(min(p, 1 - p)))
    # Fixed values of the published formula.
    size = t - (2.515517 + 0.802853 * t + 0.010328 * t**2) / (1 + 1.432788 * t + 0.189269 * t**2 + 0.001308 * t**3)
    return float(size if p > 0.5 else -size)
