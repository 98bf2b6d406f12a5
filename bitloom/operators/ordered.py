"""Encoders whose fit depends on the order of rows: recent rows, sliding windows, segments, local windows.

``order`` is a unique numeric or time column. Places come from ``plans.order``, statistics of windows and segments from one
grouped aggregation each; a few numbers a window reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.thermo import probabilities, rising
from bitloom.operators.encoders import Model
from bitloom.operators.ladders import _bits_for, dense_and_tails, inside, ladder, merged
from bitloom.plans import profile as P
from bitloom.plans.order import numbered


def levelled(df: DataFrame, features: list[str], how: str = "zscore") -> DataFrame:
    """The features of each row freed of the row's own level and scale: zscore, l2, range or none."""
    x = [F.col(f).cast("double") for f in features]
    n = len(x)
    mean = sum(x[1:], x[0]) / n
    if how == "none":
        return df
    if how == "zscore":
        low, wide = mean, F.sqrt(sum(((v - mean) ** 2 for v in x[1:]), (x[0] - mean) ** 2) / n)
    elif how == "l2":
        low, wide = F.lit(0.0), F.sqrt(sum((v**2 for v in x[1:]), x[0] ** 2))
    elif how == "range":
        low = F.least(*x) if n > 1 else x[0]
        wide = (F.greatest(*x) if n > 1 else x[0]) - low
    else:
        raise ValueError(f"no such scaling: {how}")
    return df.withColumns({f: (v - low) / (wide + 1e-20) for f, v in zip(features, x, strict=True)})


def drift_robust(df: DataFrame, features: list[str], order: str, k: int = 8, alpha: float = 0.4, how: str = "zscore") -> Model:
    """Quantiles of levelled rows, blended with those of the last fifth. Apply the model to ``levelled`` rows."""
    rows = numbered(levelled(df, features, how), order)
    n = df.count()
    full = P.quantiles(rows, features, probabilities(k))
    late = P.quantiles(rows.where(F.col("__at") >= n - max(int(n * 0.2), k + 2)), features, probabilities(k))
    return Model({f: rising((1 - alpha) * np.array(full[f]) + alpha * np.array(late[f])) for f in features})


def _by_part(rows: DataFrame, part: Column, features: list[str], probs: list[float], least: int = 5) -> list[dict]:
    """For each part of ``least`` rows or more, in order: by feature the mean and the quantiles."""
    x = rows.select(part.alias("__part"), *(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features))
    made = [e for f in features for e in (F.avg(f).alias(f"{f}|m"), F.percentile(f, F.array(*map(F.lit, probs))).alias(f"{f}|q"))]
    found = x.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), *made).where(F.col("__n") >= least).orderBy("__part").collect()
    return [{f: (r[f"{f}|m"], list(r[f"{f}|q"] or [])) for f in features} for r in found]


def _drift(parts: list[dict], f: str, sd: float) -> float:
    means = [p[f][0] for p in parts if p[f][0] is not None]
    return float(np.std(means)) / (sd + 1e-15) if means else 0.0


def sliding_windows(df: DataFrame, features: list[str], order: str, most: int = 10, share: float = 0.25) -> Model:
    """Ladder; then the median over windows (three quarters overlapping) of their quantiles, with the 10th and 90th
    percentile over windows too where the windows' means drift."""
    n = df.count()
    size = max(20, int(n * share))
    step = max(1, size // 4)
    count = max(1, (n - size) // step + 1)
    probs = np.linspace(0.02, 0.98, min(2 * most, 20)).tolist()

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        at = F.col("__at")
        first = F.greatest(F.lit(0), F.floor((at - size) / F.lit(step)) + 1)
        last = F.least(F.lit(count - 1), F.floor(at / F.lit(step)))
        rows = numbered(df.select(order, *(c for c in rest if c != order)), order).withColumn("__w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        parts = _by_part(rows, F.col("__w"), rest, probs)
        out = {}
        for f in rest:
            q = np.array([p[f][1] for p in parts if p[f][1]])
            if not len(q):
                out[f] = P.quantiles(df, [f], np.linspace(0.05, 0.95, most).tolist())[f]
                continue
            more = [*np.percentile(q, 10, axis=0), *np.percentile(q, 90, axis=0)] if _drift(parts, f, s[f]["sd"]) > 0.3 else []
            out[f] = merged(np.median(q, axis=0), more, most=most)
        return out

    return ladder(df, features, most, place)


def _segments(df: DataFrame, rest: list[str], order: str, segments: int, probs: list[float]) -> list[dict]:
    size = max(10, df.count() // segments)
    rows = numbered(df.select(order, *(c for c in rest if c != order)), order)
    return _by_part(rows, F.floor(F.col("__at") / F.lit(size)), rest, probs)


def _of_segments(parts: list[dict], f: str) -> list[float]:
    """The segments' quantiles and the middles between their neighbouring means."""
    means = sorted(p[f][0] for p in parts if p[f][0] is not None)
    return merged(*(p[f][1] for p in parts), [(a + b) / 2 for a, b in zip(means[:-1], means[1:], strict=True)])


def _four(df: DataFrame, f: str, t: list[float], n: int, fill: int) -> list[float]:
    return t if len(t) >= 4 else merged(t, P.quantiles(df, [f], np.linspace(0.1, 0.9, fill).tolist())[f], most=n)


def segments(df: DataFrame, features: list[str], order: str, most: int = 12, n_segments: int = 4) -> Model:
    """Ladder; then global quantiles, or those of consecutive segments whose means drift; 4 to ``most`` bits."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        parts, out = _segments(df, rest, order, n_segments, [0.5]), {}
        for f in rest:
            drift = _drift(parts, f, s[f]["sd"])
            n = _bits_for(most, s[f]["distinct"], 2 * drift, 0.4)
            if drift > 0.2:
                own = _segments(df, [f], order, n_segments, inside(0.05, 0.95, max(2, n // max(len(parts), 1))))
                t = merged(_of_segments(own, f), most=n)
            else:
                t = merged(P.quantiles(df, [f], inside(0.02, 0.98, n))[f], most=n)
            out[f] = _four(df, f, t, n, 4)
        return out

    return ladder(df, features, most, place)


def segments_or_density(df: DataFrame, features: list[str], order: str, most: int = 10, n_segments: int = 4, bins: int = 128) -> Model:
    """Ladder; then the segments' quantiles where their means drift, else half dense bins, half quantiles."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        size = max(10, df.count() // n_segments)
        n_parts = -(-df.count() // size)
        parts = _segments(df, rest, order, n_segments, inside(0.05, 0.95, max(2, most // max(n_parts, 1))))
        moved = [f for f in rest if _drift(parts, f, s[f]["sd"]) > 0.15]
        still = [f for f in rest if f not in moved]
        out = dense_and_tails(df, still, s, most, 0.5, bins) if still else {}
        return out | {f: _four(df, f, merged(_of_segments(parts, f), most=most), most, max(4, most)) for f in moved}

    return ladder(df, features, most, place)


def memory_length(df: DataFrame, features: list[str], order: str, rows: int = 4000) -> int:
    """The length of a local window: the lag at which the features' mean autocorrelation over the first ``rows`` rows falls
    under 1/e, but the square root of the row count at least (16 to 512), and 1024 at most."""
    n = df.count()
    floor, longest = int(np.clip(round(math.sqrt(n)), 16, 512)), int(np.clip(round(math.sqrt(n)), 4, 128))
    x = np.array([list(r) for r in P.clean(df.orderBy(order).limit(rows), features).na.fill(0.0).collect()], float).reshape(-1, len(features))
    x = x - x.mean(axis=0) if len(x) else x
    var = x.var(axis=0, ddof=1) if len(x) > 1 else np.zeros(len(features))
    x, var = x[:, var > 0], var[var > 0]
    lag = longest
    for step in range(1, min(longest, len(x) - 1) + 1):
        if x.shape[1] and np.mean(np.abs((x[:-step] * x[step:]).mean(axis=0) / var)) < 1 / math.e:
            lag = step
            break
    return int(max(min(max(lag, floor), min(n, 1024)), 1))


def local_bits(df: DataFrame, stream: list[str], order: str, value: str, window: int, warm: DataFrame | None = None) -> DataFrame:
    """df with ``bits``: each value against the exact quantiles of up to ``window`` values before it and itself, as many as
    Sturges' rule asks for that length. ``warm`` rows come before (give them smaller orders) and aren't returned."""
    k = max(1, math.ceil(math.log2(max(window, 2))) + 1)
    rows = df.withColumn("__own", F.lit(True))
    if warm is not None:
        rows = rows.unionByName(warm.withColumn("__own", F.lit(False)))
    x = F.col(value).cast("double")
    w = Window.partitionBy(*stream).orderBy(order).rowsBetween(-window, 0)
    rows = rows.withColumn("__q", F.percentile(x, F.array(*map(F.lit, probabilities(k)))).over(w)).where("__own")
    return rows.withColumn("bits", F.array_join(F.transform("__q", lambda t: F.coalesce(x >= t, F.lit(False)).cast("int").cast("string")), "")).drop("__q", "__own")
