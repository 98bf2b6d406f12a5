"""Encoders of ordered series: phase plane, entropy gate, frequency bands, temporal predicates, momentum, lags.

Each adds a column to a table of series (``stream`` columns name a series, ``seq`` orders it) and is fitted to each series by
itself; rows without enough history get null. Look-back is bounded, so these are window functions within a series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _frames(stream: list[str], seq: str):
    whole = Window.partitionBy(*stream)
    return whole, whole.orderBy(seq)


def _string(conditions: list[Column]) -> Column:
    return F.concat(*(F.when(c, "1").otherwise("0") for c in conditions))


def phase_plane(df: DataFrame, stream: list[str], seq: str, value: str, rings: int = 2, sectors: int = 4, name: str = "phase") -> DataFrame:
    """One bit for the ring (by quantiles of the distance) and sector (by angle) of (value, step) around their means.

    The angle pi itself belongs to no sector; the first row of a series has no step and gets null."""
    whole, line = _frames(stream, seq)
    x = F.col(value).cast("double")
    df = df.withColumn("__d", x - F.lag(x).over(line))
    live = F.col("__d").isNotNull()
    df = df.withColumns({"__zx": x - F.avg(F.when(live, x)).over(whole), "__zd": F.col("__d") - F.avg("__d").over(whole)})
    df = df.withColumn("__r", F.when(live, F.sqrt(F.col("__zx") ** 2 + F.col("__zd") ** 2 + F.lit(1e-8))))
    cuts = [i / rings for i in range(1, rings)]
    df = df.withColumn("__e", F.percentile("__r", F.array(*map(F.lit, cuts))).over(whole) if cuts else F.array().cast("array<double>"))
    edge = [F.lit(0.0), *(F.get("__e", i) for i in range(rings - 1)), F.lit(float("inf"))]
    angle = F.atan2("__zd", "__zx")
    turn = np.linspace(-math.pi, math.pi, sectors + 1).tolist()
    at = lambda a, s: (F.col("__r") >= edge[a]) & (F.col("__r") < edge[a + 1]) & (angle >= turn[s]) & (angle < turn[s + 1])
    df = df.withColumn(name, F.when(live, _string([at(a, s) for a in range(rings) for s in range(sectors)])))
    return df.drop("__d", "__zx", "__zd", "__r", "__e")


def entropy_gate(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 8, bins: int = 8, bias: float = 0.0, name: str = "gate") -> DataFrame:
    """1 where the entropy of the last ``window`` values' histogram is above the series' mean entropy plus ``bias``."""
    return with_entropy(df, stream, seq, value, window, bins).withColumn("__tau", F.avg("entropy").over(Window.partitionBy(*stream)) + F.lit(bias)).withColumn(name, (F.col("entropy") > F.col("__tau")).cast("int")).drop("__tau", "entropy")


def with_entropy(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 8, bins: int = 8) -> DataFrame:
    """df with ``entropy`` in bits of the last ``window`` values over even bins of the series' range."""
    whole, line = _frames(stream, seq)
    x = F.col(value).cast("double")
    df = df.withColumns({"__lo": F.min(x).over(whole) - 1e-8, "__hi": F.max(x).over(whole) + 1e-8})
    width = (F.col("__hi") - F.col("__lo")) / bins
    df = df.withColumn("__bin", sum(((x >= F.col("__lo") + width * i).cast("int") for i in range(2, bins)), (x >= F.col("__lo") + width).cast("int")) if bins > 1 else F.lit(0))
    last = line.rowsBetween(1 - window, 0)
    df = df.withColumn("__full", F.count(F.lit(1)).over(last) == window).withColumns({f"__p{i}": F.sum((F.col("__bin") == i).cast("int")).over(last) / float(window) for i in range(bins)})
    part = lambda i: F.when(F.col(f"__p{i}") > 0, F.col(f"__p{i}") * F.log2(F.col(f"__p{i}") + 1e-12)).otherwise(0.0)
    h = -sum((part(i) for i in range(1, bins)), part(0))
    return df.withColumn("entropy", F.when(F.col("__full"), F.round(h, 9))).drop("__lo", "__hi", "__bin", "__full", *(f"__p{i}" for i in range(bins)))


def moving_gate(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 8, bins: int = 8, alpha: float = 0.9, bias: float = 0.0, name: str = "gate") -> DataFrame:
    """The gate with a threshold that starts at the series' mean entropy plus ``bias`` and follows the entropy; null without a
    whole window. (Entropies are taken from their mean, which leaves the recurrence as it is, so every series starts at 0.)"""
    from bitloom.streaming.steps import encode_rows

    mean = F.avg("entropy").over(Window.partitionBy(*stream)) + F.lit(bias)
    h = with_entropy(df.select(*stream, seq, value), stream, seq, value, window, bins).withColumn("__h", F.col("entropy") - mean)
    gates = encode_rows(h, stream, seq, "__h", lambda: MovingGate(0.0, alpha))
    keys = [F.col(c).alias(f"__{c}") for c in (*stream, seq)]
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*stream, seq)]
    return df.join(gates.select(*keys, F.col("bits").cast("int").alias(name)), same, "left").drop(*(f"__{c}" for c in (*stream, seq)))


class MovingGate:
    """The gate with a threshold that follows the entropy; a step function for ``streaming.steps``, its input the entropy."""

    def __init__(self, tau: float, alpha: float = 0.9):
        self.tau, self.alpha = tau, alpha

    def step(self, h: float) -> list[int]:
        out = [int(h > self.tau)]
        self.tau = self.alpha * self.tau + (1 - self.alpha) * h
        return out


def frequency_bands(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 16, bands: int = 4, quantile: float = 0.5, name: str = "bands") -> DataFrame:
    """A bit a band of the last ``window`` values' spectrum (without the mean): power above the series' quantile of it.

    The transform is a fixed matrix, so each power is two inner products with literal weights."""
    whole, line = _frames(stream, seq)
    n = window // 2
    size = max(1, n // bands)
    df = df.withColumn("__w", F.collect_list(F.col(value).cast("double")).over(line.rowsBetween(1 - window, 0)))
    full = F.size("__w") == window

    def dot(weights: np.ndarray) -> Column:
        return F.aggregate(F.zip_with("__w", F.array(*(F.lit(float(v)) for v in weights)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    at = 2 * math.pi * np.arange(window) / window
    power = lambda f: dot(np.cos(f * at)) ** 2 + dot(np.sin(f * at)) ** 2
    made = {}
    for b in range(bands):
        inside = [f + 1 for f in range(b * size, min((b + 1) * size, n))]
        made[f"__e{b}"] = F.when(full, F.round(sum((power(f) for f in inside[1:]), power(inside[0])), 9) if inside else F.lit(0.0))
    df = df.withColumns(made).withColumns({f"__q{b}": F.percentile(f"__e{b}", F.lit(quantile)).over(whole) for b in range(bands)})
    return df.withColumn(name, F.when(full, _string([F.col(f"__e{b}") > F.col(f"__q{b}") for b in range(bands)]))).drop("__w", *(f"__{k}{b}" for k in "eq" for b in range(bands)))


def temporal_predicates(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 8, mono: float = 0.7, osc: float = 0.4, burst: float = 2.0, stable: float = 0.3, name: str = "logic") -> DataFrame:
    """Five bits over the last ``window`` steps: increasing, decreasing, oscillating, bursting, stable."""
    whole, line = _frames(stream, seq)
    x = F.col(value).cast("double")
    df = df.withColumn("__s", F.signum(x - F.lag(x).over(line)))
    df = df.withColumn("__c", (F.col("__s") != F.lag("__s").over(line)).cast("int"))
    steps, turns, values = (line.rowsBetween(-n, 0) for n in (window - 1, window - 2, window))
    var, all_ = F.var_pop(x).over(values), F.var_pop(x).over(whole) + 1e-12
    share = lambda sign: F.sum((F.col("__s") == sign).cast("int")).over(steps) / float(window)
    flips = F.sum("__c").over(turns) / float(max(window - 1, 1)) if window > 1 else F.lit(0.0)
    facts = [share(1) > mono, share(-1) > mono, flips > osc, var > all_ * burst, var < all_ * stable]
    return df.withColumn(name, F.when(F.count(x).over(values) == window + 1, _string(facts))).drop("__s", "__c")


#: The parts of ``chronological`` and what their bits say.
GROUPS = {"phase": "2 rings by 4 sectors", "bands": "4 bands of the spectrum", "logic": "increasing, decreasing, oscillating, bursting, stable"}


def chronological(df: DataFrame, stream: list[str], seq: str, value: str, window: int = 8, spectrum: int | None = None, parts: tuple[str, ...] = ("phase", "bands", "logic"), gated: bool = True, tabular: bool = False, name: str = "bits") -> DataFrame:
    """Phase, frequency and predicate bits together (those of ``parts``), all 0 where the moving entropy gate is shut.

    Only rows that have them all; ``tabular`` keeps the others too, with zeros. ``spectrum``: the spectrum's window, if another."""
    made = {"phase": lambda d: phase_plane(d, stream, seq, value, name="__phase"), "bands": lambda d: frequency_bands(d, stream, seq, value, spectrum or window, name="__bands"), "logic": lambda d: temporal_predicates(d, stream, seq, value, window, name="__logic")}
    columns = [f"__{p}" for p in made if p in parts]
    for p in made:
        df = made[p](df) if p in parts else df
    if gated:
        df = moving_gate(df, stream, seq, value, window, name="__gate")
    whole = F.lit(True)
    for c in [*columns, *(["__gate"] if gated else [])]:
        whole = whole & F.col(c).isNotNull()
    bits = F.concat(*columns) if columns else F.lit("")
    zeros = F.lit("0" * sum(n for p, n in (("phase", 8), ("bands", 4), ("logic", 5)) if p in parts))
    df = df.withColumn(name, F.when(whole, F.when(F.col("__gate") == 1, bits).otherwise(zeros) if gated else bits).otherwise(zeros) if tabular else F.when(whole, F.when(F.col("__gate") == 1, bits).otherwise(zeros) if gated else bits))
    return (df if tabular else df.where(F.col(name).isNotNull())).drop(*columns, "__gate")


def bit_groups(parts: tuple[str, ...] = ("phase", "bands", "logic")) -> list[tuple[str, int, int, str]]:
    """(part, first place, bits, meaning) of the bits that ``chronological`` gives."""
    out, at = [], 0
    for p, n in (("phase", 8), ("bands", 4), ("logic", 5)):
        if p in parts:
            out.append((p, at, n, GROUPS[p]))
            at += n
    return out


def learning_rows(df: DataFrame, stream: list[str], seq: str, value: str, label: str, lags: int = 4, **chrono) -> DataFrame:
    """(stream..., seq, bits, label): chronological bits of each row and of the ``lags`` before it, with the row's own label; rows
    that windows or lags leave incomplete are gone. What a clause learner, or any model, is given."""
    bits = chronological(df, stream, seq, value, **chrono)
    return stacked(bits, stream, seq, "bits", lags).select(*stream, seq, "bits", label)


def soft_plane(edges: list[float], sectors: int = 4) -> dict[str, list[float]]:
    """Centres and widths of soft rings (from their edges, cut at 100) and soft sectors, for Gaussian membership."""
    cut, turn = np.minimum(edges, 100.0), np.linspace(-math.pi, math.pi, sectors + 1)
    rings = (np.array(edges[:-1], float) + cut[1:]) / 2
    return {"rings": rings.tolist(), "ring_widths": (np.diff(cut) / 2 + 1e-8).tolist(), "sectors": ((turn[:-1] + turn[1:]) / 2).tolist(), "sector_width": [math.pi / sectors]}


def stacked(df: DataFrame, stream: list[str], seq: str, bits: str = "bits", lags: int = 4) -> DataFrame:
    """Each row's bit string followed by those of the ``lags`` rows before; rows without them are left out."""
    _, line = _frames(stream, seq)
    df = df.withColumn("__all", F.concat(bits, *(F.lag(bits, i).over(line) for i in range(1, lags + 1))))
    return df.where(F.col("__all").isNotNull()).withColumn(bits, F.col("__all")).drop("__all")


def clause(bits: Column, literals: list[tuple[int, bool]]) -> Column:
    """Whether all literals hold: (place from 0 in the bit string, negated); a place beyond it counts as 0."""
    holds = [(F.coalesce(F.substr(bits, F.lit(i + 1), F.lit(1)), F.lit("")) == "1") != F.lit(no) for i, no in literals]
    out = F.lit(True)
    for h in holds:
        out = out & h
    return out


def soft_bits(x: Column, thresholds: list[float], beta: float = 5.0) -> Column:
    """array<double>: the logistic of beta (x - t), the exponent kept within 500."""
    return F.array(*(1 / (1 + F.exp(F.least(F.greatest(-beta * (x - F.lit(float(t))), F.lit(-500.0)), F.lit(500.0)))) for t in thresholds))


class Momentum:
    """One bit: the gap of a fast and a slow mean in units of the mean step, with latching; rises above ``alpha``, falls
    below minus half of it. ``start`` is the mean step at the first value."""

    def __init__(self, alpha: float = 1.5, fast: float = 0.25, start: float = 1e-8):
        self.alpha, self.fast, self.slow, self.unit = alpha, fast, fast / 3, start
        self.last, self.near, self.far, self.bit = None, 0.0, 0.0, 0

    def step(self, x: float) -> list[int]:
        if self.last is None:
            self.near = self.far = self.last = x
            return [0]
        self.near += self.fast * (x - self.near)
        self.far += self.slow * (x - self.far)
        self.unit += self.slow * (abs(x - self.last) - self.unit)
        self.last = x
        v = (self.near - self.far) / (self.unit + 1e-8)
        self.bit = 1 if v > self.alpha else 0 if v < -self.alpha / 2 else self.bit
        return [self.bit]


def momentum_bits(series: Column, alpha: float = 1.5, fast: float = 0.25) -> Column:
    """The bit string of a whole series in an array column (null for a null one); Arrow batches, one pass a series."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for row in batch:
                machine = Momentum(alpha, fast, 0.0)
                out.append(None if row is None else "".join(str(machine.step(float(v))[0]) for v in row))
            yield pd.Series(out, dtype=object)

    return run(series)


def events(bits: Column) -> Column:
    """array<struct<place, bit>>: the first bit of a string and each that differs from the one before (places from 0)."""
    at = lambda i: F.substr(bits, i + 1, F.lit(1))
    places = F.when(F.length(bits) > 0, F.sequence(F.lit(0), F.length(bits) - 1)).otherwise(F.array().cast("array<int>"))
    changed = F.filter(places, lambda i: (i == 0) | (at(i) != at(i - 1)))
    return F.transform(changed, lambda i: F.struct(i.alias("place"), at(i).cast("int").alias("bit")))


def sparsity(bits: Column) -> Column:
    """The share of zeros of a bit string."""
    return F.length(F.replace(bits, F.lit("1"), F.lit(""))) / F.length(bits)


def compression(bits: Column) -> Column:
    """Length over number of events."""
    return F.length(bits) / F.greatest(F.size(events(bits)), F.lit(1))
