"""Encoders with fixed thresholds: a fit finds thresholds by distributed aggregates, a model applies them as a projection.

All statistics are of the full data (no subsamples), so results don't depend on row order or partitioning. Fits
bring a few numbers a feature to the driver; ``Model.transform`` is lazy and runs inside whole-stage codegen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.functions.thermo import bits, probabilities, probit, rising
from bitloom.plans import profile as P


@dataclass(frozen=True)
class Model:
    """Thresholds by feature."""

    thresholds: dict[str, list[float]]

    @property
    def width(self) -> int:
        return sum(map(len, self.thresholds.values()))

    def transform(self, df: DataFrame, name: str = "bits") -> DataFrame:
        """df with all bits in one array, feature after feature."""
        return df.withColumn(name, F.concat(*(bits(F.col(f).cast("double"), t) for f, t in self.thresholds.items())))

    def strings(self, df: DataFrame, name: str = "bits") -> DataFrame:
        """df with all bits as a string of 0 and 1."""
        df = self.transform(df, name)
        return df.withColumn(name, F.array_join(F.transform(name, lambda b: b.cast("string")), ""))

    def packed(self, df: DataFrame, name: str = "packed") -> DataFrame:
        """df with all bits in bytes, the first bit highest, filled up with 0."""
        df = self.transform(df, "__bits")
        n = -(-self.width // 8)
        full = F.concat("__bits", F.array_repeat(F.lit(0).cast("tinyint"), n * 8 - self.width))
        byte = lambda i: F.aggregate(F.slice(full, i * 8 + 1, 8), F.lit(0), lambda a, b: a * 2 + b)
        digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")
        return df.withColumn(name, F.unhex(digits)).drop("__bits")

    def ones(self, df: DataFrame) -> DataFrame:
        """(feature, bit, threshold, ones): how often each bit is set; one aggregation of the source."""
        pairs = [(f, i, t) for f, ts in self.thresholds.items() for i, t in enumerate(ts)]
        x = P.clean(df, list(self.thresholds))
        row = x.agg(*(F.count_if(F.col(f) >= F.lit(t)).alias(f"{f}|{i}") for f, i, t in pairs))
        rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(i + 1).cast("long").alias("bit"), F.lit(round(t, 6) + 0.0).alias("threshold"), F.col(f"{f}|{i}").alias("ones")) for f, i, t in pairs))
        return row.select(F.explode(rows).alias("r")).select("r.*")


def uniform(df: DataFrame, features: list[str], k: int = 8, least: float = 1e-6) -> Model:
    """k even thresholds strictly inside the range (a constant column counts as ``least`` wide)."""
    s = P.moments(df, features)

    def even(lo: float, hi: float) -> list[float]:
        if hi - lo >= least:  # in the SQL's order of operations, so that values tie with thresholds alike
            return [lo + (hi - lo) * i / (k + 1) for i in range(1, k + 1)]
        return np.linspace(lo + least / (k + 1), hi - least / (k + 1), k).tolist()

    return Model({f: even(s[f]["lo"], s[f]["hi"]) for f in features})


def quantile(df: DataFrame, features: list[str], k: int = 8) -> Model:
    """The k quantiles at i / (k + 1)."""
    return Model(P.quantiles(df, features, probabilities(k)))


def deviation(df: DataFrame, features: list[str], k: int = 8, reach: float = 3.0) -> Model:
    """k even thresholds within ``reach`` standard deviations of the mean."""
    s = P.moments(df, features)
    z = np.linspace(-reach, reach, k + 2)[1:-1]
    return Model({f: (s[f]["mean"] + z * (s[f]["sd"] + 1e-8)).tolist() for f in features})


def quartiles(df: DataFrame, features: list[str]) -> Model:
    """The lower and the upper quartile."""
    return Model(P.quantiles(df, features, [0.25, 0.75]))


def distinct_steps(df: DataFrame, features: list[str], k: int = 25) -> Model:
    """Every distinct value but the smallest; k of them, evenly spaced from the first, if there are more."""
    s, out = P.moments(df, features), {}
    for f in features:
        n = s[f]["distinct"]
        out[f] = P.distinct_sorted(df, f)[1:] if n <= k + 1 else P.distinct_at(df, f, [1 + int(i * (n - 1) / k) for i in range(k)])
    return Model(out)


def adaptive_quantile(df: DataFrame, features: list[str], k: int = 10, method: str = "quantile") -> Model:
    """Distinct values while there are k or fewer; else k quantiles, or k distinct values evenly spaced (``unique``)."""
    s = P.moments(df, features)
    q = P.quantiles(df, features, probabilities(k))
    out = {}
    for f in features:
        n = s[f]["distinct"]
        if n <= 1:
            out[f] = [s[f]["lo"] + 1e-10] if n else [0.0]
        elif n <= k:
            out[f] = P.distinct_sorted(df, f)[1:]
        else:
            out[f] = rising(q[f]) if method == "quantile" else P.distinct_sorted(df, f, k)
    return Model(out)


def _toward_centre(t: np.ndarray, gamma: float, share: float) -> np.ndarray:
    """Thresholds blended with a grid over their range that is drawn to its middle by a power."""
    u = np.linspace(-1, 1, len(t))
    grid = t[0] + (t[-1] - t[0]) * (np.sign(u) * np.abs(u) ** (1 + gamma) + 1) / 2
    return (1 - share) * t + share * grid


def kurtosis_blend(df: DataFrame, features: list[str], k: int = 8, blend: float = 0.3) -> Model:
    """Quantiles, drawn to the middle of their range for heavy-tailed columns that aren't nearly discrete."""
    s, q = P.moments(df, features), P.quantiles(df, features, probabilities(k))
    for f in features:
        heavy = float(np.clip(np.clip(s[f]["kurt"], -2, 30) / 15, 0, 1))
        if heavy >= 0.05 and q[f][-1] - q[f][0] >= 1e-15 and s[f]["distinct"] > max(3, k // 2):
            q[f] = _toward_centre(np.array(q[f]), 1.5 * heavy * blend, blend * heavy).tolist()
    return Model({f: rising(q[f]) for f in features})


def bin_pulse(df: DataFrame, features: list[str], k: int = 8, sensitivity: float = 0.3, follow_skew: bool = True) -> Model:
    """Quantiles, each moved toward the side whose bin is wider, then all by the skew."""
    s, q = P.moments(df, features), P.quantiles(df, features, probabilities(k))
    wide = P.deviations_between(df, q)
    out = {}
    for f in features:
        w, t = np.array(wide[f]), np.array(q[f])
        if sensitivity > 0:
            t = t + sensitivity * 0.1 * s[f]["sd"] * (w[1:] - w[:-1]) / (w[1:] + w[:-1] + 1e-20)
        if follow_skew and s[f]["n"] > 10:
            t = t + 0.05 * float(np.clip(s[f]["skew"], -3, 3)) * s[f]["sd"]
        out[f] = rising(t)
    return Model(out)


def density_edges(df: DataFrame, features: list[str], k: int = 8, zones: int = 32, edge: float = 0.3) -> Model:
    """Quantiles blended with the quantiles of a histogram weighted by its density and its jumps."""
    s, q = P.moments(df, features), P.quantiles(df, features, probabilities(k))
    mode = P.mode_share(df, features)
    use = [f for f in features if s[f]["hi"] - s[f]["lo"] >= 1e-15 and s[f]["distinct"] > max(3, k // 2) and mode[f] <= 0.5]
    edges = {f: np.linspace(s[f]["lo"] - 0.02 * (s[f]["hi"] - s[f]["lo"]), s[f]["hi"] + 0.02 * (s[f]["hi"] - s[f]["lo"]), zones + 1) for f in use}
    counts = P.histogram(df, {f: e.tolist() for f, e in edges.items()}) if use else {}
    for f in use:
        density = np.array(counts[f], float) / (sum(counts[f]) + 1e-10)
        jumps = np.abs(np.diff(density))
        weight = np.cumsum((1 - edge) * (density + 1e-10) + edge * (np.append(jumps, jumps[-1]) + 1e-10))
        along = np.interp(probabilities(k), weight / weight[-1], (edges[f][:-1] + edges[f][1:]) / 2)
        q[f] = ((1 - edge) * np.array(q[f]) + edge * along).tolist()
    return Model({f: rising(q[f]) for f in features})


def known_methods(df: DataFrame, features: list[str], k: int = 8, method: str = "hybrid", clip: float = 1.0) -> Model:
    """Quantiles, even widths between clipping percentiles, or quantiles that fall back to even widths where too many coincide."""
    s = P.moments(df, features)
    q = P.quantiles(df, features, [*probabilities(k), clip / 100, 1 - clip / 100])

    def even(f: str) -> list[float]:
        lo, hi = q[f][k:] if clip > 0 else (s[f]["lo"], s[f]["hi"])
        if hi - lo < 1e-15:
            lo, hi = s[f]["lo"], s[f]["hi"]
        return np.linspace(lo - 1e-6, lo + 1e-6, k).tolist() if hi - lo < 1e-15 else np.linspace(lo, hi, k + 2)[1:-1].tolist()

    pick = {"quantile": lambda f: q[f][:k], "equal_width": even, "hybrid": lambda f: even(f) if len(set(q[f][:k])) < max(2, k // 2) else q[f][:k]}[method]
    return Model({f: rising(pick(f)) for f in features})


def rate_corrected(df: DataFrame, features: list[str], k: int = 8, scale: float = 0.5) -> Model:
    """Quantiles, moved by how far the share of values above them misses its target."""
    s, q = P.moments(df, features), P.quantiles(df, features, probabilities(k))
    above, want = P.share_above(df, q), 1 - np.array(probabilities(k))
    return Model({f: rising(np.array(q[f]) + (np.array(above[f]) - want) * (s[f]["sd"] + 1e-20) * 0.3 * scale) for f in features})


def fusion(df: DataFrame, features: list[str], k: int = 8, strength: float = 0.3, sparse: float = 0.3) -> Model:
    """Quantiles with three corrections in turn, for tails, skew and missed shares; near-discrete columns stay as they are."""
    s, q = P.moments(df, features), P.quantiles(df, features, probabilities(k))
    mode = P.mode_share(df, features)
    use = [f for f in features if q[f][-1] - q[f][0] >= 1e-15 and s[f]["distinct"] > max(3, k // 2) and mode[f] <= sparse]
    moved = {}
    for f in use:
        t, heavy, skew = np.array(q[f]), float(np.clip(np.clip(s[f]["kurt"], -2, 30) / 15, 0, 1)), float(np.clip(s[f]["skew"], -3, 3))
        if heavy > 0.05:
            t = _toward_centre(t, 2 * heavy * strength, 0.5 * strength * heavy)
        moved[f] = (t + (0.05 * skew * s[f]["sd"] * strength if abs(skew) > 0.3 else 0.0)).tolist()
    above = P.share_above(df, moved) if moved else {}
    for f in use:
        q[f] = (np.array(moved[f]) + (np.array(above[f]) - 1 + np.array(probabilities(k))) * s[f]["sd"] * 0.2 * strength).tolist()
    return Model({f: rising(q[f]) for f in features})


def probit_scaled(df: DataFrame, features: list[str], k: int = 8, scale: float | str = "auto") -> Model:
    """Normal quantiles around the mean in sample deviations, stretched by the weight of the longer tail."""
    s = P.moments(df, features)
    z = np.array([probit(p) for p in probabilities(k)])
    out = {}
    for f in features:
        sd = math.sqrt(max(s[f]["sd1"] ** 2, 1e-20))
        tail = max(abs(s[f]["hi"] - s[f]["mean"]), abs(s[f]["mean"] - s[f]["lo"])) / max(sd, 1e-10)
        wide = float(np.clip(0.5 * np.clip(tail, 2.4, 6.0), 1.2, 2.5 / max(abs(z[-1]), 0.1))) if scale == "auto" else float(scale)
        out[f] = rising(s[f]["mean"] + sd * z * wide)
    return Model(out)


def budgeted(df: DataFrame, features: list[str], fd: bool = True, fixed: int = 8, knots: str = "quantile", prune: bool = True, cap: bool = True) -> Model:
    """As many thresholds as Freedman and Diaconis' rule asks for, capped by Sturges' and the distinct values.

    Pruned of bits that never or always hold and of bits that equal an earlier one: bits of one feature are nested, so
    equal counts are equal bits, and one aggregation settles all. Raises where nothing is left."""
    s, q = P.moments(df, features), P.quantiles(df, features, [0.25, 0.75])
    want = {}
    for f in features:
        n, width = s[f]["n"], (s[f]["hi"] or 0.0) - (s[f]["lo"] or 0.0)
        most = max(1, s[f]["distinct"] - 1) if cap else 1 << 30
        sturges = max(1, math.ceil(math.log2(max(n, 2))) + 1)
        if n < 2 or width <= 0:
            want[f] = 0
        elif not fd:
            want[f] = min(fixed, most)
        else:
            spread = q[f][1] - q[f][0]
            want[f] = min(sturges, most) if spread <= 0 else min(max(1, math.ceil(width / (2 * spread * n ** (-1 / 3)))), sturges, most)
    got: dict[str, list[float]] = {f: [] for f in features}
    for k in sorted({k for k in want.values() if k}):
        those = [f for f in features if want[f] == k]
        if knots == "quantile":
            got |= P.quantiles(df, those, probabilities(k))
        else:
            got |= {f: [s[f]["lo"] + (s[f]["hi"] - s[f]["lo"]) * p for p in probabilities(k)] for f in those}
    got = {f: list(dict.fromkeys(t)) for f, t in got.items()}
    if prune and any(got.values()):
        share = P.share_above(df, {f: t for f, t in got.items() if t})
        for f, above in share.items():
            first = {a: t for a, t in reversed(list(zip(above, got[f], strict=True)))}
            got[f] = sorted(t for a, t in first.items() if 0 < a < 1)
    if not any(got.values()):
        raise ValueError("all features are constant: nothing to encode")
    return Model({f: sorted(t) for f, t in got.items()})


def even_bins(df: DataFrame, features: list[str], k: int = 8, strategy: str = "quantile") -> Model:
    """The inner edges of k + 1 bins of even count, even width or least squares (``kmeans``); edges that coincide merge, so
    there may be fewer. Features without values have none."""
    s = P.moments(df, features)
    live = [f for f in features if s[f]["n"]]
    out: dict[str, list[float]] = {f: [] for f in features}
    if strategy == "quantile":
        q = P.quantiles(df, live, [0.0, *probabilities(k), 1.0]) if live else {}
        out |= {f: [e for i, e in enumerate(q[f]) if i == 0 or e - q[f][i - 1] > 1e-8][1:-1] for f in live}
    elif strategy == "uniform":
        out |= {f: np.linspace(s[f]["lo"], s[f]["hi"], k + 2).tolist()[1:-1] for f in live}
    elif strategy == "kmeans":
        out |= _least_squares(df, [f for f in live if s[f]["hi"] > s[f]["lo"]], s, k + 1)
    else:
        raise ValueError(f"no such strategy: {strategy}")
    return Model(out)


def _least_squares(df: DataFrame, features: list[str], s: dict, bins: int, rounds: int = 300, tolerance: float = 1e-4) -> dict[str, list[float]]:
    """Lloyd's rounds from the middles of even bins, all features in one aggregation a round, until the centres move by less
    than the tolerance times the variance; a bin without rows moves to the value farthest from the mean of its bin."""
    centre, edges, moving = {}, {}, list(features)
    for f in features:
        ends = np.linspace(s[f]["lo"], s[f]["hi"], bins + 1)
        centre[f] = (ends[1:] + ends[:-1]) / 2
        edges[f] = (centre[f][1:] + centre[f][:-1]) / 2
    x = P.clean(df, features).persist() if features else None
    for _ in range(rounds):
        if not moving:
            break
        made = []
        for f in moving:
            full = [-math.inf, *edges[f].tolist(), math.inf]
            for i, (a, b) in enumerate(zip(full[:-1], full[1:], strict=True)):
                v = F.when((F.col(f) >= F.lit(a)) & (F.col(f) < F.lit(b)), F.col(f))
                made += [F.avg(v).alias(f"{f}|{i}"), F.min(v).alias(f"{f}|{i}|lo"), F.max(v).alias(f"{f}|{i}|hi")]
        row, still = x.agg(*made).first(), []
        for f in moving:
            full = [i for i in range(bins) if row[f"{f}|{i}"] is not None]
            far = sorted({row[f"{f}|{i}|{e}"]: abs(row[f"{f}|{i}|{e}"] - row[f"{f}|{i}"]) for i in full for e in ("lo", "hi")}.items(), key=lambda v: -v[1])
            new = np.sort([*(row[f"{f}|{i}"] for i in full), *(v for v, _ in far[: bins - len(full)])])
            new = np.sort([*new, *[new[-1]] * (bins - len(new))])
            if float(((new - centre[f]) ** 2).sum()) > tolerance * s[f]["sd"] ** 2:
                still.append(f)
            centre[f], edges[f] = new, (new[1:] + new[:-1]) / 2
        moving = still
    if x is not None:
        x.unpersist()
    return {f: sorted(set(edges[f].tolist())) for f in features}
