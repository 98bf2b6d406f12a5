"""Encoders that climb a ladder: few distinct values get their midpoints, many a placement of their own.

A constant feature has one bit that never holds (its value + 1e-10), a feature without values the threshold 0. Nulls and
NaN take no part. Where a published method fills up with unseeded random thresholds, the widest gaps are halved instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.thermo import midpoints, probabilities, rising, thinned
from bitloom.operators.encoders import Model
from bitloom.plans import profile as P
from bitloom.plans.order import neighbours, running


def inside(lo: float, hi: float, n: int) -> list[float]:
    """n even places strictly between lo and hi."""
    return np.linspace(lo, hi, n + 2)[1:-1].tolist()


def merged(*lists, most: int | None = None) -> list[float]:
    """All values sorted, each once, thinned to ``most``."""
    out = sorted({float(v) for values in lists for v in values})
    return out if most is None else thinned(out, most)


def only(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """The features as doubles, null where the condition fails."""
    x = P.clean(df, list(conditions))
    return x.select(*(F.when(c, F.col(f)).alias(f) for f, c in conditions.items()))


def ladder(df: DataFrame, features: list[str], most: int, place: Callable[[list[str], dict], dict[str, list[float]]]) -> Model:
    """Midpoints for features of up to ``most`` distinct values; ``place(rest, moments)`` for the others."""
    s = P.moments(df, features)
    out: dict[str, list[float]] = {}
    for f in features:
        n = s[f]["distinct"]
        if n <= 1:
            out[f] = [s[f]["lo"] + 1e-10] if n else [0.0]
        elif n <= most:
            out[f] = midpoints(P.distinct_sorted(df, f))
    rest = [f for f in features if f not in out]
    placed = place(rest, s) if rest else {}
    return Model({f: rising(out[f] if f in out else placed[f]) for f in features})


def _dense_centres(edges: list[float], n: int) -> list[float]:
    """n of the centres of the 3 n narrowest bins between quantile edges (ties to the later bin)."""
    width = np.maximum(np.diff(edges), 1e-15)
    narrow = np.argsort(1 / width, kind="stable")[-min(3 * n, len(width)) :]
    return thinned(sorted(((np.array(edges[:-1]) + edges[1:]) / 2)[narrow].tolist()), n)


def dense_and_tails(df: DataFrame, rest: list[str], s: dict, most: int, focus: float, bins: int) -> dict[str, list[float]]:
    """Centres of the densest quantile bins, and quantiles from 2 to 98 % for the other bits."""
    n_dense = max(1, int(most * focus))
    tails = inside(0.02, 0.98, most - n_dense)
    out = {}
    for b in sorted({min(bins, s[f]["distinct"]) for f in rest}):
        those = [f for f in rest if min(bins, s[f]["distinct"]) == b]
        q = P.quantiles(df, those, [*np.linspace(0, 1, b + 1).tolist(), *tails])
        out |= {f: merged(_dense_centres(q[f][: b + 1], n_dense), q[f][b + 1 :], most=most) for f in those}
    return out


def dense_bins(df: DataFrame, features: list[str], most: int = 10, focus: float = 0.7, bins: int = 256) -> Model:
    """Ladder; then the densest quantile bins' centres and tail quantiles."""
    return ladder(df, features, most, lambda rest, s: dense_and_tails(df, rest, s, most, focus, bins))


def _bits_for(most: int, distinct: int, other: float, weight: float = 0.5) -> int:
    """4 to ``most`` bits, more for more distinct values and for a larger other share (both cut at 1)."""
    spread = min(1.0, math.log2(max(distinct, 2)) / 10)
    return max(4, min(most, 4 + int((weight * spread + (1 - weight) * min(1.0, other)) * (most - 4))))


def _filled(values: list[float], n: int) -> list[float]:
    """Values up to n: the widest gap (the first of equals) is halved again and again."""
    out = sorted(set(values))
    while 1 < len(out) < n:
        i = int(np.argmax(np.diff(out)))
        middle = (out[i] + out[i + 1]) / 2
        if not out[i] < middle < out[i + 1]:
            break
        out.insert(i + 1, middle)
    return out


def density_and_width(df: DataFrame, features: list[str], most: int = 12, weight: float = 0.6) -> Model:
    """Ladder; then quantiles together with even widths from the 2nd to the 98th percentile, more bits for wider spreads."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        out = {}
        for f in rest:
            mean, sd = abs(s[f]["mean"]), s[f]["sd"]
            n = _bits_for(most, s[f]["distinct"], (sd / mean if mean > 1e-10 else sd) / 2)
            dense = max(1, int(n * weight))
            lo, hi, *q = P.quantiles(df, [f], [0.02, 0.98, *inside(0.02, 0.98, dense)])[f]
            if hi <= lo:
                lo, hi = s[f]["lo"], s[f]["hi"]
            out[f] = _filled(merged(q, inside(lo, hi, n - dense), most=n), n)
        return out

    return ladder(df, features, most, place)


def core_and_edges(df: DataFrame, features: list[str], most: int = 10, core: float = 0.6) -> Model:
    """Ladder; then quantiles of the middle 70 % and quantiles close to both ends."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        n_core = max(1, int(most * core))
        n_edge = max(1, most - n_core)
        ends = [*np.linspace(0.01, 0.15, max(1, n_edge // 2)), *np.linspace(0.85, 0.99, max(1, n_edge - n_edge // 2))][:n_edge]
        q = P.quantiles(df, rest, [0.15, 0.85, *map(float, ends)])
        middle = only(df, {f: F.col(f).between(q[f][0], q[f][1]) for f in rest})
        count = P.clean(middle, rest).agg(*(F.count(f).alias(f) for f in rest)).first()
        inner, whole = (P.quantiles(x, rest, inside(0.05, 0.95, n_core)) for x in (middle, df))
        out = {f: merged(inner[f] if count[f] > 10 else whole[f], q[f][2:], most=most) for f in rest}
        for f in rest:
            if len(out[f]) < most:
                out[f] = merged(out[f], P.quantiles(df, [f], inside(0.05, 0.95, most - len(out[f])))[f], most=most)
        return out

    return ladder(df, features, most, place)


def widest_gaps(df: DataFrame, features: list[str], most: int = 12, weight: float = 0.5, places: int = 1000) -> Model:
    """Ladder; then the middles of the widest gaps between (evenly thinned) distinct values, and quantiles."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        out = {}
        for f in rest:
            n = s[f]["distinct"]
            values = P.distinct_sorted(df, f) if n <= places else P.distinct_at(df, f, np.linspace(0, n - 1, places).astype(int).tolist())
            gaps = np.diff(values)
            usual = float(np.median(gaps))
            k = _bits_for(most, n, float(np.sum(gaps > 3 * usual)) / 10 if usual > 0 else 0.0)
            n_gap = max(1, int(k * weight))
            wide = np.argsort(gaps, kind="stable")[::-1][: 2 * n_gap]
            q = P.quantiles(df, [f], inside(0.02, 0.98, k - n_gap))[f]
            out[f] = merged(merged([(values[i] + values[i + 1]) / 2 for i in wide], most=n_gap), q, most=k)
            if len(out[f]) < 4:
                out[f] = merged(out[f], P.quantiles(df, [f], np.linspace(0.1, 0.9, max(4, k)).tolist())[f], most=k)
        return out

    return ladder(df, features, most, place)


def around_mode(df: DataFrame, features: list[str], most: int = 10, sparse: float = 0.5) -> Model:
    """Ladder; then quantiles, or, where one value has more than ``sparse`` of the rows, a separator beside that value and
    thresholds of the other values alone."""

    def place(rest: list[str], s: dict) -> dict[str, list[float]]:
        out = {}
        for f in rest:
            value, share = P.mode(df, f)
            if share <= sparse:
                q = merged(P.quantiles(df, [f], probabilities(most))[f])
                out[f] = q if len(q) == most else merged(q, P.quantiles(df, [f], np.linspace(0.01, 0.99, 3 * most).tolist())[f], most=most)
                continue
            rows = only(df, {f: F.col(f) != F.lit(value)})
            lo = rows.agg(F.min(f)).first()[0]
            apart = (value + lo) / 2 if lo > value else value
            few = s[f]["distinct"] - 1 <= most - 1
            out[f] = merged([apart], midpoints(P.distinct_sorted(rows, f)) if few else P.quantiles(rows, [f], probabilities(most - 1))[f], most=most)
        return out

    return ladder(df, features, most, place)


# --- zero-inflated columns, gaps and balance ---------------------------------------------------------------------


def _snapped(df: DataFrame, f: str, edges: list[float], ratio: float) -> list[float]:
    """Edges moved to the nearest middle between neighbouring distinct values, if the widest gap is ``ratio`` times the
    usual one (ties to the upper middle); two aggregations over the neighbours."""
    pairs = neighbours(P.clean(df, [f]), f).select((F.col(f) - F.col("before")).alias("gap"), ((F.col(f) + F.col("before")) / 2).alias("m"))
    near = [e for i, t in enumerate(edges) for e in (F.max(F.when(F.col("m") < F.lit(t), F.col("m"))).alias(f"b{i}"), F.min(F.when(F.col("m") >= F.lit(t), F.col("m"))).alias(f"a{i}"))]
    row = pairs.agg(F.percentile("gap", F.lit(0.5)).alias("usual"), F.max("gap").alias("widest"), *near).first()
    if not row["usual"] or row["widest"] <= ratio * row["usual"]:
        return merged(edges)

    def nearest(i: int, t: float) -> float:
        below, above = row[f"b{i}"], row[f"a{i}"]
        return below if above is None or below is not None and t - below < above - t else above

    return merged(nearest(i, t) for i, t in enumerate(edges))


def _balanced(df: DataFrame, f: str, edges: list[float], lo: float, hi: float) -> list[float]:
    """Each edge, or a quarter of the way to its neighbour, wherever the bit is most balanced; one pass."""
    ends = [lo, *edges, hi]
    options = [[t - (t - ends[i]) * 0.25, t, t + (ends[i + 2] - t) * 0.25] for i, t in enumerate(edges)]
    share = P.share_above(df, {f: [c for three in options for c in three]})[f]
    return merged(max(zip(three, share[3 * i : 3 * i + 3], strict=True), key=lambda o: o[1] * (1 - o[1]))[0] for i, three in enumerate(options))


def sparse_aware(df: DataFrame, features: list[str], k: int = 15, ratio: float = 5.0) -> Model:
    """Distinct values while there are k or fewer (such features come first); else up to k edges snapped to gaps and balanced,
    with fewer for columns that are mostly zero. Constant features have no bits; thresholds have single precision."""
    s = P.moments(df, features)
    single = lambda values: [float(np.float32(v)) for v in values]
    out = {f: single(P.distinct_sorted(df, f)[1:]) for f in features if 1 < s[f]["distinct"] <= k}
    rest = [f for f in features if s[f]["distinct"] > k]
    if rest:
        x = P.clean(df, rest)
        zero = x.agg(*(F.avg((F.col(f) == 0).cast("double")).alias(f) for f in rest)).first()
        above = P.moments(only(df, {f: F.col(f) > 0 for f in rest}), rest)
        for f in rest:
            out[f] = single(_edges(x, f, s[f], zero[f], above[f], k, ratio))
    return Model(out)


def _edges(x: DataFrame, f: str, all_: dict, zero: float, above: dict, k: int, ratio: float) -> list[float]:
    n, first, base = k, [], all_
    if zero > 0.3:
        others = max((all_["distinct"] - 1) * max(1 - zero, 0.01) ** 2, 2.0)
        n = max(1, min(math.ceil(math.log2(others)) + 2, k))
        if above["n"] > 10 and above["distinct"] > 1:
            first, base, x = [above["lo"] * 0.5], above, only(x, {f: F.col(f) > 0})
    left = n - len(first)
    if left <= 0:
        return first[:n]
    if base["distinct"] <= left:
        return merged(first, midpoints(P.distinct_sorted(x, f)))[:n]
    edges = _snapped(x, f, P.quantiles(x, [f], probabilities(left))[f], ratio)
    return merged(first, _balanced(x, f, edges, base["lo"], base["hi"]))[:n]


# --- splits of the sorted column ----------------------------------------------------------------------------------


class _Sorted:
    """Sorted columns as distinct values with running counts and sums; asked for a bounded list of places at a time."""

    def __init__(self, df: DataFrame, centre: dict[str, float]):
        v, self.rows = F.col("v"), {}
        for f, c in centre.items():
            counts = P.clean(df, [f]).where(F.col(f).isNotNull()).groupBy((F.col(f) - F.lit(c)).alias("v")).agg(F.count(F.lit(1)).alias("c"))
            self.rows[f] = running(counts, "v", {"n": F.col("c"), "t": F.col("c") * v, "u": F.col("c") * v * v}).persist()

    def at(self, places: dict[str, set[int]]) -> dict[str, dict[int, tuple[float, float, float]]]:
        """Place p (from 1) of each column: the p-th value, and the sum and the sum of squares of the first p; one job."""
        parts = []
        for f, wanted in places.items():
            ordered = sorted(wanted)
            marks = [float(p) for p in ordered]
            rows = self.rows[f].select("v", "t", "u", F.col("n").alias("to"), F.col("n").cast("double").alias("__n"), (F.col("n") - F.col("c")).cast("double").alias("__m"))
            rows = P.bucketed(P.bucketed(rows, "__n", marks, "b"), "__m", marks, "a").where("b > a")
            beyond = F.col("to") - F.col("p")
            asked = F.array(*map(F.lit, ordered)).cast("array<bigint>")
            rows = rows.withColumn("p", F.explode(F.slice(asked, F.col("a") + 1, F.col("b") - F.col("a"))))
            parts.append(rows.select(F.lit(f).alias("f"), "p", "v", (F.col("t") - beyond * F.col("v")).alias("t"), (F.col("u") - beyond * F.col("v") * F.col("v")).alias("u")))
        every = parts[0]
        for more in parts[1:]:
            every = every.unionByName(more)
        out: dict[str, dict[int, tuple[float, float, float]]] = {f: {} for f in places}
        for r in every.collect():  # a row a place asked for
            out[r["f"]][r["p"]] = (r["v"], r["t"], r["u"])
        return out

    def close(self) -> None:
        for rows in self.rows.values():
            rows.unpersist()


def variance_splits(df: DataFrame, features: list[str], k: int = 8, places: int = 200) -> Model:
    """Greedy splits of the sorted column, each at the place (of ``places`` in each interval) that lowers an interval's
    variance most; k in all, filled up evenly over the range. All features advance together, a job a round."""
    s, out = P.moments(df, features), {}
    cuts: dict[str, list[float]] = {f: [s[f]["lo"] or 0.0] if s[f]["n"] < 2 else [] for f in features}
    best: dict[str, dict] = {f: {} for f in features}
    fresh = {f: [(0, s[f]["n"])] for f in features if s[f]["n"] >= 2 and s[f]["hi"] > s[f]["lo"]}
    col = _Sorted(df, {f: s[f]["mean"] for f in fresh})
    while fresh:
        tried = {f: {i: _places(*i, places) for i in spans} for f, spans in fresh.items()}
        asked = {f: {p for (lo, hi), c in t.items() if len(c) for p in (max(lo, 1), hi, *(lo + c).tolist(), *(lo + c + 1).tolist())} for f, t in tried.items()}
        asked = {f: p for f, p in asked.items() if p}
        got = col.at(asked) if asked else {}
        for f, t in tried.items():
            best[f] |= {i: _best_split(got.get(f, {}), *i, c) for i, c in t.items()}
        fresh = {}
        for f in best:
            if len(cuts[f]) < k and any(best[f].values()):
                span = max((i for i in best[f] if best[f][i]), key=lambda i: (best[f][i][0], -i[0]))
                _, at, cut = best[f].pop(span)
                cuts[f].append(cut + s[f]["mean"])
                if len(cuts[f]) < k:
                    fresh[f] = [(span[0], at), (at, span[1])]
    col.close()
    for f in features:
        lo, hi = s[f]["lo"] or 0.0, s[f]["hi"] or 0.0
        own = cuts[f] or [lo]
        out[f] = rising([*own, *inside(lo, hi, k - len(own))])
    return Model(out)


def _places(lo: int, hi: int, most: int) -> np.ndarray:
    n = hi - lo
    return np.unique(np.linspace(1, n - 1, most).astype(int)) if n > most else np.arange(1, n)


def _best_split(got: dict, lo: int, hi: int, cuts: np.ndarray) -> tuple[float, int, float] | None:
    """(gain, place, threshold) of the best split of the sorted values lo + 1 to hi; none for constant or single ones."""
    n = hi - lo
    if n < 2:
        return None
    t0, u0 = got[lo][1:] if lo else (0.0, 0.0)
    t, u = got[hi][1] - t0, got[hi][2] - u0
    var = lambda t, u, n: max(u / n - (t / n) ** 2, 0.0)
    whole, best = var(t, u, n), None
    if whole < 1e-20:
        return None
    for c in cuts.tolist():
        a, b = got[lo + c][1] - t0, got[lo + c][2] - u0
        gain = whole - (c * var(a, b, c) + (n - c) * var(t - a, u - b, n - c)) / n
        if best is None or gain > best[0]:
            best = (gain, lo + c, (got[lo + c][0] + got[lo + c + 1][0]) / 2)
    return best


def density_valleys(df: DataFrame, features: list[str], k: int = 8) -> Model:
    """The deepest local minima of a smoothed histogram, filled up with quantiles."""
    s = P.moments(df, features)
    out = {f: inside(s[f]["lo"] or 0.0, s[f]["hi"] or 0.0, k) for f in features}
    for f in features:
        bins = min(200, s[f]["n"] // 5 + 1)
        if bins < 3 or s[f]["hi"] <= s[f]["lo"]:
            continue
        edges = np.linspace(s[f]["lo"], s[f]["hi"], bins + 1)
        wide = max(3, bins // 20)
        smooth = np.convolve(P.histogram(df, {f: edges.tolist()})[f], np.ones(wide, int), mode="same")
        low = [i for i in range(1, bins - 1) if smooth[i] < smooth[i - 1] and smooth[i] < smooth[i + 1]]
        found = [(edges[i] + edges[i + 1]) / 2 for i in sorted(low, key=lambda i: smooth[i])[:k]]
        out[f] = [*found, *(P.quantiles(df, [f], probabilities(k - len(found)))[f] if len(found) < k else [])]
    return Model({f: rising(t) for f, t in out.items()})


# --- bits that repeat others -------------------------------------------------------------------------------------


def uncorrelated(df: DataFrame, features: list[str], k: int = 8, most: float = 0.95, ahead: int = 20, pairs: int = 5000) -> Model:
    """Quantile bits without near-constant ones (variance up to 0.01) and without those that correlate by more than ``most``
    with an earlier kept one; each is held against the next ``ahead`` bits still there, ``pairs`` in all at most.

    A kept bit is held against the others in one aggregation."""
    q = P.quantiles(df, features, probabilities(k))
    x = P.clean(df, features)
    bits = [(f, t) for f in features for t in q[f]]
    on = lambda b: F.coalesce(F.col(b[0]) >= F.lit(b[1]), F.lit(False))
    row = x.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(on(b)).alias(str(i)) for i, b in enumerate(bits))).first()
    n = max(row["n"], 1)
    p = [row[str(i)] / n for i in range(len(bits))]
    live = [i for i in range(len(bits)) if p[i] * (1 - p[i]) > 0.01]
    budget, gone, kept = min(pairs, 10 * len(live)), set(), []
    both: dict[tuple[int, int], float] = {}

    def joint(i: int, others: list[int]) -> None:
        got = x.agg(*(F.count_if(on(bits[i]) & on(bits[j])).alias(str(j)) for j in others)).first()
        both.update({(i, j): got[str(j)] / n for j in others})

    for i in live:
        if i in gone:
            continue
        kept.append(i)
        others = [j for j in live if j > i and j not in gone][:ahead]
        if budget <= 0 or not others:
            continue
        budget -= len(others)
        joint(i, others)
        for j in others:
            r = (both[i, j] - p[i] * p[j]) / math.sqrt(p[i] * (1 - p[i]) * p[j] * (1 - p[j]))
            if abs(r) > most:
                gone.add(j)
    out: dict[str, list[float]] = {}
    for i in kept:
        out.setdefault(bits[i][0], []).append(bits[i][1])
    return Model(out)
