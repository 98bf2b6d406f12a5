"""Statistics of many columns in single aggregations; results are a few numbers a column."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.plans.order import numbered

#: Rows a feature that a sample brings to the driver, and rows a range holds on average while there are few ranges.
SAMPLE, RANGE_ROWS, MOST_RANGES = 20_000, 20_000, 20_000


def clean(df: DataFrame, features: list[str]) -> DataFrame:
    """The features as doubles, NaN as null, so that aggregates leave both out."""
    return df.select(*(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features))


def moments(df: DataFrame, features: list[str]) -> dict[str, dict]:
    """n, lo, hi, mean, sd (population), sd1 (sample), skew, kurt (population, excess), distinct, of each feature; one pass
    for the moments and one for the distinct counts."""
    x = clean(df, features)
    made = []
    for f in features:
        c = F.col(f)
        for name, e in (("n", F.count(c)), ("lo", F.min(c)), ("hi", F.max(c)), ("mean", F.avg(c)), ("sd", F.stddev_pop(c)), ("sd1", F.stddev_samp(c)), ("skew", F.skewness(c)), ("kurt", F.kurtosis(c))):
            made.append(e.alias(f"{f}|{name}"))
    row = x.agg(*made).first().asDict()
    count = x.agg(*(F.count_distinct(F.col(f)).alias(f) for f in features)).first()
    out = {f: {k: row[f"{f}|{k}"] for k in ("n", "lo", "hi", "mean", "sd", "sd1", "skew", "kurt")} | {"distinct": count[f]} for f in features}
    for s in out.values():
        s |= {k: s[k] or 0.0 for k in ("sd", "sd1", "skew", "kurt")}
    return out


def bucketed(x: DataFrame, feature: str, bounds: list[float], name: str) -> DataFrame:
    """x with ``name``, how many of the rising bounds a value has reached (null for null)."""
    cut = Bucketizer(splits=[-math.inf, *(bounds or [0.0]), math.inf], inputCol=feature, outputCol=name, handleInvalid="keep")
    return cut.transform(x).withColumn(name, F.when(F.col(feature).isNotNull(), F.col(name).cast("int")))


def by_bucket(df: DataFrame, cuts: dict[str, list[float]], *made: Column) -> dict[str, dict[int, tuple]]:
    """``made`` (aggregates of ``v``) of each feature's values between its rising cuts, one aggregation of all features:
    {feature: {bucket: values}} for the buckets that have any."""
    x = clean(df, list(cuts))
    for i, (f, bounds) in enumerate(cuts.items()):
        x = bucketed(x, f, bounds, f"__k{i}")
    cells = F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"__k{i}").alias("k"), F.col(f).alias("v")) for i, f in enumerate(cuts)))
    rows = x.select(F.explode(cells).alias("c")).select("c.*").where("k is not null").groupBy("f", "k").agg(*made).collect()
    out: dict[str, dict[int, tuple]] = {f: {} for f in cuts}
    for f, k, *values in rows:
        out[list(cuts)[f]][k] = tuple(values)
    return out


def quantiles(df: DataFrame, features: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Exact, linearly interpolated quantiles of all features: the rows around each are found by rank.

    Bounds from a sample cut each feature into ranges; one pass counts them, and only the ranges that hold wanted ranks are
    summed by value and put in order, so no task sees more than a range. Tables no larger than the sample are sorted as
    they are."""
    x = clean(df, features)
    count = x.agg(*(F.count(f).alias(f) for f in features), F.count(F.lit(1)).alias("__n")).first()
    some = x if count["__n"] <= SAMPLE else x.sample(min(1.0, 1.1 * SAMPLE / count["__n"]), seed=11)
    some = some.toPandas()
    values = {f: np.sort(some[f].dropna().to_numpy(float)) for f in features}
    live = [f for f in features if count[f]]
    ranks = {f: sorted({int(r) for p in probs for r in (math.floor(p * (count[f] - 1)), math.ceil(p * (count[f] - 1)))}) for f in live}
    if count["__n"] <= SAMPLE:
        at = {f: {r: float(values[f][r]) for r in ranks[f]} for f in live}
    else:
        at = _by_rank(x, {f: ranks[f] for f in live}, {f: values[f] for f in live})

    def between(f: str, p: float) -> float:
        place = p * (count[f] - 1)
        a, b = at[f][math.floor(place)], at[f][math.ceil(place)]
        return a if a == b else a + (b - a) * (place - math.floor(place))

    return {f: [between(f, p) for p in probs] if count[f] else [] for f in features}


def _by_rank(x: DataFrame, ranks: dict[str, list[int]], sample: dict[str, np.ndarray]) -> dict[str, dict[int, float]]:
    """The values at these ranks (from 0) of each feature's order."""
    cuts = {}
    for f, v in sample.items():
        n = min(MOST_RANGES, max(256, max(ranks[f]) // RANGE_ROWS))
        v = v[np.isfinite(v)]
        cuts[f] = np.unique(v[np.linspace(0, len(v) - 1, min(n, len(v))).astype(int)]).tolist() if len(v) else []
    found = by_bucket(x, cuts, F.count(F.lit(1)), F.min("v"), F.max("v"))
    out: dict[str, dict[int, float]] = {f: {} for f in ranks}
    want: list[tuple[int, int, int]] = []  # feature, range, rank within it
    for i, f in enumerate(ranks):
        keys = sorted(found[f])
        ends = np.cumsum([found[f][k][0] for k in keys])
        for r in ranks[f]:
            j = int(np.searchsorted(ends, r, "right"))
            n, lo, hi = found[f][keys[j]]
            inner = r - int(ends[j] - n)
            if lo == hi or inner in (0, n - 1):
                out[f][r] = lo if inner == 0 else hi
            else:
                want.append((i, keys[j], inner, r))
    if not want:
        return out
    names = list(ranks)
    for i, f in enumerate(names):
        x = bucketed(x, f, cuts[f], f"__k{i}")
    hit = [F.when(F.col(f"__k{i}").isin(sorted({k for j, k, *_ in want if j == i})), F.struct(F.lit(i).alias("f"), F.col(f"__k{i}").alias("k"), F.col(f).alias("v"))) for i, f in enumerate(names) if any(j == i for j, *_ in want)]
    counts = x.select(F.explode(F.array_compact(F.array(*hit))).alias("c")).select("c.*").groupBy("f", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("to", F.sum("n").over(Window.partitionBy("f", "k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    asked = x.sparkSession.createDataFrame([(i, k, inner, r) for i, k, inner, r in want], "__f int, __k int, __inner long, __r long")
    got = counts.join(F.broadcast(asked), (F.col("f") == F.col("__f")) & (F.col("k") == F.col("__k")) & (F.col("__inner") < F.col("to")) & (F.col("__inner") >= F.col("to") - F.col("n")))
    for row in got.select("f", "__r", "v").collect():
        out[names[row["f"]]][row["__r"]] = row["v"]
    return out


def distinct_sorted(df: DataFrame, feature: str, limit: int | None = None) -> list[float]:
    """The sorted distinct values; limit: how many places to keep, spread evenly from the first (i * n / limit)."""
    values = clean(df, [feature]).where(F.col(feature).isNotNull()).distinct()
    n = values.count()
    if limit is None or n <= limit:
        return [r[0] for r in values.orderBy(feature).collect()]
    return distinct_at(df, feature, [int(i * n / limit) for i in range(limit)])


def distinct_at(df: DataFrame, feature: str, places: list[int]) -> list[float]:
    """The distinct values at these places (from 0) of their order; only they are brought back."""
    values = clean(df, [feature]).where(F.col(feature).isNotNull()).distinct()
    wanted = numbered(values, feature).where(F.col("__at").isin([int(p) for p in places]))
    return [r[0] for r in wanted.select(feature).orderBy(feature).collect()]


def share_above(df: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, list[float]]:
    """P(x >= t) for every threshold, one pass."""
    features = list(thresholds)
    x = clean(df, features)
    row = x.agg(*(F.avg((F.col(f) >= F.lit(t)).cast("double")).alias(f"{f}|{i}") for f in features for i, t in enumerate(thresholds[f]))).first()
    return {f: [row[f"{f}|{i}"] or 0.0 for i in range(len(thresholds[f]))] for f in features}


def mode_share(df: DataFrame, features: list[str]) -> dict[str, float]:
    """The commonest value's share of each feature (values rounded to 8 places)."""
    return {f: mode(df, f, 8)[1] for f in features}


def mode(df: DataFrame, feature: str, places: int | None = None) -> tuple[float, float]:
    """The commonest value (ties to the smallest) and its share; 0 of nothing."""
    v = F.col(feature) if places is None else F.bround(feature, places)
    counts = clean(df, [feature]).where(F.col(feature).isNotNull()).groupBy(v.alias("v")).count()
    row = counts.agg(F.max(F.struct("count", (-F.col("v")).alias("v"))).alias("m"), F.sum("count").alias("n")).first()
    return (0.0 - row["m"]["v"], row["m"]["count"] / row["n"]) if row["n"] else (0.0, 0.0)


def deviations_between(df: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[float]]:
    """Population deviation of the values in each bin between rising cuts (0 for bins of one value or none), one pass."""
    unique = {f: sorted(set(map(float, c))) for f, c in cuts.items()}
    found = by_bucket(df, unique, F.stddev_pop("v"))
    out = {}
    for f, edges in cuts.items():  # of equal cuts only the last bin has values
        place = [0, *(unique[f].index(float(e)) + 1 for e in edges)]
        last = [i + 1 == len(place) or place[i + 1] != p for i, p in enumerate(place)]
        out[f] = [(found[f].get(p, (0.0,))[0] or 0.0) if end else 0.0 for p, end in zip(place, last, strict=True)]
    return out


def histogram(df: DataFrame, edges: dict[str, list[float]]) -> dict[str, list[int]]:
    """Counts between rising edges (the last bin holds its upper end), one pass."""
    found = by_bucket(df, {f: list(map(float, e)) for f, e in edges.items()}, F.count(F.lit(1)), F.count_if(F.col("v").isin([float(e[-1]) for e in edges.values()])), F.min("v"))
    out = {}
    for f, e in edges.items():
        n = [found[f].get(k, (0, 0, None))[0] for k in range(1, len(e))]
        top = found[f].get(len(e), (0, 0, None))
        n[-1] += top[1] if top[2] == float(e[-1]) else 0
        out[f] = n
    return out
