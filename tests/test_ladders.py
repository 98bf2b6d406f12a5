"""Ladder and order-dependent encoders against plain NumPy versions and their invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import ladders as L
from bitloom.operators import ordered as O
from bitloom.plans import profile as P
from bitloom.plans.order import neighbours, numbered, running

LADDERS = [L.dense_bins, L.density_and_width, L.core_and_edges, L.widest_gaps, L.around_mode, L.sparse_aware, L.variance_splits, L.density_valleys, L.uncorrelated]


@pytest.fixture(scope="module")
def x():
    rng = np.random.default_rng(3)
    skew = rng.gamma(0.7, 3, 1200)
    drift = rng.normal(size=1200) + np.repeat([0, 2, 4, 9], 300)
    zero = np.where(rng.random(1200) < 0.6, 0.0, np.round(rng.gamma(2, 5, 1200), 2))
    return {"skew": skew, "drift": drift, "zero": zero, "few": rng.integers(0, 5, 1200).astype(float), "same": np.full(1200, 2.0)}


@pytest.fixture(scope="module")
def df(spark, x):
    rows = [(i, *(float(v[i]) for v in x.values())) for i in range(1200)]
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{f} double" for f in x)).cache()


@pytest.mark.parametrize("fit", LADDERS, ids=lambda f: f.__name__)
def test_thresholds_rise_and_ignore_row_order(df, fit):
    features = ["skew", "drift", "zero", "few", "same"]
    a, b = fit(df, features).thresholds, fit(df.orderBy(F.desc("i")), features).thresholds
    assert list(a) == list(b)
    for f in a:
        assert a[f] == sorted(a[f]) and np.allclose(a[f], b[f])


@pytest.mark.parametrize("fit", LADDERS, ids=lambda f: f.__name__)
def test_tables_without_values(spark, fit):
    for rows in ([], [(None,), (float("nan"),)], [(1.0,)]):
        t = fit(spark.createDataFrame(rows, "x double"), ["x"]).thresholds
        assert all(np.isfinite(v) for v in t.get("x", []))


def test_few_values_get_their_midpoints(df):
    for fit in (L.dense_bins, L.density_and_width, L.core_and_edges, L.widest_gaps, L.around_mode):
        assert fit(df, ["few"]).thresholds["few"] == [0.5, 1.5, 2.5, 3.5]
    assert L.sparse_aware(df, ["skew", "few", "same"]).thresholds["few"] == [1, 2, 3, 4]
    assert list(L.sparse_aware(df, ["skew", "few", "same"]).thresholds) == ["few", "skew"]


def test_dense_bins_against_numpy(df, x):
    v = x["skew"]
    e = np.quantile(v, np.linspace(0, 1, 257))
    narrow = np.argsort(1 / np.maximum(np.diff(e), 1e-15), kind="stable")[-21:]
    c = np.sort(((e[1:] + e[:-1]) / 2)[narrow])[np.linspace(0, 20, 7).astype(int)]
    want = np.unique([*c, *np.quantile(v, np.linspace(0.02, 0.98, 5)[1:-1])])
    assert np.allclose(L.dense_bins(df, ["skew"]).thresholds["skew"], want)


def test_core_and_mode_against_numpy(df, x):
    v = x["skew"]
    core = v[(v >= np.quantile(v, 0.15)) & (v <= np.quantile(v, 0.85))]
    want = np.unique([*np.quantile(core, np.linspace(0.05, 0.95, 8)[1:-1]), *np.quantile(v, [0.01, 0.15, 0.85, 0.99])])
    assert np.allclose(L.core_and_edges(df, ["skew"]).thresholds["skew"], want)
    z = x["zero"][x["zero"] != 0]
    assert np.allclose(L.around_mode(df, ["zero"]).thresholds["zero"], [z.min() / 2, *np.quantile(z, np.arange(1, 10) / 10)])


def test_variance_splits_against_all_pairs(spark):
    v = np.sort(np.random.default_rng(5).normal(size=90).round(1))
    df = spark.createDataFrame([(float(a),) for a in v], "x double")
    parts, cuts = [(0, 90)], []
    for _ in range(4):
        options = [((b - a) and np.var(v[a:b]) - ((s - a) * np.var(v[a:s]) + (b - s) * np.var(v[s:b])) / (b - a), a, s, b) for a, b in parts for s in range(a + 1, b)]
        g, a, s, b = max(options, key=lambda o: (round(o[0], 9), -o[1], -o[2]))
        parts.remove((a, b))
        parts += [(a, s), (s, b)]
        cuts.append((v[s - 1] + v[s]) / 2)
    assert np.allclose(L.variance_splits(df, ["x"], 4).thresholds["x"], sorted(cuts))


def test_uncorrelated_bits(df, x):
    t = L.uncorrelated(df, ["skew", "zero", "same"], 12, most=0.8).thresholds
    assert "same" not in t
    bits = np.array([x[f] >= c for f in t for c in t[f]], float)
    c = np.corrcoef(bits) - np.eye(len(bits))
    assert np.abs(c).max() <= 0.8 and (bits.var(axis=1) > 0.01).all()


def test_segments_against_numpy(df, x):
    v = x["drift"]
    segs = v.reshape(4, 300)
    drift = segs.mean(1).std() / v.std()
    n = 4 + int((0.4 * 1 + 0.6 * min(1, 2 * drift)) * 8)
    m = np.sort(segs.mean(1))
    c = np.unique([*np.quantile(segs, np.linspace(0.05, 0.95, max(2, n // 4) + 2)[1:-1], axis=1).ravel(), *(m[1:] + m[:-1]) / 2])
    want = c if len(c) <= n else c[np.linspace(0, len(c) - 1, n).astype(int)]
    assert np.allclose(O.segments(df, ["drift"], "i").thresholds["drift"], want)


def test_windows_and_recent_rows_against_numpy(df, x):
    v = x["drift"]
    q = np.array([np.quantile(v[a : a + 300], np.linspace(0.02, 0.98, 20)) for a in range(0, 901, 75)])
    c = np.unique([*np.median(q, 0), *np.percentile(q, 10, axis=0), *np.percentile(q, 90, axis=0)])
    assert np.allclose(O.sliding_windows(df, ["drift"], "i").thresholds["drift"], c[np.linspace(0, len(c) - 1, 10).astype(int)])
    p = np.arange(1, 9) / 9
    got = O.drift_robust(df, ["drift"], "i", how="none").thresholds["drift"]
    assert np.allclose(got, 0.6 * np.quantile(v, p) + 0.4 * np.quantile(v[-240:], p))


def test_levelled_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (5.0, 5.0, 5.0)], "a double, b double, c double")
    got = [list(r) for r in O.levelled(df, ["a", "b", "c"]).collect()]
    assert np.allclose(got, [[-1.224745, 0, 1.224745], [0, 0, 0]], atol=1e-5)


def test_memory_and_local_bits(spark, df, x):
    assert O.memory_length(df, ["skew"], "i") == 35 and O.memory_length(df, ["drift"], "i") <= 128
    few = df.where("i < 60").withColumn("s", F.lit(1))
    rows = {r["i"]: r["bits"] for r in O.local_bits(few, ["s"], "i", "skew", 16).collect()}
    v = x["skew"]
    assert rows == {i: "".join("01"[int(v[i] >= t)] for t in np.quantile(v[max(0, i - 16) : i + 1], np.arange(1, 6) / 6)) for i in range(60)}


def test_quantiles_by_rank_equal_numpy(spark, monkeypatch):
    """Ranges, ties, heavy values, few distinct values, infinities and nulls; more rows than the sample."""
    monkeypatch.setattr(P, "SAMPLE", 500)
    monkeypatch.setattr(P, "RANGE_ROWS", 50)
    rng = np.random.default_rng(4)
    x = {"a": rng.normal(size=6000), "b": rng.integers(0, 7, 6000).astype(float), "c": np.where(rng.random(6000) < 0.7, 0.0, rng.gamma(1, 3, 6000)), "d": np.where(np.arange(6000) % 1000 == 3, rng.normal(size=6000), np.nan), "e": np.where(np.arange(6000) % 50 == 0, np.inf, rng.normal(size=6000))}
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in zip(*x.values(), strict=True)], ", ".join(f"{f} double" for f in x)).repartition(5)
    probs = [0.0, 0.001, 1 / 9, 0.25, 0.5, 0.777, 0.97, 1.0]
    got = P.quantiles(df, list(x), probs)
    for f, v in x.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(v[~np.isnan(v)], probs)
        want[np.isnan(want)] = np.inf  # between two infinities
        assert np.allclose(got[f], want, rtol=1e-12, atol=1e-12), f
    edges = np.linspace(-3, 3, 13).tolist()
    assert P.histogram(df, {"a": edges})["a"] == np.histogram(x["a"], edges)[0].tolist()
    assert P.histogram(df, {"b": [0.0, 2.0, 6.0]})["b"] == np.histogram(x["b"], [0, 2, 6])[0].tolist()
    cuts = [-1.0, 0.0, 0.0, 1.0]
    want = [np.std(x["a"][(x["a"] >= lo) & (x["a"] < hi)]) if lo < hi else 0.0 for lo, hi in zip([-np.inf, *cuts], [*cuts, np.inf], strict=True)]
    assert np.allclose(P.deviations_between(df, {"a": cuts})["a"], want)


def test_running_sums_and_neighbours(spark):
    v = np.random.default_rng(1).permutation(5000)
    df = spark.createDataFrame([(int(a), float(a % 7)) for a in v], "k long, w double").repartition(7)
    got = running(df, "k", {"s": F.col("w")}, 16).orderBy("k").toPandas()
    assert np.allclose(got["s"], np.cumsum(np.arange(5000) % 7))
    assert numbered(df, "k", 16).where("k <> __at").count() == 0
    pairs = neighbours(df.withColumn("k", F.col("k").cast("double")), "k", 16)
    assert pairs.count() == 4999 and pairs.where("k <> before + 1").count() == 0
    assert P.mode(spark.createDataFrame([(2.0,), (1.0,), (2.0,), (1.0,), (3.0,)], "x double"), "x") == (1.0, 0.4)
