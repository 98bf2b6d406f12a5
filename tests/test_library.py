"""Encoders, online steps, preparation and reports against DuckDB, NumPy and their invariants."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom import registry
from bitloom.functions.thermo import bits, probit, rising
from bitloom.operators import encoders as E
from bitloom.operators import prep as R
from bitloom.streaming import steps as S

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    c = sorted(got.columns)
    assert c == sorted(want.columns)
    got, want = (x[c].sort_values(c).reset_index(drop=True) for x in (got, want))
    assert got.astype(str).equals(want.astype(str))


@pytest.mark.parametrize("name", sorted(n for n in set(registry.queries()) - set(registry.oracle_sql()) if not n.endswith("_online")))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_bits_of_null_nan_and_ties(spark):
    rows = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (float("inf"),), (float("-inf"),)], "x double")
    assert [r[0] for r in rows.select(bits(F.col("x"), [1.0, 2.0])).collect()] == [[0, 0], [0, 0], [1, 0], [1, 1], [0, 0]]


def test_rising_and_probit():
    assert rising([2, 1, 1]) == [1.0, 1.0 + 1e-10, 2.0]
    assert probit(0.5) == pytest.approx(0, abs=1e-3) and probit(0.975) == pytest.approx(1.96, abs=1e-3)


def test_budgeted_has_no_dead_or_duplicate_bits(spark):
    df = spark.createDataFrame([(float(i % 7), 5.0, math.exp(i / 50)) for i in range(500)], "a double, c double, e double")
    model = E.budgeted(df, ["a", "c", "e"])
    assert model.thresholds["c"] == []
    for f in ("a", "e"):
        ones = [r["ones"] for r in model.ones(df).where(F.col("feature") == f).collect()]
        assert len(set(ones)) == len(ones) and all(0 < o < 500 for o in ones)
    with pytest.raises(ValueError):
        E.budgeted(df, ["c"])


def test_fits_ignore_row_order(spark):
    df = spark.createDataFrame([(float(i * 37 % 101),) for i in range(400)], "x double")
    for fit in (E.quantile, E.kurtosis_blend, E.bin_pulse, E.density_edges, E.fusion, E.rate_corrected):
        a, b = fit(df, ["x"]).thresholds["x"], fit(df.orderBy(F.desc("x")), ["x"]).thresholds["x"]
        assert np.allclose(a, b) and a == sorted(a)


def test_density_edges_and_fusion_against_numpy(spark):
    x = np.random.default_rng(0).gamma(0.5, 2, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    p = np.arange(1, 9) / 9
    q = np.quantile(x, p)
    span = np.ptp(x)
    edges = np.linspace(x.min() - 0.02 * span, x.max() + 0.02 * span, 33)
    d = np.histogram(x, edges)[0] / (len(x) + 1e-10)
    j = np.abs(np.diff(d))
    w = np.cumsum(0.7 * (d + 1e-10) + 0.3 * (np.append(j, j[-1]) + 1e-10))
    want = 0.7 * q + 0.3 * np.interp(p, w / w[-1], (edges[1:] + edges[:-1]) / 2)
    assert np.allclose(E.density_edges(df, ["x"]).thresholds["x"], want)
    z = (x - x.mean()) / x.std()
    heavy, skew = min(max(np.mean(z**4) - 3, 0) / 15, 1), min(np.mean(z**3), 3)
    u = np.linspace(-1, 1, 8)
    t = q[0] + (q[-1] - q[0]) * (np.sign(u) * np.abs(u) ** (1 + 0.6 * heavy) + 1) / 2
    t = (1 - 0.15 * heavy) * q + 0.15 * heavy * t + 0.05 * skew * x.std() * 0.3
    t = t + ((x[:, None] >= t).mean(0) - 1 + p) * x.std() * 0.06
    assert np.allclose(E.fusion(df, ["x"]).thresholds["x"], t)


def test_markers_approach_the_quantiles():
    m = S.Markers(8)
    x = np.random.default_rng(1).normal(size=20000)
    for v in x:
        m.add(float(v))
    assert np.allclose(m.inner(), np.quantile(x, np.arange(1, 9) / 9), atol=0.05)


def test_replay_equals_live_stream(spark, tmp_path):
    rows = [(s, i, math.sin(i * (s + 1)) * 10) for s in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "s int, i long, v double")
    make = lambda: S.MovingBand(latch=0.1)
    want = sorted(map(tuple, S.encode_rows(df, ["s"], "i", "v", make).collect()))
    for part in range(3):
        df.where(f"i >= {part * 40} and i < {part * 40 + 40}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.encode_live(live, "s", "i", "v", make).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("live").collect())) == want


def test_series_helpers(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([],), ([5.0, 5.0],)], "a array<double>")
    got = df.select(R.padded(F.col("a"), 4), R.normalised(F.col("a")), R.decimated(F.col("a"), 2)).collect()
    assert [r[0] for r in got] == [[1, 2, 3, 3], [0, 0, 0, 0], [5, 5, 5, 5]]
    assert np.allclose(got[0][1], [-1.224745, 0, 1.224745], atol=1e-5) and got[2][1] == [0, 0] and got[0][2] == [1, 3]
