"""Series encoders, further online encoders, files and reports against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import baseline as B
from bitloom.operators import encoders as E
from bitloom.operators import evaluate as V
from bitloom.operators import series as T
from bitloom.sources import files as I
from bitloom.streaming import regimes as G
from bitloom.streaming import steps as S
from bitloom.streaming import trackers as K


@pytest.fixture(scope="module")
def x():
    return np.cumsum(np.random.default_rng(2).normal(size=120))


@pytest.fixture(scope="module")
def df(spark, x):
    return spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "s string, i long, v double")


def column(df, name):
    return {r["i"]: r[name] for r in df.select("i", name).collect() if r[name] is not None}


def test_frequency_bands_against_fft(df, x):
    e = np.array([np.abs(np.fft.rfft(x[t : t + 16])[1:]) ** 2 for t in range(105)]).reshape(105, 4, 2).sum(2).round(9)
    q = np.quantile(e, 0.5, axis=0)
    want = {t + 15: "".join("01"[int(b)] for b in e[t] > q) for t in range(105)}
    got = column(T.frequency_bands(df, ["s"], "i", "v"), "bands")
    assert got.keys() == want.keys() and sum(got[k] != want[k] for k in want) <= 4  # the median row itself is a tie


def test_phase_and_predicates_against_numpy(df, x):
    d = np.diff(x)
    zx, zd = x[1:] - x[1:].mean(), d - d.mean()
    r, a = np.sqrt(zx**2 + zd**2 + 1e-8), np.arctan2(zd, zx)
    place = (r >= np.quantile(r, 0.5)) * 4 + np.floor((a + math.pi) / (math.pi / 2)).astype(int)
    assert column(T.phase_plane(df, ["s"], "i", "v"), "phase") == {t + 1: "".join("01"[int(i == p)] for i in range(8)) for t, p in enumerate(place)}
    got = column(T.temporal_predicates(df, ["s"], "i", "v"), "logic")
    for t in range(112):
        s, v = np.sign(d[t : t + 8]), np.var(x[t : t + 9])
        want = [(s > 0).mean() > 0.7, (s < 0).mean() > 0.7, (np.diff(s) != 0).sum() / 7 > 0.4, v > 2 * np.var(x), v < 0.3 * np.var(x)]
        assert got[t + 8] == "".join("01"[int(b)] for b in want)


def test_entropy_and_gates(df, x):
    edges = np.linspace(x.min() - 1e-8, x.max() + 1e-8, 9)
    p = [np.histogram(x[t : t + 8], edges)[0] / 8 for t in range(113)]
    h = [-sum(v * math.log2(v) for v in row if v) for row in p]
    got = column(T.with_entropy(df, ["s"], "i", "v"), "entropy")
    assert np.allclose([got[t + 7] for t in range(113)], h)
    gate = column(T.entropy_gate(df, ["s"], "i", "v"), "gate")
    assert gate == {t + 7: int(v > np.mean(h)) for t, v in enumerate(h)}
    tau, moving = np.mean(h), {}
    for t, v in enumerate(h):
        moving[t + 7] = int(v > tau)
        tau = 0.9 * tau + 0.1 * v
    assert column(T.moving_gate(df, ["s"], "i", "v"), "gate") == moving
    bits = column(T.chronological(df, ["s"], "i", "v"), "bits")
    assert set(bits) == set(range(8, 120)) and all(len(b) == 17 for b in bits.values())  # every part over the same window
    parts = [column(f(df, ["s"], "i", "v", **more), name) for f, name, more in ((T.phase_plane, "phase", {}), (T.frequency_bands, "bands", {"window": 8}), (T.temporal_predicates, "logic", {}))]
    for i, b in bits.items():
        assert b == ("".join(p[i] for p in parts) if moving[i] else "0" * 17)
    whole = column(T.chronological(df, ["s"], "i", "v", tabular=True), "bits")
    assert whole == {i: bits.get(i, "0" * 17) for i in range(120)}
    some = column(T.chronological(df, ["s"], "i", "v", parts=("phase", "logic"), gated=False), "bits")
    assert some == {i: parts[0][i] + parts[2][i] for i in parts[2]}
    assert [g[:3] for g in T.bit_groups()] == [("phase", 0, 8), ("bands", 8, 4), ("logic", 12, 5)] and [g[:3] for g in T.bit_groups(("logic",))] == [("logic", 0, 5)]
    rows = T.learning_rows(df.withColumn("y", F.col("i") % 3), ["s"], "i", "v", "y", lags=2).collect()
    assert {r["i"]: (r["bits"], r["y"]) for r in rows} == {i: (bits[i] + bits[i - 1] + bits[i - 2], i % 3) for i in range(10, 120)}
    plane = T.soft_plane([0.0, 1.0, math.inf], 4)
    assert plane["rings"] == [0.5, 50.5] and np.allclose(plane["sectors"], np.array([-3, -1, 1, 3]) * math.pi / 4) and np.allclose(plane["ring_widths"], [0.5, 49.5], atol=1e-6)


def test_short_and_empty_series(spark, df):
    for few in (df.limit(0), df.where("i < 3"), df.withColumn("v", F.lit(None).cast("double"))):
        assert T.frequency_bands(few, ["s"], "i", "v").count() == few.count()
        assert T.chronological(few, ["s"], "i", "v").count() == 0
    got = spark.createDataFrame([([],), (None,), ([1.0],)], "a array<double>").select(T.momentum_bits(F.col("a")).alias("b")).collect()
    assert [r["b"] for r in got] == ["", None, "0"]


def test_momentum_events_and_lags(spark, df, x):
    y = np.random.default_rng(42).normal(0, 0.3, 300)
    y[80:92] += 6
    b = spark.createDataFrame([([float(v) for v in y],)], "a array<double>").select(T.momentum_bits(F.col("a")).alias("b"))
    bits = b.first()["b"]
    assert "1" in bits[80:84] and "1" not in bits[20:30]
    r = b.select(T.events(F.col("b")), T.sparsity(F.col("b")), T.compression(F.col("b"))).first()
    want = [(i, int(c)) for i, c in enumerate(bits) if not i or c != bits[i - 1]]
    assert [tuple(e) for e in r[0]] == want and r[1] == bits.count("0") / 300 and r[2] == 300 / len(want)
    lagged = column(T.stacked(df.withColumn("bits", F.col("i").cast("string")), ["s"], "i", lags=2), "bits")
    assert lagged[50] == "504948" and min(lagged) == 2
    c = spark.createDataFrame([("10",), ("11",)], "b string").select(T.clause(F.col("b"), [(0, False), (1, True), (9, True)])).collect()
    assert [r[0] for r in c] == [True, False]


@pytest.mark.parametrize("make", [K.Oscillator, K.StepSize, K.DigestQuantiles, K.SteadyMarkers, K.DualSpeed, K.DriftReset, lambda: K.DriftReset(fixed=True), lambda: K.Oscillator(11), lambda: K.StepSize(11)])
def test_online_widths_and_constant_streams(make):
    rng, machine = random.Random(1), make()
    rows = [machine.step(rng.gauss(0, 1)) for _ in range(700)] + [machine.step(1.0) for _ in range(300)]
    assert len({len(r) for r in rows}) == 1 and {b for r in rows for b in r} == {0, 1}


def test_online_levels_follow_the_quantiles():
    x = np.random.default_rng(0).normal(size=6000)
    for make in (K.DigestQuantiles, lambda: K.SteadyMarkers(latch=0.0), K.DriftReset):
        machine = make()
        rate = np.mean([machine.step(float(v))[:8] for v in x][1000:], axis=0)
        assert (np.diff(rate) <= 0).all() and abs(rate[3] - 5 / 9) < 0.12
    slow = K.DualSpeed(rest=0, latch=0.0)
    rate = np.mean([slow.step(float(v)) for v in x][1000:], axis=0)
    assert np.allclose(rate, 1 - np.arange(1, 9) / 9, atol=0.08)


def test_drift_sets_the_drift_bit():
    rng, machine = np.random.default_rng(4), K.DriftReset(fixed=True)
    rows = [machine.step(float(v)) for v in [*rng.normal(size=500), *rng.normal(40, 1, size=100)]]
    assert any(r[-1] for r in rows[500:530])


def test_first_steps_by_hand():
    m = K.StepSize()
    # The second rate is 0.05 / (1 - 0.95 ** 2), so the mean step is 1.03 and a step of 2 is over one of it, not two.
    assert m.step(1.0) == [0] * 8 and m.step(3.0) == [1, 1, 1, 0, 1, 1, 1, 0]
    o = K.Oscillator()
    assert o.step(1.0) == [0] * 8 and o.step(2.0)[0] == 1


def test_files_round_trip(spark, df, tmp_path):
    b = df.where("i < 9").select("i", F.array((F.col("i") % 2).cast("tinyint"), F.lit(1).cast("tinyint")).alias("bits"))
    assert I.write_bits(b, str(tmp_path / "m.bin"), "i") == 9
    assert (tmp_path / "m.bin").read_bytes()[:12] == bytes([9, 0, 0, 0, 2, 0, 0, 0, 0, 1, 1, 1])
    got = I.read_bits(spark, str(tmp_path / "m.bin"), 4).orderBy("row").collect()
    assert [(r["row"], r["bits"]) for r in got] == [(i, [i % 2, 1]) for i in range(9)]
    I.write_features(df, str(tmp_path / "x"), ["v"], "i")
    back = I.read_features(spark, str(tmp_path / "x"), ["v"], "i").orderBy("i").toPandas()
    assert np.allclose(back["v"], [float(f"{r['v']:.6g}") for r in df.orderBy("i").collect()]) and list(back["i"]) == list(range(120))
    I.write_results(df.limit(2), str(tmp_path / "j"))
    I.write_results(df, str(tmp_path / "j"))
    assert I.read_results(spark, [str(tmp_path / "j")], "i long, v double").count() == 2
    made = []
    for _ in range(2):
        I.once(spark, str(tmp_path / "p"), lambda: made.append(1) or df)
    assert len(made) == 1


def test_reports(spark):
    d = spark.createDataFrame([("a", 0.9995, 0.5), ("b", 0.9995, 0.97), ("c", 0.91, 0.5)], "k string, acc double, base double")
    assert [r["k"] for r in V.suspects(d, "acc", "base").collect()] == ["a"]
    assert [r["k"] for r in V.successes(d, "acc", "k", 0.9).collect()] == ["a", "b", "c"]
    g = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],), ([1.0] * 20,)], "g array<double>").select(V.sequence_credit(F.col("g"), 0.5)).collect()
    assert [r[0] for r in g] == [4 + 1 + 0.25, 0.0, pytest.approx(2 - 0.5**7)]
    t = spark.createDataFrame([([0, 3, -1, 1],)], "b array<int>").select(V.trimmed(F.col("b"), 3)).first()[0]
    assert list(t) == [0, 1, 1]


def test_replay_of_streams_is_independent(spark):
    df = spark.createDataFrame([(s, i, float((i * 7 + s) % 11)) for s in range(3) for i in range(60)], "s int, i long, v double")
    both = {(r["s"], r["i"]): r["bits"] for r in S.encode_rows(df, ["s"], "i", "v", K.DualSpeed).collect()}
    one = {(r["s"], r["i"]): r["bits"] for r in S.encode_rows(df.where("s = 1"), ["s"], "i", "v", K.DualSpeed).collect()}
    assert all(both[k] == v for k, v in one.items())


def test_incoherence_by_hand():
    m = G.Incoherence(k=2, warm_up=1)
    assert [m.step(v) for v in (1.0, 1.0, float("nan"), float("inf"))] == [[0, 0], [0, 0], [0, 0], [1, 1]]
    assert m.slow == 1 and m.n == 4 and m.step(50.0) == [1, 1]


def test_categories_hash_until_they_are_numbers():
    m = G.SignalQuantiles()
    rows = [m.step(float(i % 3)) for i in range(50)]
    assert all(len(r) == 12 for r in rows) and len({tuple(r) for r in rows[30:]}) == 3
    m.step(0.5)
    assert m.counts is None and len(m.step(1.0)) == 12 and m.counts is None
    one = G.SignalQuantiles()
    key = int(np.frombuffer(np.float64(7.0).tobytes(), np.int64)[0])
    with np.errstate(over="ignore"):
        h = ((np.array(one.a, np.int64) * np.int64(key) + np.array(one.b, np.int64)) % np.int64(2147483647)) & 1
    assert one.step(7.0) == [1, *h[1:]]


def test_followers_and_schemas(spark):
    x = np.random.default_rng(0).normal(size=3000)
    d = G.DriftFollower()
    rows = [d.step(float(v)) for v in x]
    assert not any(map(any, rows[:99])) and any(map(any, rows[99:]))
    f = G.FastFollower()
    assert {b for v in x for b in f.step(float(v))} == {0, 1}
    w = G.WarmSchema()
    w.begin(x[:600].tolist())
    assert np.allclose(w.at, np.quantile(x[:600], w.probs)) and 1 < len(w.at) <= 11
    rate = np.mean([w.step(float(v)) for v in x], axis=0)[: len(w.at)]
    assert np.allclose(rate, 1 - np.array(w.probs), atol=0.12)
    c = G.ChartedSchema()
    c.begin(x[:64].tolist())
    out = [c.step(float(v)) for v in [*x[:500], *(x[500:600] + 30)]]
    assert any(r[-1] for r in out[500:540]) and len({len(r) for r in out}) == 1
    for xs in ([], [1.0], [0.0] * 70):
        for make in (G.WarmSchema, G.ChartedSchema):
            m = make()
            m.begin(xs)
            assert all(len(m.step(v)) <= 3 for v in xs)
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([1.0, float("nan"), float("inf"), None])], "s int, i long, v double")
    assert S.encode_rows(df, ["s"], "i", "v", G.WarmSchema).count() == 1 and S.encode_rows(df, ["s"], "i", "v", G.Incoherence).count() == 4


def test_category_bits(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,), ("z",)], "x string")
    assert [r[0] for r in df.select(G.category_bits(F.col("x"), ["a", "b", "c"])).collect()] == ["0000", "0010", "0000", "0000"]
    with pytest.raises(ValueError):
        G.category_bits(F.col("x"), [str(i) for i in range(17)])


def test_reservoir_and_window_quantiles():
    x = np.random.default_rng(6).normal(size=2000)
    r, w = G.ReservoirQuantiles(size=300), G.WindowQuantiles(window=150, every=50)
    for v in x[:300]:
        r.step(float(v))
    assert np.allclose(r.at, np.quantile(x[:300], np.arange(1, 9) / 9))
    for v in x[300:]:
        r.step(float(v))
    assert len(r.kept) == 300 and np.allclose(r.at, np.quantile(x, np.arange(1, 9) / 9), atol=0.3)
    for v in x:
        w.step(float(v))
    assert np.allclose(w.at, np.quantile(x[-150:], np.arange(1, 9) / 9))


def test_least_squares_bins(spark):
    df = spark.createDataFrame([(float(c + d), 1.0) for c in (0, 10, 50) for d in (0, 1, 2)], "x double, one double")
    assert E.even_bins(df, ["x", "one"], 2, "kmeans").thresholds == {"x": [6.0, 31.0], "one": []}
    assert E.even_bins(df.limit(0), ["x"], 2).thresholds == {"x": []}


def test_models_learn(spark):
    df = spark.createDataFrame([(i, float(i % 10), None if i % 50 == 0 else float(i), "hi" if i % 10 > 4 else "lo") for i in range(300)], "i long, a double, b double, y string")
    for model in ("forest", "boosted"):
        got = B.predictions(df.where("i < 200"), df.where("i >= 200"), ["a", "b"], "y", model, trees=5)
        assert got.columns == ["i", "a", "b", "y", "predicted"] and got.where("predicted = y").count() >= 95
