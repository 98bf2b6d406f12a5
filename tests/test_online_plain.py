"""Every online encoder bit for bit against a plain version written with arrays, on the events' streams."""

import math

import numpy as np
import pytest

from bitloom import registry
from bitloom.streaming import duals as D
from bitloom.streaming import general as N
from bitloom.streaming import regimes as G
from bitloom.streaming import steps as S
from bitloom.streaming import trackers as K


DATA = "/root/testdata/sf0.001"
P8 = np.arange(1, 9) / 9


class P2:
    """P-square with k + 2 markers as arrays: positions, desired positions, parabolic or linear moves."""

    def __init__(self, k=8, speed=1.0):
        self.m, self.speed, self.buffer, self.q, self.count = k + 2, speed, [], None, 0

    def update(self, x):
        if self.q is None:
            self.buffer.append(x)
            if len(self.buffer) == self.m:
                self.q, self.n, self.count = np.sort(self.buffer), np.arange(1.0, self.m + 1), self.m
            return
        q, n = self.q, self.n
        self.count += 1
        if x < q[0]:
            q[0], k = x, 0
        elif x >= q[-1]:
            q[-1], k = x, self.m - 2
        else:
            k = int(np.searchsorted(q, x, "right")) - 1
        n[k + 1 :] += 1
        want = 1 + (self.count - 1) * np.linspace(0, 1, self.m)
        for i in range(1, self.m - 1):
            d = (want[i] - n[i]) * self.speed
            if (d >= 1 and n[i + 1] - n[i] > 1) or (d <= -1 and n[i - 1] - n[i] < -1):
                s = 1.0 if d >= 0 else -1.0
                new = q[i] + s / (n[i + 1] - n[i - 1]) * ((n[i] - n[i - 1] + s) * ((q[i + 1] - q[i]) / (n[i + 1] - n[i])) + (n[i + 1] - n[i] - s) * ((q[i] - q[i - 1]) / (n[i] - n[i - 1])))
                if not q[i - 1] < new < q[i + 1]:
                    j = i + int(s)
                    new = q[i] + s * (q[j] - q[i]) / (n[j] - n[i])
                q[i] = new
                n[i] += s

    def inner(self):
        return np.zeros(self.m - 2) if self.q is None else self.q[1:-1]

    def all(self):
        return np.zeros(self.m) if self.q is None else self.q


def text(rows):
    return ["".join(str(int(b)) for b in r) for r in rows]


def schmitt(on, x, t, m):
    return np.where(on == 0, x >= t + m, ~(x <= t - m)).astype(int)


def half_open(on, x, t, h):
    return np.where(on == 1, x >= t - h, x >= t + h).astype(int)


def eff(a, t):
    return a if t >= 200 else min(a / max(1 - (1 - a) ** t, 1e-12), 1)


def markers_after(xs):
    p, out = P2(), []
    for x in xs:
        p.update(x)
        out.append(x >= p.inner() if p.q is not None else np.zeros(8))
    return out


def markers_before(xs):
    p, out = P2(), []
    for x in xs:
        out.append(x >= p.inner())
        p.update(x)
    return out


def steady(xs):
    p, on, out = P2(), np.zeros(8), []
    for x in xs:
        on = half_open(on, x, p.inner(), 0.03)
        out.append(on)
        p.update(x)
    return out


def digest(xs):
    v, w, out = np.zeros(0), np.zeros(0), []
    for x in xs:
        o = np.argsort(v, kind="stable")
        t = np.interp(P8, np.cumsum(w[o]) / w.sum(), v[o]) if len(v) else np.zeros(8)
        out.append(x >= t)
        v, w = np.append(v, x), np.append(w, 1.0)
        if len(v) > 100:
            o = np.argsort(v, kind="stable")
            v, w = v[o], w[o]
            nv, nw = list(v[:50]), list(w[:50])
            for i in range(50, len(v), 2):
                nw.append(w[i : i + 2].sum())
                nv.append((v[i : i + 2] * w[i : i + 2]).sum() / nw[-1])
            v, w = np.array(nv), np.array(nw)
    return out


def dual(xs, mode):
    """The dual-speed encoders: latch ('rest'), adaptive ('adapt'), blended ('blend')."""
    slow, fast = P2(speed=0.5), P2(speed=2.0)
    t, on, out = np.linspace(0, 1, 10)[1:-1], np.zeros(8, int), []
    wait, ema, since = np.zeros(8, int), np.zeros(8, np.float32), np.zeros(8, int)
    now = usual = 1e-6
    run, adrift, prev = 0, False, 0.0
    tau = 0.4 if mode == "rest" else 0.6
    for x in xs:
        bits = np.zeros(8, int)
        if slow.q is not None:
            gap = np.abs(fast.inner() - slow.inner()).max() / max(slow.q[-2] - slow.q[1], 1e-6)
            full, eta = (fast.q if gap > tau else slow.q), 0.08
            if mode == "adapt":
                eta = 0.08 * (2.0 if gap > tau * 1.5 else 0.5 if gap < tau * 0.5 else 1.0)
            if mode == "blend":
                d2 = (x - prev) ** 2
                now, usual = 0.9 * now + 0.1 * d2, 0.99 * usual + 0.01 * d2
                boost = 1.3 if gap > tau and not adrift and run >= 500 else 1.0
                adrift = gap > tau
                run = 0 if adrift else run + 1
                w = np.tanh(1.5 * gap)
                full = (1 - w) * slow.q + w * fast.q
                eta = min(0.08 * np.clip(np.sqrt(now / (usual + 1e-6)), 0.5, 2.0) * boost, 0.2)
            s = np.maximum(0.5 * (full[2:] - full[:-2]), 1e-6)
            t = t + np.clip(full[1:-1] - t, -eta * s, eta * s)
            for k in range(1, 8):
                if t[k] <= t[k - 1]:
                    t[k] = t[k - 1] + 1e-6
            if mode == "rest":
                new = schmitt(on, x, t, 0.12 * s)
                new = np.where(wait > 0, on, new)
                wait = np.where(wait > 0, wait - 1, np.where(new != on, 1, 0))
            elif mode == "blend":
                new = schmitt(on, x, t, 0.12 * s)
            else:
                since += 1
                h = np.where(ema > 0.3, np.float32(min(0.2, 0.18)), np.where(ema < 0.05, np.float32(max(0.06, 0.12 * 0.7)), np.float32(0.12))).astype(np.float32)
                new = schmitt(on, x, t, h.astype(float) * s * np.where(since > 500, 0.6, 1.0))
                flip = new != on
                since[flip] = 0
                ema = np.float32(0.95) * ema + np.float32(0.05) * flip.astype(np.float32)
            on = new
            bits = on
        out.append(bits)
        slow.update(x)
        fast.update(x)
        prev = x
    return out


def vote(xs):
    speeds, out = np.linspace(0.5, 2.5, 3), []
    ps, ts, ons = [P2(speed=1.5 * s) for s in speeds], np.tile(np.linspace(0, 1, 10)[1:-1], (3, 1)), np.zeros((3, 8), int)
    for x in xs:
        for p in ps:
            p.update(x)
        ts = 0.2 * np.array([p.inner() for p in ps]) + 0.8 * ts
        ons = half_open(ons, x, ts, 0.15)
        out.append(ons.sum(0) > 1.5)
    return out


def tuning(xs):
    slow, fast, t, on, out = P2(speed=0.75), P2(speed=2.25), np.linspace(0, 1, 10)[1:-1], np.zeros(8, int), []
    h, eta, flips, gaps = 0.175, 0.125, [], []
    for i, x in enumerate(xs, 1):
        slow.update(x)
        fast.update(x)
        t = t + eta * (fast.inner() - t)
        gaps.append(np.abs(fast.inner() - slow.inner()).mean())
        new = half_open(on, x, t, h)
        flips.append((new != on).mean())
        on = new
        out.append(on)
        if i % 50 == 0:
            h = np.clip(h + (np.mean(flips[-100:]) - 0.15) * 0.01, 0.05, 0.3)
            eta = np.clip(eta + (np.mean(gaps[-100:]) - 0.10) * 0.01, 0.05, 0.2)
    return out


def follower(xs):
    p, t, on, out = P2(speed=1.5), np.linspace(0, 1, 10)[1:-1], np.zeros(8, int), []
    for x in xs:
        p.update(x)
        t = 0.3 * p.all()[:8] + 0.7 * t
        on = half_open(on, x, t, 0.05)
        out.append(on)
    return out


def drift_follower(xs):
    fast, slow, out = P2(speed=2.0), P2(speed=0.3), [np.zeros(8)] * min(99, len(xs))
    if len(xs) < 100:
        return out
    t, on = np.quantile(xs[:100], P8), np.zeros(8, int)
    for x in xs[:100]:
        fast.update(x)
        slow.update(x)
    for x in xs[99:]:
        fast.update(x)
        slow.update(x)
        t = t + 0.1 * (2.0 if np.abs(fast.all() - slow.all()).mean() > 0.1 else 1.0) * (fast.all()[:8] - t)
        on = half_open(on, x, t, 0.15)
        out.append(on)
    return out


def drift_reset(xs, fixed):
    from statistics import NormalDist

    z8, p, out = np.array([NormalDist().inv_cdf(v) for v in P8]), P2(), []
    mu = prev = xs[0]
    t, mad, boost, n, mean, cum, low = np.full(8, xs[0]), 1.0, 0, 0, 0.0, 0.0, 0.0
    for x in xs:
        s = max(mad, 1e-6)
        z = (x - mu) / s
        if p.q is not None:
            t = p.inner().copy()
        elif len(p.buffer) >= 2:
            t = np.quantile(p.buffer, P8)
        out.append([*((z >= z8) if fixed else (x >= t)), x > mu, abs(x - prev) > s, boost > 0])
        a = min(0.02 * (6.0 if boost else 1.0), 0.9)
        mu += a * (x - mu)
        mad += a * (abs(x - mu) - mad)
        n += 1
        mean += (abs(z) - mean) / n
        cum += abs(z) - mean - 0.25
        low = min(low, cum)
        p.update(x)
        if cum - low > 8.0:
            boost, cum, low, p = 50, 0.0, 0.0, P2()
        boost, prev = max(boost - 1, 0), x
    return out


def hash_bits(x, seed, width):
    rng = np.random.RandomState(seed)
    a, b = rng.randint(1, 1 << 31, size=width).astype(np.int64), rng.randint(0, 1 << 31, size=width).astype(np.int64)
    key = np.array([x]).view(np.int64)[0]
    with np.errstate(over="ignore"):
        return ((a * key + b) % np.int64(2147483647)) & 1


def sensed(xs, kind):
    """The three column-sensing encoders on marker quantiles or bands: 'signal', 'general', 'universal'."""
    q, s, most, zeros, seed = {"signal": (8, 4, 16, 0.3, 0xC0FFEE), "general": (12, 4, 16, 0.3, 0xBADCAFE), "universal": (8, 8, 32, 0.3, 0xCAFEBABE)}[kind]
    width, counts, out = q + s, {}, []
    plain, logs = P2(q), None
    mu = near = far = zero = skew = 0.0
    var = mad = atr = gain = loss = vs = vl = 1e-6
    prev, positive = None, True
    band = np.linspace(-2.5, 2.5, q + 2)[1:-1]
    grid = np.linspace(-1, 1, q + 2)[1:-1]
    for t, x in enumerate(xs, 1):
        f, g, r = eff(0.1, t), eff(0.01, t), eff(0.07, t)
        first = prev is None
        if first:
            mu = near = far = x
        if counts is not None:
            k = round(x)
            if abs(x - k) > 1e-9:
                counts = None
            else:
                counts[k] = counts.get(k, 0) + 1
                counts = None if len(counts) > most else counts
        if kind == "universal" and first:
            out.append(hash_bits(x, seed, width))
            prev = x
            continue
        p = x if first else prev
        d = x - p
        skewed = positive and t > 200 and abs(skew) > 3 and x >= 0
        if kind == "signal":
            skewed = False
        bits = None
        if counts is None and kind != "universal":
            if skewed and logs is None:
                logs = P2(q)
            tracker, v = (logs, math.log1p(x)) if skewed else (plain, x)
            tracker.update(v)
            bits = list((v >= (grid if tracker.q is None else tracker.inner())).astype(int))
        if counts is None or kind == "universal":
            away = x - mu
            mu += g * away
            var = (1 - g) * (var + g * away * away)
            mad = (1 - g) * mad + g * abs(away)
            vs, vl = (1 - f) * vs + f * d * d, (1 - g) * vl + g * d * d
            gain, loss = (1 - r) * gain + r * max(d, 0.0), (1 - r) * loss + r * max(-d, 0.0)
            positive = positive and x >= 0
            skew = (1 - g) * skew + g * (away / max(np.sqrt(max(var, 1e-20)), 1e-12)) ** 3
        near, far = near + f * (x - near), far + g * (x - far)
        atr, zero = (1 - f) * atr + f * abs(d), (1 - g) * zero + g * (abs(x) < 1e-12)
        if counts is not None:
            top = sorted(counts, key=lambda k: -counts[k])[: width // 2]
            out.append([*(int(x == k) for k in top), *hash_bits(x, seed, width)[len(top) :]])
            prev = x
            continue
        rsi, macd, one = 1 - 1 / (1 + gain / (loss + 1e-12)), near - far, max(atr, 1e-12)
        if kind == "universal":
            sigma = np.sqrt(max(var, 1e-20))
            scale = max(np.sqrt(sigma * 1.4826 * mad + 1e-20), 1e-12) if t > 200 else max(sigma, 1e-12)
            v, th = x, mu + band * scale
            if positive and t > 200 and abs(skew) > 3 and x >= 0:
                v, th = np.log1p(x), np.log1p(max(mu, 0.0)) + band * max(1.4826 * np.log1p(max(mad, 0.0)), 0.25)
            is_zero = t > 200 and zero > zeros
            bits = [*(v >= th), d > 0, abs(d) > one, macd > 0, rsi > 0.5, vs > vl, ((p - mu) > 0) != ((x - mu) > 0), abs(x) < 1e-12 if is_zero else x > mu, abs(x - mu) > 2 * scale]
        else:
            is_zero = zero > zeros and (kind == "signal" or t > 200)
            bits += [d > 0, abs(d) > one, macd > 0, abs(x) < 1e-12 if is_zero else rsi > 0.5]
        out.append(bits)
        prev = x
    return out


def band(xs):
    """The fast general encoder: levels in units of a robust spread, log(1 + x) for skewed amounts; emits, then moves."""
    z, out, prev, positive, active = np.linspace(-2.5, 2.5, 14)[1:-1], [], None, True, False
    mu = near = far = zero = skew = lmu = 0.0
    var = mad = atr = gain = loss = lvar = 1e-6
    for t, x in enumerate(xs, 1):
        if prev is None:
            out.append(np.zeros(16))
            mu = near = far = prev = x
            lmu = np.log1p(max(x, 0))
            continue
        d = x - prev
        scale = max(np.sqrt(np.sqrt(max(var, 1e-20)) * 1.4826 * mad + 1e-20), 1e-12)
        th = (np.log1p(max(x, 0)) >= lmu + z * max(np.sqrt(max(lvar, 1e-20)), 0.25)) if active else (x >= mu + z * scale)
        rsi = 1 - 1 / (1 + gain / (loss + 1e-12))
        out.append([*th, d > 0, abs(d) > max(atr, 1e-12), near - far > 0, abs(x) < 1e-12 if zero > 0.3 else rsi > 0.5])
        f, g, r = eff(0.1, t), eff(0.01, t), eff(0.07, t)
        away = x - mu
        mu += g * away
        var = (1 - g) * (var + g * away * away)
        mad = (1 - g) * mad + g * abs(away)
        near, far = near + f * (x - near), far + g * (x - far)
        atr = (1 - f) * atr + f * abs(d)
        gain, loss = (1 - r) * gain + r * max(d, 0), (1 - r) * loss + r * max(-d, 0)
        zero = (1 - g) * zero + g * (abs(x) < 1e-12)
        skew = (1 - g) * skew + g * (away / max(np.sqrt(max(var, 1e-20)), 1e-12)) ** 3
        positive = positive and x >= 0
        away = np.log1p(max(x, 0)) - lmu
        lmu += g * away
        lvar = (1 - g) * (lvar + g * away * away)
        active = positive and t > 200 and abs(skew) > 3
        prev = x
    return out


def sampled(xs):
    rng, kept, t, out = np.random.default_rng(1), [], np.linspace(0, 1, 10)[1:-1], []
    for n, x in enumerate(xs, 1):
        if n <= 80:
            kept.append(x)
        else:
            j = int(rng.integers(n))
            if j < 80:
                kept[j] = x
        if n % 100 == 0:
            t = np.sort(kept)[np.linspace(0, len(kept) - 1, 8, dtype=int)]
        out.append(x >= t)
    return out


def incoherent(xs):
    f32, out = np.float32, []
    a, b, eps = f32(0.1), f32(0.1 * 0.1), f32(1e-8)
    fast = slow = var = None
    for n, x in enumerate(xs):
        v = f32(x)
        if n == 0:
            fast, slow, var = v, v, eps
        else:
            fast = a * v + (f32(1) - a) * fast
            slow = b * v + (f32(1) - b) * slow
            var = a * (v - slow) ** 2 + (f32(1) - a) * var
        sd = np.sqrt(var + eps)
        out.append([int(n >= 20 and abs(v - slow) / sd + abs(fast - slow) / sd > 2.5)])
    return out


def fd_count(v, cap):
    spread = np.subtract(*np.percentile(v, [75, 25]))
    return cap if spread <= 0 else min(max(int(np.ceil((v.max() - v.min()) / (2 * spread * len(v) ** (-1 / 3)))), 1), cap)


def kept_quantiles(v, k):
    probs, seen = [], set()
    for p in np.arange(1, k + 1) / (k + 1):
        c = int((v >= np.quantile(v, p)).sum())
        if 0 < c < len(v) and c not in seen:
            seen.add(c)
            probs.append(p)
    return np.array(probs)


def schema(xs, charted):
    xs = np.array(xs)
    warm = xs[: 64 if charted else 600]
    cap = max(1, math.ceil(math.log2(max(len(warm), 2))) + 1)
    few = len(np.unique(warm)) <= (cap if charted else 13) and (not charted or np.allclose(warm, np.round(warm)))
    limit = min(cap, max(1, len(np.unique(warm)) - 1)) if charted else min(12, cap, max(1, len(np.unique(warm)) - 1))
    probs = None if few else kept_quantiles(warm, fd_count(warm, limit))
    t = np.unique(warm)[1:] if few else np.quantile(warm, probs)
    has_zero = (warm == 0).mean() > ((1 / (len(t) + 1) if len(t) else 0.5) if charted else 0.3)
    mu, prev, hold, left, out = warm.mean(), warm[-1], (64 if charted else 400), 0, []
    mad = max(np.abs(warm - mu).mean(), 1e-12 if charted else 1e-6)
    n = ref = cum = low = ew = var = 0.0
    var, horizon, recent = 1e-6, float(len(warm)), list(warm)[-hold:]
    for x in xs:
        one = max(mad, 1e-12 if charted else 1e-9)
        out.append([*(x >= t), *([x == 0] if has_zero else []), abs(x - prev) > one, left > 0])
        z = abs((x - mu) / one)
        a, lam = (2 / (horizon + 1), 2 / 65) if charted else (0.02, 0.0)
        mu += a * (x - mu)
        mad = (1 - a) * mad + a * abs(x - mu)
        n += 1
        recent = [*recent, x][-hold:]
        if charted:
            horizon += 1
            ew += lam * (z - ew)
            d = z - ref
            ref += d / n
            var += d * (z - ref)
            if ew > ref + 3 * max(math.sqrt(var / n) * math.sqrt(lam / (2 - lam)), 1e-9) and len(recent) >= 8:
                t = t if few else np.quantile(recent, probs)
                horizon, ew, left = float(len(t) + 2), ref, 8
        else:
            ref += (z - ref) / n
            cum += z - ref - 0.25
            low = min(low, cum)
            if cum - low > 10 and len(recent) >= 20:
                t = t if few else np.quantile(recent, probs)
                left, cum, low = 60, 0.0, 0.0
        left, prev = max(left - 1, 0), x
    return out


PLAIN = {
    "marker_quantiles_online": markers_after,
    "marker_quantiles_before_online": markers_before,
    "steady_markers_online": steady,
    "digest_quantiles_online": digest,
    "dual_speed_online": lambda xs: dual(xs, "rest"),
    "adaptive_latch_online": lambda xs: dual(xs, "adapt"),
    "blended_leader_online": lambda xs: dual(xs, "blend"),
    "vote_online": vote,
    "self_tuning_online": tuning,
    "fast_follower_online": follower,
    "drift_follower_online": drift_follower,
    "drift_reset_online": lambda xs: drift_reset(xs, False),
    "drift_reset_fixed_online": lambda xs: drift_reset(xs, True),
    "signal_quantiles_online": lambda xs: sensed(xs, "signal"),
    "general_quantiles_online": lambda xs: sensed(xs, "general"),
    "universal_online": lambda xs: sensed(xs, "universal"),
    "general_band_online": band,
    "sampled_values_online": sampled,
    "incoherence_online": incoherent,
    "warm_schema_online": lambda xs: schema(xs, False),
    "charted_schema_online": lambda xs: schema(xs, True),
}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_equals_a_plain_version(spark, name):
    data = DATA.replace("0.001", "0.01")
    events = spark.read.parquet(f"{data}/events.parquet").select("event_type", "event_id", "value").toPandas()
    got = {(r["event_type"], r["event_id"]): r["bits"] for r in registry.queries()[name](spark, data).collect()}
    want = {}
    for kind, rows in events.sort_values("event_id").groupby("event_type"):
        want |= dict(zip(((kind, i) for i in rows["event_id"]), text(PLAIN[name]([float(v) for v in rows["value"]])), strict=True))
    assert len(got) == len(want) and [k for k in want if got[k] != want[k]] == []


STREAMS = {
    "skewed": np.round(np.random.default_rng(1).pareto(1.2, 900), 6),
    "category": np.random.default_rng(2).integers(0, 5, 700).astype(float),
    "mostly zero": np.where(np.random.default_rng(3).random(800) < 0.6, 0.0, np.random.default_rng(4).gamma(2, 5, 800).round(4)),
    "then a number": np.concatenate([np.random.default_rng(5).integers(0, 4, 150), np.random.default_rng(6).normal(size=400)]).astype(float),
    "drifting": np.concatenate([np.random.default_rng(7).normal(size=700), np.random.default_rng(8).normal(30, 2, 400)]),
}
MACHINES = {
    "signal": (G.SignalQuantiles, lambda xs: sensed(xs, "signal")),
    "general": (N.GeneralQuantiles, lambda xs: sensed(xs, "general")),
    "universal": (N.Universal, lambda xs: sensed(xs, "universal")),
    "band": (N.GeneralBand, band),
    "adapt": (D.AdaptiveLatch, lambda xs: dual(xs, "adapt")),
    "blend": (D.BlendedLeader, lambda xs: dual(xs, "blend")),
    "rest": (K.DualSpeed, lambda xs: dual(xs, "rest")),
    "tuning": (D.SelfTuning, tuning),
    "vote": (D.Vote, vote),
    "reset": (K.DriftReset, lambda xs: drift_reset(xs, False)),
}


@pytest.mark.parametrize("stream", STREAMS)
@pytest.mark.parametrize("name", MACHINES)
def test_regimes_equal_plain_versions(name, stream):
    make, plain = MACHINES[name]
    machine, xs = make(), [float(v) for v in STREAMS[stream]]
    got = text([machine.step(x) for x in xs])
    want = text(plain(xs))
    assert [i for i, (a, b) in enumerate(zip(got, want, strict=True)) if a != b] == []


def replayed(spark, xs):
    return spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(xs)], "s string, i long, v double")


def test_fit_then_frozen_transform(spark):
    """Machines are kept after one table and encode another without learning: levels stand, latches and last values as each says."""
    xs, ys = STREAMS["drifting"][:300], STREAMS["drifting"][650:760]
    for make in (N.GeneralBand, N.GeneralQuantiles, D.Vote, D.SelfTuning, D.SampledValues, K.SteadyMarkers, G.FastFollower, G.DriftFollower, G.Incoherence):
        models = S.fitted(replayed(spark, xs), ["s"], "i", "v", make)
        got = [r["bits"] for r in S.encode_fitted(replayed(spark, ys), models, ["s"], "i", "v", make).orderBy("i").collect()]
        machine = make()
        for x in xs:
            machine.step(float(x))
        assert got == text([machine.hold(float(y)) for y in ys])
    band_ = N.GeneralBand()
    for x in xs:
        band_.step(float(x))
    mean, unit = band_.at.mean, band_.at.spread()
    got = [band_.hold(float(y)) for y in ys]
    assert [r[:12] for r in got] == [(y >= mean + band_.z * unit).astype(int).tolist() for y in ys]
    assert [r[12] for r in got[1:]] == (np.diff(ys) > 0).astype(int).tolist()  # steps between the rows encoded


def test_fit_shows_markers_only(spark):
    """Dual-speed encoders learn by showing their markers all values; then thresholds are the slow quantiles and go on adapting."""
    xs, ys = STREAMS["drifting"][:300], STREAMS["drifting"][650:700]
    for make in (K.DualSpeed, D.AdaptiveLatch, D.BlendedLeader):
        got = [r["bits"] for r in S.encode_fitted(replayed(spark, ys), S.fitted(replayed(spark, xs), ["s"], "i", "v", make), ["s"], "i", "v", make).orderBy("i").collect()]
        machine, slow = make(), P2(speed=0.5)
        for x in xs:
            machine.learn(float(x))
            slow.update(float(x))
        machine.settle()
        assert np.allclose(machine.at, slow.inner()) and got == text([machine.step(float(y)) for y in ys])


def test_not_finite_values_are_skipped_live_and_replayed(spark, tmp_path):
    xs = [1.0, float("nan"), 2.0, None, float("inf"), 3.5, 0.5, float("-inf"), 2.5] * 12
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "s string, i long, v double")
    for n, make in enumerate((S.MovingBand, K.DriftReset, G.SignalQuantiles, G.ChartedSchema)):
        want = sorted(map(tuple, S.encode_rows(df, ["s"], "i", "v", make).collect()))
        plain = [x for x in xs if x is not None and math.isfinite(x)]
        assert len(want) == len(plain) == 60 and len({r[2] for r in want}) > 1
        where = str(tmp_path / f"in{n}")
        for part in range(3):
            df.where(f"i >= {part * 36} and i < {part * 36 + 36}").coalesce(1).write.mode("append").parquet(where)
        live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(where)
        if make is G.ChartedSchema:
            continue  # 60 values never fill its warm-up of 64
        q = S.encode_live(live, "s", "i", "v", make).writeStream.format("memory").queryName(f"live{n}").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(f"live{n}").collect())) == want


def test_a_warm_up_lives_in_the_state(spark, tmp_path):
    df = replayed(spark, STREAMS["drifting"][:150])
    for part in range(3):
        df.where(f"i >= {part * 50} and i < {part * 50 + 50}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.encode_live(live, "s", "i", "v", G.ChartedSchema).writeStream.format("memory").queryName("warm").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("warm").collect())) == sorted(map(tuple, S.encode_rows(df, ["s"], "i", "v", G.ChartedSchema).collect()))


def test_several_features_tune_one_latch():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(200, 3))
    machine = D.SelfTuning(features=3)
    out = [machine.step([float(v) for v in r]) for r in rows]
    assert {len(o) for o in out} == {24} and machine.latch != 0.175 and len(machine.flips) == 100
