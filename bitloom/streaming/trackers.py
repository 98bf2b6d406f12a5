"""More online encoders as step functions (see ``steps``): signals, digests, dual-speed quantiles, drift-reset bands."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

from bitloom.functions.thermo import probabilities
from bitloom.streaming.steps import Markers, early_rate


class Oscillator:
    """Eight signals (up, crossed the mean, gain share over 0.5 and 0.7, short mean over long, their gap over the mean step,
    variance rising, above the mean), then levels of the gain share; moves, then emits; the first value gives zeros."""

    def __init__(self, k: int = 8, short: float = 0.1, long: float = 0.02, strength: float = 0.07):
        self.k, self.rates, self.n, self.last = k, (short, long, strength), 0, None
        self.levels = np.linspace(0, 1, max(k - 8, 0) + 2)[1:-1].tolist()
        self.mean = self.near = self.far = self.unit = self.gain = self.loss = self.now = self.usual = 0.0

    def step(self, x: float) -> list[int]:
        self.n += 1
        if self.last is None:
            self.last = self.mean = self.near = self.far = x
            return [0] * self.k
        s, g, r = (early_rate(a, self.n) for a in self.rates)
        d, before = x - self.last, self.last
        self.mean += g * (x - self.mean)
        self.near += s * (x - self.near)
        self.far += g * (x - self.far)
        self.unit += s * (abs(d) - self.unit)
        self.gain += r * (max(d, 0.0) - self.gain)
        self.loss += r * (max(-d, 0.0) - self.loss)
        self.now += s * (d * d - self.now)
        self.usual += g * (d * d - self.usual)
        share = 1 - 1 / (1 + self.gain / (self.loss + 1e-12))
        gap, above = self.near - self.far, x > self.mean
        self.last = x
        signs = [d > 0, (before > self.mean) != above, share > 0.5, share > 0.7, gap > 0, abs(gap) > self.unit, self.now > self.usual, above]
        return [int(b) for b in [*signs, *(share >= v for v in self.levels)][: self.k]]


class StepSize:
    """Eight bits of the last step against the mean step (up, over 0.5, 1 and 2 of it, momentum up, strong, near the fading
    maximum, faster than before), then levels up to four mean steps; moves, then emits; the first value gives zeros."""

    def __init__(self, k: int = 8, unit_rate: float = 0.05, momentum_rate: float = 0.1, fade: float = 0.999):
        self.k, self.rates, self.fade = k, (unit_rate, momentum_rate), fade
        self.levels = np.linspace(0, 4, max(k - 8, 0) + 1)[1:].tolist()
        self.n, self.last, self.change, self.unit, self.speed, self.top = 0, None, None, 0.0, 0.0, 0.0

    def step(self, x: float) -> list[int]:
        self.n += 1
        if self.last is None:
            self.last = self.top = x
            return [0] * self.k
        u, m = (early_rate(a, self.n) for a in self.rates)
        d = x - self.last
        self.unit += u * (abs(d) - self.unit)
        self.speed += m * (d - self.speed)
        self.top = max(self.top * self.fade, x)
        size, one = abs(d), max(self.unit, 1e-12)
        out = [d > 0, size > one / 2, size > one, size > 2 * one, self.speed > 0, abs(self.speed) > one / 2, x >= self.top - one, self.change is not None and d > self.change]
        self.last, self.change = x, d
        return [int(b) for b in [*out, *(size / one >= v for v in self.levels)][: self.k]]


class DigestQuantiles:
    """Quantiles from a bounded list of centroids; beyond ``size`` the upper half of them merge in pairs. Emits, then moves."""

    def __init__(self, k: int = 8, size: int = 100):
        self.p, self.size = probabilities(k), size
        self.marks: list[tuple[float, int]] = []

    def step(self, x: float) -> list[int]:
        t = [0.0] * len(self.p)
        if self.marks:
            c = np.array(sorted(self.marks, key=lambda m: m[0]), float)
            t = np.interp(self.p, np.cumsum(c[:, 1]) / c[:, 1].sum(), c[:, 0])
        self.marks.append((x, 1))
        if len(self.marks) > self.size:
            c = sorted(self.marks, key=lambda m: m[0])
            low, high = c[: self.size // 2], c[self.size // 2 :]
            pairs = [high[i : i + 2] for i in range(0, len(high), 2)]
            self.marks = low + [(sum(v * n for v, n in p) / sum(n for _, n in p), sum(n for _, n in p)) for p in pairs]
        return [int(x >= v) for v in t]


class SteadyMarkers:
    """Marker quantiles with a small absolute latch; emits, then moves."""

    def __init__(self, k: int = 8, speed: float = 1.0, latch: float = 0.03):
        self.markers, self.latch, self.bits = Markers(k, speed), latch, [0] * k

    def step(self, x: float) -> list[int]:
        self.hold(x)
        self.markers.add(x)
        return self.bits

    def hold(self, x: float) -> list[int]:
        """Without moving the markers; the latches do move."""
        self.bits = [int(x >= (t - self.latch if b else t + self.latch)) for b, t in zip(self.bits, self.markers.inner(), strict=True)]
        return self.bits


class DualSpeed:
    """Thresholds that follow slow marker quantiles, or fast ones while both disagree by more than ``tau`` of the slow
    spread, by at most ``rate`` local spacings a value; bits are latched and rest ``rest`` values after a flip. Emits,
    then moves; zeros until the markers stand; thresholds start from an even grid over 0 to 1."""

    def __init__(self, k: int = 8, tau: float = 0.4, rate: float = 0.08, latch: float = 0.12, rest: int = 1, slow: float = 0.5, fast: float = 2.0):
        self.slow, self.fast = Markers(k, slow), Markers(k, fast)
        self.tau, self.rate, self.latch, self.rest = tau, rate, latch, rest
        self.at, self.bits, self.wait = np.linspace(0, 1, k + 2)[1:-1].tolist(), [0] * k, [0] * k

    def learn(self, x: float) -> None:
        """A fit: only the markers see the values ..."""
        self.slow.add(x)
        self.fast.add(x)

    def settle(self) -> None:
        """... and then the thresholds are the slow quantiles."""
        self.at = list(self.slow.inner()) if self.slow.height is not None and self.fast.height is not None else [0.0] * len(self.at)

    def step(self, x: float) -> list[int]:
        out = [0] * len(self.bits)
        if self.slow.height is not None and self.fast.height is not None:
            apart = max(abs(a - b) for a, b in zip(self.fast.inner(), self.slow.inner(), strict=True))
            leader = self.fast if apart / max(self.slow.height[-2] - self.slow.height[1], 1e-6) > self.tau else self.slow
            h = leader.height
            space = [max((h[i + 2] - h[i]) / 2, 1e-6) for i in range(len(self.at))]
            for i, s in enumerate(space):
                self.at[i] += min(max(h[i + 1] - self.at[i], -self.rate * s), self.rate * s)
            for i in range(1, len(self.at)):
                if self.at[i] <= self.at[i - 1]:
                    self.at[i] = self.at[i - 1] + 1e-6
            for i, s in enumerate(space):
                if self.wait[i]:
                    self.wait[i] -= 1
                    continue
                side = x > self.at[i] - self.latch * s if self.bits[i] else x >= self.at[i] + self.latch * s
                if int(side) != self.bits[i]:
                    self.bits[i], self.wait[i] = int(side), self.rest
            out = list(self.bits)
        self.slow.add(x)
        self.fast.add(x)
        return out


class DriftReset:
    """Levels of marker quantiles (or, ``fixed``, of normal quantiles around an exponential mean in mean deviations), with a
    trend, a burst and a drift bit. A Page-Hinkley test on the distance from the mean speeds the means up for a while
    and starts the markers anew. Emits, then moves."""

    def __init__(self, k: int = 8, fixed: bool = False, rate: float = 0.02, slack: float = 0.25, limit: float = 8.0, boost: float = 6.0, steps: int = 50, temporal: bool = True):
        self.k, self.fixed, self.rate, self.slack, self.limit, self.boost, self.steps, self.temporal = k, fixed, rate, slack, limit, boost, steps, temporal
        self.z = [NormalDist().inv_cdf(p) for p in probabilities(k)]
        self.mean = self.last = None
        self.unit, self.left, self.n, self.usual, self.sum, self.low = 1.0, 0, 0, 0.0, 0.0, 0.0
        self.markers, self.at = Markers(k), None

    def _levels(self) -> list[float]:
        if self.markers.height is not None:
            self.at = self.markers.inner()
        elif len(self.markers.first) >= 2:
            self.at = np.quantile(self.markers.first, probabilities(self.k)).tolist()
        return self.at

    def step(self, x: float) -> list[int]:
        if self.mean is None:
            self.mean, self.last, self.at = x, x, [x] * self.k
        unit = max(self.unit, 1e-6)
        z = (x - self.mean) / unit
        out = [int(z >= v) for v in self.z] if self.fixed else [int(x >= t) for t in self._levels()]
        if self.temporal:
            out += [int(x > self.mean), int(abs(x - self.last) > unit), int(self.left > 0)]
        a = min(self.rate * (self.boost if self.left else 1.0), 0.9)
        self.mean += a * (x - self.mean)
        self.unit += a * (abs(x - self.mean) - self.unit)
        self.n += 1
        self.usual += (abs(z) - self.usual) / self.n
        self.sum += abs(z) - self.usual - self.slack
        self.low = min(self.low, self.sum)
        self.markers.add(x)
        if self.sum - self.low > self.limit:
            self.left, self.sum, self.low, self.markers = self.steps, 0.0, 0.0, Markers(self.k)
        self.left, self.last = max(self.left - 1, 0), x
        return out
