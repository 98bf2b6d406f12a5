"""More encoders on marker quantiles of two speeds: adaptive latches, votes, self-tuning, blended leaders, sampled values.

Step functions as in ``steps``; ``hold`` encodes without learning, though latches still move.
"""

from __future__ import annotations

import math

import numpy as np

from bitloom.streaming.steps import Markers, latched


def even(k: int) -> list[float]:
    return np.linspace(0, 1, k + 2)[1:-1].tolist()


def held(on: list[int], x: float, at: list[float], latch: float) -> list[int]:
    """Bits that rise at threshold + latch and fall below threshold - latch."""
    return [int(x >= (t - latch if b else t + latch)) for b, t in zip(on, at, strict=True)]


class Pair:
    """Slow and fast markers of one column."""

    def __init__(self, k: int, slow: float, fast: float):
        self.slow, self.fast = Markers(k, slow), Markers(k, fast)

    @property
    def ready(self) -> bool:
        return self.slow.height is not None and self.fast.height is not None

    def add(self, x: float) -> None:
        self.slow.add(x)
        self.fast.add(x)

    def apart(self) -> float:
        """The largest gap between both speeds' quantiles, in slow spreads."""
        gap = max(abs(a - b) for a, b in zip(self.fast.inner(), self.slow.inner(), strict=True))
        return gap / max(self.slow.height[-2] - self.slow.height[1], 1e-6)


class Tracked:
    """Thresholds that move toward a leader's quantiles by at most a share of the local spacing, from an even grid over 0 to 1.

    A fit only shows the markers all values (``learn``), then puts the thresholds at the slow quantiles (``settle``)."""

    def __init__(self, k: int, slow: float, fast: float, least: float):
        self.pair, self.at, self.least = Pair(k, slow, fast), even(k), least

    def learn(self, x: float) -> None:
        self.pair.add(x)

    def settle(self) -> None:
        self.at = list(self.pair.slow.inner()) if self.pair.ready else [0.0] * len(self.at)

    def move(self, goal: list[float], marks: list[float], rate: float) -> list[float]:
        """The local spacings, after the thresholds have moved and been kept rising."""
        space = [max((marks[i + 2] - marks[i]) / 2, self.least) for i in range(len(self.at))]
        self.at = [t + min(max(g - t, -rate * s), rate * s) for t, g, s in zip(self.at, goal, space, strict=True)]
        for i in range(1, len(self.at)):
            if self.at[i] <= self.at[i - 1]:
                self.at[i] = self.at[i - 1] + self.least
        return space


class AdaptiveLatch(Tracked):
    """Follows slow quantiles, or fast ones while both disagree by more than ``tau``; twice as fast from 1.5 ``tau`` on, half as
    fast below half of it. A bit's latch widens while it flips often, narrows while it is steady, and is cut by ``boost`` after
    ``frozen`` values without a flip. Emits, then moves; zeros until the markers stand."""

    def __init__(self, k: int = 8, tau: float = 0.6, rate: float = 0.08, latch: float = 0.12, reach: tuple[float, float] = (0.06, 0.2), slow: float = 0.5, fast: float = 2.0, least: float = 1e-6, frozen: int = 500, boost: float = 0.6):
        super().__init__(k, slow, fast, least)
        self.tau, self.rate, self.latch, self.reach, self.frozen, self.boost = tau, rate, latch, reach, frozen, boost
        self.on, self.often, self.since = [0] * k, np.zeros(k, np.float32), [0] * k

    def step(self, x: float) -> list[int]:
        out = [0] * len(self.on)
        if self.pair.ready:
            apart = self.pair.apart()
            lead = self.pair.fast if apart > self.tau else self.pair.slow
            pace = 2.0 if apart > 1.5 * self.tau else 0.5 if apart < 0.5 * self.tau else 1.0
            space = self.move(lead.inner(), lead.height, self.rate * pace)
            for i, s in enumerate(space):
                self.since[i] += 1
                often = self.often[i]
                latch = np.float32(min(self.reach[1], self.latch * 1.5) if often > 0.3 else max(self.reach[0], self.latch * 0.7) if often < 0.05 else self.latch)
                margin = float(latch) * s * (self.boost if self.since[i] > self.frozen else 1.0)
                bit = latched([self.on[i]], x, [self.at[i]], margin)[0]
                if bit != self.on[i]:
                    self.since[i] = 0
                self.often[i] = np.float32(0.95) * often + np.float32(0.05 * (bit != self.on[i]))
                self.on[i] = bit
            out = list(self.on)
        self.pair.add(x)
        return out


class BlendedLeader(Tracked):
    """Follows a blend of slow and fast quantiles, the more of the fast the more they disagree, at a pace that grows with the
    recent variance of steps and once, by ``boost``, where a disagreement ends ``calm`` quiet values. Emits, then moves."""

    def __init__(self, k: int = 8, tau: float = 0.6, rate: float = 0.08, latch: float = 0.12, slow: float = 0.5, fast: float = 2.0, rates: tuple[float, float] = (0.1, 0.01), pace: tuple[float, float] = (0.5, 2.0), calm: int = 500, boost: float = 1.3, slope: float = 1.5, least: float = 1e-6):
        super().__init__(k, slow, fast, least)
        self.tau, self.rate, self.latch, self.rates, self.pace, self.calm, self.boost, self.slope = tau, rate, latch, rates, pace, calm, boost, slope
        self.on, self.last, self.now, self.usual, self.since, self.adrift = [0] * k, 0.0, 1e-6, 1e-6, 0, False

    def learn(self, x: float) -> None:
        super().learn(x)
        self.last = x

    def step(self, x: float) -> list[int]:
        out = [0] * len(self.on)
        if self.pair.ready:
            a, b = self.rates
            square = (x - self.last) ** 2
            self.now = (1 - a) * self.now + a * square
            self.usual = (1 - b) * self.usual + b * square
            pace = min(max(math.sqrt(self.now / (self.usual + self.least)), self.pace[0]), self.pace[1])
            apart = self.pair.apart()
            boost = self.boost if apart > self.tau and not self.adrift and self.since >= self.calm else 1.0
            self.adrift = apart > self.tau
            self.since = 0 if self.adrift else self.since + 1
            w = math.tanh(self.slope * apart)
            marks = [(1 - w) * s + w * f for s, f in zip(self.pair.slow.height, self.pair.fast.height, strict=True)]
            space = self.move(marks[1:-1], marks, min(self.rate * pace * boost, self.rate * 2.5))
            self.on = [latched([o], x, [t], self.latch * s)[0] for o, t, s in zip(self.on, self.at, space, strict=True)]
            out = list(self.on)
        self.pair.add(x)
        self.last = x
        return out


class Vote:
    """Experts of different speeds, each with thresholds that follow its fast quantiles and bits of its own; the majority's bits
    count. Moves, then emits; held, only the latches move."""

    def __init__(self, k: int = 8, experts: int = 3, speeds: tuple[float, float] = (0.5, 2.5), latch: float = 0.15, share: float = 0.2):
        self.experts = [(Markers(k, s * 1.5), even(k), [0] * k) for s in np.linspace(*speeds, experts).tolist()]
        self.latch, self.share = latch, share

    def step(self, x: float) -> list[int]:
        made = []
        for markers, at, on in self.experts:
            markers.add(x)
            made.append((markers, [self.share * g + (1 - self.share) * t for g, t in zip(markers.inner(), at, strict=True)], on))
        self.experts = made
        return self.hold(x)

    def hold(self, x: float) -> list[int]:
        self.experts = [(m, at, held(on, x, at, self.latch)) for m, at, on in self.experts]
        return [int(2 * sum(bits) > len(self.experts)) for bits in zip(*(on for *_, on in self.experts), strict=True)]


class SelfTuning:
    """Rows of several features: thresholds follow fast quantiles by a share, bits are latched; every ``every`` rows latch and
    share move, for all features together, with the mean flip rate and the mean gap of both speeds over the last ``window``
    rows. ``step`` takes a row (a list) or, with one feature, a value. Moves, then emits; held, only the latches move."""

    def __init__(self, features: int = 1, k: int = 8, latches: tuple[float, float] = (0.05, 0.3), shares: tuple[float, float] = (0.05, 0.2), speeds: tuple[float, float] = (0.5, 2.5), pace: float = 0.01, window: int = 100, every: int = 50):
        self.k, self.latches, self.shares, self.pace, self.window, self.every = k, latches, shares, pace, window, every
        self.latch, self.share, speed = float(np.mean(latches)), float(np.mean(shares)), float(np.mean(speeds))
        self.pairs = [Pair(k, speed * 0.5, speed * 1.5) for _ in range(features)]
        self.at, self.on = [even(k) for _ in range(features)], [[0] * k for _ in range(features)]
        self.n, self.flips, self.gaps = 0, [], []

    def step(self, row) -> list[int]:
        row = [row] if isinstance(row, float) else row
        before, gap = self.on, 0.0
        for i, x in enumerate(row):
            self.pairs[i].add(x)
            fast, slow = self.pairs[i].fast.inner(), self.pairs[i].slow.inner()
            self.at[i] = [t + self.share * (g - t) for t, g in zip(self.at[i], fast, strict=True)]
            gap += float(np.mean(np.abs(np.subtract(fast, slow))))
        out = self.hold(row)
        self.n += 1
        flipped = sum(a != b for old, new in zip(before, self.on, strict=True) for a, b in zip(old, new, strict=True))
        self.flips, self.gaps = [*self.flips, flipped / (len(row) * self.k)][-self.window :], [*self.gaps, gap / len(row)][-self.window :]
        if self.n % self.every == 0 and self.n >= 10:
            self.latch = float(np.clip(self.latch + (np.mean(self.flips) - 0.15) * self.pace, *self.latches))
            self.share = float(np.clip(self.share + (np.mean(self.gaps) - 0.10) * self.pace, *self.shares))
        return out

    def hold(self, row) -> list[int]:
        row = [row] if isinstance(row, float) else row
        self.on = [held(on, x, at, self.latch) for on, x, at in zip(self.on, row, self.at, strict=True)]
        return [b for on in self.on for b in on]


class SampledValues:
    """Values of a seeded uniform sample of ``size`` of all values seen (Vitter's algorithm R), evenly spaced in order, found anew
    every ``every`` values. Moves, then emits; held, thresholds stand."""

    def __init__(self, k: int = 8, size: int = 80, every: int = 100, seed: int = 1):
        self.k, self.size, self.every, self.at = k, size, every, even(k)
        self.rng, self.kept, self.n = np.random.default_rng(seed), [], 0

    def step(self, x: float) -> list[int]:
        self.n += 1
        if len(self.kept) < self.size:
            self.kept.append(x)
        elif (place := int(self.rng.integers(self.n))) < self.size:
            self.kept[place] = x
        if self.n % self.every == 0 and len(self.kept) >= self.k:
            ordered = sorted(self.kept)
            self.at = [ordered[i] for i in np.linspace(0, len(ordered) - 1, self.k, dtype=int).tolist()]
        return self.hold(x)

    def hold(self, x: float) -> list[int]:
        return [int(x >= t) for t in self.at]
