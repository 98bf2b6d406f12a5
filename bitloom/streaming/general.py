"""All-in-one online encoders: columns are sensed as categories, skewed amounts or numbers, and get bits to suit.

Step functions as in ``steps``; ``hold`` encodes without learning.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from bitloom.streaming.steps import Markers, early_rate, latched


class Categories:
    """The counts of a whole-numbered column's values, until it has a fraction or more than ``most`` values: never again then.

    Bits: one for each of the commonest values (ties to the one seen first), at most half of the width, and hash bits of the
    value for the rest."""

    def __init__(self, seed: int, width: int, most: int):
        rng = np.random.RandomState(seed)
        self.a = [int(v) for v in rng.randint(1, 1 << 31, size=width)]
        self.b = [int(v) for v in rng.randint(0, 1 << 31, size=width)]
        self.width, self.most, self.counts, self.common = width, most, {} if most else None, []

    @property
    def on(self) -> bool:
        return self.counts is not None

    def add(self, x: float) -> None:
        if self.counts is None:
            return
        whole = round(x)
        if abs(x - whole) <= 1e-9:
            self.counts[whole] = self.counts.get(whole, 0) + 1
        if abs(x - whole) > 1e-9 or len(self.counts) > self.most:
            self.counts, self.common = None, []
        else:
            self.common = sorted(self.counts, key=lambda v: -self.counts[v])[: self.width]

    def hashed(self, x: float) -> list[int]:
        (key,) = struct.unpack("<q", struct.pack("<d", x))
        return [((a * key + b + 2**63) % 2**64 - 2**63) % (2**31 - 1) & 1 for a, b in zip(self.a, self.b, strict=True)]

    def bits(self, x: float) -> list[int]:
        ranks = min(self.width // 2, len(self.common))
        return [int(x == v) for v in self.common[:ranks]] + self.hashed(x)[ranks:]


class Follow:
    """Exponential means of a column and its steps, at rates corrected for the empty start."""

    def __init__(self, fast: float, slow: float, strength: float):
        self.rates, self.n, self.last = (fast, slow, strength), 0, None
        self.mean = self.near = self.far = self.zero = self.skew = 0.0
        self.var = self.off = self.unit = self.gain = self.loss = self.now = self.usual = 1e-6
        self.positive = True

    def count(self) -> None:
        self.n += 1
        self.s, self.g, self.r = (early_rate(a, self.n) for a in self.rates)

    def start(self, x: float) -> None:
        self.mean = self.near = self.far = x

    def steps(self, x: float, d: float) -> None:
        """Short and long means, the mean step and the share of zeros."""
        self.near += self.s * (x - self.near)
        self.far += self.g * (x - self.far)
        self.unit = (1 - self.s) * self.unit + self.s * abs(d)
        self.zero = (1 - self.g) * self.zero + self.g * (abs(x) < 1e-12)

    def shape(self, x: float, d: float) -> None:
        """Mean, spread, strength, variance of the steps, sign and skew."""
        away = x - self.mean
        self.mean += self.g * away
        self.var = (1 - self.g) * (self.var + self.g * away * away)
        self.off = (1 - self.g) * self.off + self.g * abs(away)
        self.now = (1 - self.s) * self.now + self.s * (d * d)
        self.usual = (1 - self.g) * self.usual + self.g * (d * d)
        self.gain = (1 - self.r) * self.gain + self.r * max(d, 0.0)
        self.loss = (1 - self.r) * self.loss + self.r * max(-d, 0.0)
        self.positive &= x >= 0
        z = away / max(math.sqrt(max(self.var, 1e-20)), 1e-12)
        self.skew = (1 - self.g) * self.skew + self.g * (z * z * z)

    @property
    def share(self) -> float:
        return 1 - 1 / (1 + self.gain / (self.loss + 1e-12))

    def spread(self) -> float:
        """Between the deviation and the mean distance from the mean."""
        return max(math.sqrt(math.sqrt(max(self.var, 1e-20)) * (1.4826 * self.off) + 1e-20), 1e-12)


class GeneralQuantiles:
    """Categories (see ``Categories``), or marker quantiles and up to eight signals; non-negative columns whose skew passes
    ``skew`` after ``warm_up`` values go on with markers of log(1 + x). Moves, then emits. Held, steps are measured from the last
    value learnt, whatever came between."""

    #: Fixed value: the seed of the hash multipliers.
    SEED = 0xBADCAFE

    def __init__(self, quantiles: int = 12, signals: int = 4, fast: float = 0.1, slow: float = 0.01, strength: float = 0.07, most: int = 16, skew: float = 3.0, zeros: float = 0.3, warm_up: int = 200):
        self.q, self.s, self.most_skew, self.zeros, self.warm_up = quantiles, signals, skew, zeros, warm_up
        self.seen, self.at = Categories(self.SEED, quantiles + signals, most), Follow(fast, slow, strength)
        self.plain, self.logs = Markers(quantiles), None
        self.grid = np.linspace(-1, 1, quantiles + 2)[1:-1].tolist()

    def regime(self) -> str:
        """category, skewed or number."""
        return "category" if self.seen.on else "number" if self.logs is None else "skewed"

    def step(self, x: float) -> list[int]:
        return self._bits(x, True)

    def hold(self, x: float) -> list[int]:
        return self._bits(x, False)

    def _bits(self, x: float, learn: bool) -> list[int]:
        at = self.at
        if learn:
            at.count()
            if at.last is None:
                at.start(x)
            self.seen.add(x)
        last = x if at.last is None else at.last
        d = x - last
        if self.seen.on:
            if learn:
                at.steps(x, d)
                at.last = x
            return self.seen.bits(x)
        skewed = at.positive and at.n > self.warm_up and abs(at.skew) > self.most_skew and x >= 0
        if skewed and self.logs is None and learn:
            self.logs = Markers(self.q)
        markers, v = (self.logs, math.log1p(x)) if skewed and self.logs is not None else (self.plain, x)
        if learn:
            markers.add(v)
        out = [int(v >= t) for t in (self.grid if markers.height is None else markers.inner())]
        if learn:
            at.shape(x, d)
            at.steps(x, d)
            at.last = x
        one, gap, share = max(at.unit, 1e-12), at.near - at.far, at.share
        third = abs(x) < 1e-12 if at.n > self.warm_up and at.zero > self.zeros else share > 0.5
        signs = [d > 0, abs(d) > one, gap > 0, third, share > 0.7, abs(gap) > one, share < 0.3, d * (last - at.far) < 0]
        return out + [int(b) for b in signs[: self.s]]


class GeneralBand:
    """Levels around an exponential mean in units of a robust spread (of log(1 + x) for non-negative skewed columns after
    ``warm_up`` values), and 0, 4 or 8 signals. Emits, then moves; the first value gives zeros. Held, the state stands but for
    the last value, from which the next step is measured."""

    def __init__(self, levels: int = 12, signals: int = 4, fast: float = 0.1, slow: float = 0.01, strength: float = 0.07, reach: float = 2.5, logs: bool = True, skew: float = 3.0, warm_up: int = 200):
        if signals not in (0, 4, 8):
            raise ValueError("0, 4 or 8 signals")
        self.z, self.signals, self.logs, self.most_skew, self.warm_up = np.linspace(-reach, reach, levels + 2)[1:-1], signals, logs, skew, warm_up
        self.at, self.log_mean, self.log_var, self.in_logs = Follow(fast, slow, strength), 0.0, 1e-6, False

    def step(self, x: float) -> list[int]:
        out = [0] * (len(self.z) + self.signals) if self.at.last is None else self._emit(x)
        self._move(x)
        return out

    def hold(self, x: float) -> list[int]:
        out = self._emit(x)
        self.at.last = x
        return out

    def _move(self, x: float) -> None:
        at = self.at
        at.count()
        log = math.log1p(max(x, 0.0))
        if at.last is None:
            at.start(x)
            self.log_mean = log
        else:
            d = x - at.last
            at.shape(x, d)
            at.steps(x, d)
            if self.logs:
                away = log - self.log_mean
                self.log_mean += at.g * away
                self.log_var = (1 - at.g) * (self.log_var + at.g * away * away)
                self.in_logs = at.positive and at.n > self.warm_up and abs(at.skew) > self.most_skew
        at.last = x

    def _emit(self, x: float) -> list[int]:
        at = self.at
        v, mean, unit = (math.log1p(max(x, 0.0)), self.log_mean, max(math.sqrt(max(self.log_var, 1e-20)), 0.25)) if self.in_logs else (x, at.mean, at.spread())
        out = (v >= mean + self.z * unit).astype(int).tolist()
        d = x - at.last if at.last is not None else 0.0
        one, gap, share = max(at.unit, 1e-12), at.near - at.far, at.share
        signs = [d > 0, abs(d) > one, gap > 0, abs(x) < 1e-12 if at.zero > 0.3 else share > 0.5, share > 0.7, abs(gap) > one, share < 0.3, at.now > at.usual]
        return out + [int(b) for b in signs[: self.signals]]


class Universal:
    """Categories, or levels around an exponential mean and eight signals (``k`` bits in all). The first value gives hash bits.
    Moves, then emits; goes on adapting."""

    #: Fixed value: the seed of the hash multipliers.
    SEED = 0xCAFEBABE

    def __init__(self, k: int = 16, fast: float = 0.1, slow: float = 0.01, strength: float = 0.07, reach: float = 2.5, most: int = 32, latch: float = 0.0, shaped: bool = True, skew: float = 3.0, zeros: float = 0.3, warm_up: int = 200):
        if k < 4:
            raise ValueError("4 bits or more")
        self.k, self.latch, self.shaped, self.most_skew, self.zeros, self.warm_up = k, latch, shaped, skew, zeros, warm_up
        self.z = np.linspace(-reach, reach, max(0, k - 8) + 2)[1:-1]
        self.seen, self.at, self.on = Categories(self.SEED, k, most), Follow(fast, slow, strength), [0] * k

    def step(self, x: float) -> list[int]:
        at = self.at
        at.count()
        if at.last is None:
            at.start(x)
            self.seen.add(x)
            at.last, self.on = x, self.seen.hashed(x)
            return self.on
        last, d = at.last, x - at.last
        at.shape(x, d)
        at.steps(x, d)
        self.seen.add(x)
        self.on = self.seen.bits(x) if self.seen.on else self._levels(x, last, d)
        at.last = x
        return self.on

    def _levels(self, x: float, last: float, d: float) -> list[int]:
        at = self.at
        warm = self.shaped and at.n > self.warm_up
        unit = at.spread() if warm else max(math.sqrt(max(at.var, 1e-20)), 1e-12)
        v, t = x, at.mean + self.z * unit
        if warm and at.positive and abs(at.skew) > self.most_skew and x >= 0:
            v, t = math.log1p(x), math.log1p(max(at.mean, 0.0)) + self.z * max(1.4826 * math.log1p(max(at.off, 0.0)), 0.25)
        out = latched(self.on[: len(self.z)], v, t, self.latch * unit) if self.latch > 0 else (v >= t).astype(int).tolist()
        gap, above = at.near - at.far, x > at.mean
        third = abs(x) < 1e-12 if warm and at.zero > self.zeros else above
        signs = [d > 0, abs(d) > max(at.unit, 1e-12), gap > 0, at.share > 0.5, at.now > at.usual, (last > at.mean) != above, third, abs(x - at.mean) > 2 * unit]
        return (out + [int(b) for b in signs])[: self.k]
