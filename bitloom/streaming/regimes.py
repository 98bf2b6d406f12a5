"""Online encoders that learn what kind of column they see: incoherence, hashed categories, warm-up schemas, followers.

Step functions as in ``steps``. A machine with ``warm`` is first given up to that many values by ``begin`` and encodes them
afterwards too (see ``steps.encode_rows``).
"""

from __future__ import annotations

import math
import struct
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import deque
from itertools import accumulate

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from bitloom.functions.thermo import between, places, probabilities
from bitloom.streaming.steps import Markers, early_rate


class Incoherence:
    """Levels of how far a value is from a slow mean and the fast from the slow one, in deviations: over j reach / k.

    Moves, then emits, zeros for the first ``warm_up`` values. Means have single precision. An infinite value sets all
    bits, NaN none, and neither moves the state (but both count)."""

    takes_all = True

    def __init__(self, k: int = 1, alpha: float = 0.1, reach: float = 2.5, warm_up: int = 20):
        self.levels = [(j + 1) * reach / k for j in range(k)]
        self.fast_rate, self.slow_rate, self.warm_up, self.n = np.float32(alpha), np.float32(alpha * alpha), warm_up, 0
        self.tiny = np.float32(1e-8)
        self.fast, self.slow, self.var = np.float32(0), np.float32(0), self.tiny

    def step(self, x: float) -> list[int]:
        self.move(x)
        return self.bits(x) if self.n > self.warm_up else [0] * len(self.levels)

    def move(self, x: float) -> None:
        v, one = np.float32(x), np.float32(1)
        if self.n == 0:
            self.fast = self.slow = v if math.isfinite(x) else np.float32(0)
        elif math.isfinite(x):
            self.fast = self.fast_rate * v + (one - self.fast_rate) * self.fast
            self.slow = self.slow_rate * v + (one - self.slow_rate) * self.slow
            self.var = self.fast_rate * (v - self.slow) ** 2 + (one - self.fast_rate) * self.var
        self.n += 1

    def hold(self, x: float) -> list[int]:
        return self.bits(x)

    def bits(self, x: float) -> list[int]:
        """The bits of a value against the state as it stands."""
        if not math.isfinite(x):
            return [int(not math.isnan(x))] * len(self.levels)
        sd = np.sqrt(self.var + self.tiny)
        score = abs(np.float32(x) - self.slow) / sd + abs(self.fast - self.slow) / sd
        return [int(score > t) for t in self.levels]


def category_bits(x: Column, values: list[str]) -> Column:
    """The place of a category among up to 16 values as four bits, the highest first; 0000 for others and null."""
    if len(values) > 16:
        raise ValueError(f"{len(values)} categories, at most 16")
    if not values:
        return F.lit("0000")
    place = F.coalesce(F.array_position(F.array(*map(F.lit, values)), x.cast("string")) - 1, F.lit(0))
    return F.lpad(F.bin(F.greatest(place, F.lit(0))), 4, "0")


class SignalQuantiles:
    """Marker quantiles (against an even grid from -1 to 1 until the markers stand) and up to eight signals; whole-numbered
    columns of up to ``most`` values are categories instead: one bit for the commonest values, hash bits for the rest.
    Moves, then emits. A column once out of the categories stays out."""

    #: Fixed value: the seed of the hash multipliers.
    SEED = 0xC0FFEE

    def __init__(self, quantiles: int = 8, signals: int = 4, fast: float = 0.1, slow: float = 0.01, strength: float = 0.07, zeros: float = 0.3, most: int = 16):
        self.q, self.s, self.rates, self.zeros, self.most = quantiles, signals, (fast, slow, strength), zeros, most
        rng = np.random.RandomState(self.SEED)
        self.a = [int(v) for v in rng.randint(1, 1 << 31, size=quantiles + signals)]
        self.b = [int(v) for v in rng.randint(0, 1 << 31, size=quantiles + signals)]
        self.grid = np.linspace(-1, 1, quantiles + 2)[1:-1].tolist()
        self.markers, self.counts, self.n, self.last = Markers(quantiles), {} if most else None, 0, 0.0
        self.near = self.far = self.zero = 0.0
        self.unit = self.gain = self.loss = 1e-6

    def _category(self, x: float) -> list[int] | None:
        if self.counts is None:
            return None
        whole = round(x)
        if abs(x - whole) <= 1e-9:
            self.counts[whole] = self.counts.get(whole, 0) + 1
        if abs(x - whole) > 1e-9 or len(self.counts) > self.most:
            self.counts = None
            return None
        width = self.q + self.s
        common = sorted(self.counts, key=lambda v: -self.counts[v])[:width]  # ties to the value seen first
        ranks = min(width // 2, len(common))
        (key,) = struct.unpack("<q", struct.pack("<d", x))
        wrapped = [(a * key + b + 2**63) % 2**64 - 2**63 for a, b in zip(self.a, self.b, strict=True)]
        return [int(x == v) for v in common[:ranks]] + [v % (2**31 - 1) & 1 for v in wrapped[ranks:]]

    def step(self, x: float) -> list[int]:
        self.n += 1
        if self.n == 1:
            self.near = self.far = self.last = x
        s, g, r = (early_rate(a, self.n) for a in self.rates)
        out = self._category(x)
        if out is None:
            self.markers.add(x)
            out = [int(x >= t) for t in (self.grid if self.markers.height is None else self.markers.inner())]
        d, before = x - self.last, self.last
        self.near += s * (x - self.near)
        self.far += g * (x - self.far)
        self.unit = (1 - s) * self.unit + s * abs(d)
        self.zero = (1 - g) * self.zero + g * (abs(x) < 1e-12)
        self.last = x
        if self.counts is not None:
            return out
        self.gain = (1 - r) * self.gain + r * max(d, 0.0)
        self.loss = (1 - r) * self.loss + r * max(-d, 0.0)
        share, gap, one = 1 - 1 / (1 + self.gain / (self.loss + 1e-12)), self.near - self.far, max(self.unit, 1e-12)
        third = abs(x) < 1e-12 if self.zero > self.zeros else share > 0.5
        signs = [d > 0, abs(d) > one, gap > 0, third, share > 0.7, abs(gap) > one, share < 0.3, d * (before - self.far) < 0]
        return out + [int(b) for b in signs[: self.s]]


class FastFollower:
    """Thresholds that follow the fast markers by a fixed share, from an even grid over 0 to 1, with a small absolute latch.

    Threshold i follows marker i of all, of which the first is the minimum, as published. Moves, then emits."""

    def __init__(self, k: int = 8, fast: float = 1.5, latch: float = 0.05, share: float = 0.3):
        self.markers, self.latch, self.share = Markers(k, fast), latch, share
        self.at, self.on = np.linspace(0, 1, k + 2)[1:-1].tolist(), [0] * k

    def step(self, x: float) -> list[int]:
        self.markers.add(x)
        goal = self.markers.height or [0.0] * len(self.at)
        self.at = [self.share * g + (1 - self.share) * t for g, t in zip(goal, self.at, strict=False)]
        return self.emit(x)

    def emit(self, x: float) -> list[int]:
        """Bits without moving the thresholds, as of a frozen encoder; the latches do move."""
        self.on = [int(x >= (t - self.latch if b else t + self.latch)) for t, b in zip(self.at, self.on, strict=True)]
        return self.on

    hold = emit


class DriftFollower(FastFollower):
    """The same from the quantiles of a warm-up, during which bits are 0, twice as fast while fast and slow markers differ by
    more than 0.1 on average. The last warm-up value moves the markers twice, as published."""

    def __init__(self, k: int = 8, fast: float = 2.0, slow: float = 0.3, latch: float = 0.15, share: float = 0.1, boost: float = 2.0, warm_up: int = 100):
        super().__init__(k, fast, latch, share)
        self.slow, self.boost, self.warm_up, self.first = Markers(k, slow), boost, warm_up, []

    def step(self, x: float) -> list[int]:
        if self.first is not None:
            self.first.append(x)
            if len(self.first) < self.warm_up:
                return [0] * len(self.at)
            self.at = np.quantile(self.first, probabilities(len(self.at))).tolist()
            for v in self.first:
                self.markers.add(v)
                self.slow.add(v)
            self.first = None
        self.markers.add(x)
        self.slow.add(x)
        none = [0.0] * (len(self.at) + 2)
        fast, slow = self.markers.height or none, self.slow.height or none
        drift = sum(abs(a - b) for a, b in zip(fast, slow, strict=True)) / len(fast)
        share = self.share * (self.boost if drift > 0.1 else 1.0)
        self.at = [t + share * (g - t) for t, g in zip(self.at, fast, strict=False)]
        return self.emit(x)


class WarmSchema:
    """Thresholds of a warm-up (distinct values while there are few, else Freedman and Diaconis' number of quantiles, pruned),
    a bit for zero where zeros are common, a burst and a drift bit; on drift the same quantiles of the last ``recent``
    values. Emits, then moves; the warm-up itself is encoded with the thresholds found on it."""

    def __init__(self, warm: int = 600, most: int = 12, few: int = 12, recent: int = 400, slack: float = 0.25, limit: float = 10.0, zeros: float = 0.3, temporal: bool = True):
        self.warm, self.most, self.few, self.slack, self.limit, self.zeros, self.temporal = warm, most, few, slack, limit, zeros, temporal
        self.recent: deque = deque(maxlen=recent)
        self.at: list[float] = []
        self.probs: list[float] = []
        self.has_zero, self.mean, self.unit, self.last = False, 0.0, 1e-6, 0.0
        self.n, self.left, self.usual, self.sum, self.low = 0, 0, 0.0, 0.0, 0.0

    def begin(self, xs: list[float]) -> None:
        v = np.array(xs, float)
        if not len(v):
            return
        distinct = np.unique(v)
        if len(distinct) <= self.few + 1:
            self.at = distinct[1:].tolist()
        else:
            self.at, self.probs = _pruned(v, probabilities(_rule(v, self.most, len(distinct))))
        self.has_zero = bool((v == 0).mean() > self.zeros)
        self.mean = float(v.mean())
        self.unit = max(float(np.abs(v - self.mean).mean()), 1e-6)
        self.last = float(v[-1])
        self.recent.extend(xs)

    def step(self, x: float) -> list[int]:
        one = max(self.unit, 1e-9)
        out = [int(x >= t) for t in self.at] + [int(x == 0)] * self.has_zero
        if self.temporal:
            out += [int(abs(x - self.last) > one), int(self.left > 0)]
        z = abs((x - self.mean) / one)
        self.mean += 0.02 * (x - self.mean)
        self.unit = 0.98 * self.unit + 0.02 * abs(x - self.mean)
        self.n += 1
        self.usual += (z - self.usual) / self.n
        self.sum += z - self.usual - self.slack
        self.low = min(self.low, self.sum)
        self.recent.append(x)
        if self.sum - self.low > self.limit and len(self.recent) >= 20:
            if self.probs:
                self.at = np.quantile(list(self.recent), self.probs).tolist()
            self.left, self.sum, self.low = 60, 0.0, 0.0
        self.left, self.last = max(self.left - 1, 0), x
        return out


def _rule(v: np.ndarray, most: int, distinct: int) -> int:
    """Freedman and Diaconis' number of thresholds, within ``most``, Sturges' rule and the distinct values; 0 if constant."""
    n, width = len(v), float(v.max() - v.min())
    if n < 4 or width <= 0:
        return 1 if n < 4 else 0
    cap = min(most, max(1, math.ceil(math.log2(n)) + 1), max(1, distinct - 1))
    spread = float(np.subtract(*np.percentile(v, [75, 25])))
    return cap if spread <= 0 else min(max(math.ceil(width / (2 * spread * n ** (-1 / 3))), 1), cap)


def _pruned(v: np.ndarray, probs: list[float]) -> tuple[list[float], list[float]]:
    """Quantiles and their probabilities without bits that never or always hold or that repeat an earlier one (bits of
    rising thresholds are nested, so equal counts are equal bits)."""
    kept: dict[int, tuple[float, float]] = {}
    for p in probs:
        t = float(np.quantile(v, p))
        count = int((v >= t).sum())
        if 0 < count < len(v):
            kept.setdefault(count, (t, p))
    return [t for t, _ in kept.values()], [p for _, p in kept.values()]


class ChartedSchema(WarmSchema):
    """A schema from the first 64 values, or all of a shorter stream; the mean forgets ever more slowly until a control chart
    on the distance from it shows drift, which brings the last 64 values' quantiles and quick forgetting."""

    def __init__(self, sigma: float = 3.0, temporal: bool = True):
        super().__init__(warm=64, recent=64, temporal=temporal)
        self.sigma, self.chart, self.spread, self.horizon = sigma, 0.0, 1e-6, 0.0

    def begin(self, xs: list[float]) -> None:
        super().begin([])
        v = np.array(xs, float)
        if not len(v):
            return
        distinct = np.unique(v)
        cap = max(1, math.ceil(math.log2(max(len(v), 2))) + 1)
        if np.allclose(v, np.round(v)) and len(distinct) <= cap:
            self.at = distinct[1:].tolist()
        else:
            self.at, self.probs = _pruned(v, probabilities(_rule(v, cap, len(distinct))))
        self.has_zero = bool((v == 0).mean() > (1 / (len(self.at) + 1) if self.at else 0.5))
        self.mean, self.last, self.horizon = float(v.mean()), float(v[-1]), float(len(v))
        self.unit = max(float(np.abs(v - self.mean).mean()), 1e-12)
        self.width = len(self.at)
        self.recent.extend(xs)

    def step(self, x: float) -> list[int]:
        one = max(self.unit, 1e-12)
        out = [int(x >= t) for t in self.at] + [int(x == 0)] * self.has_zero
        if self.temporal:
            out += [int(abs(x - self.last) > one), int(self.left > 0)]
        z, a, slow = abs((x - self.mean) / one), 2 / (self.horizon + 1), 2 / (self.recent.maxlen + 1)
        self.mean += a * (x - self.mean)
        self.unit = (1 - a) * self.unit + a * abs(x - self.mean)
        self.horizon += 1
        self.chart += slow * (z - self.chart)
        self.n += 1
        before = self.usual
        self.usual += (z - before) / self.n
        self.spread += (z - before) * (z - self.usual)
        sd = math.sqrt(self.spread / self.n) * math.sqrt(slow / (2 - slow))
        self.recent.append(x)
        if self.chart > self.usual + self.sigma * max(sd, 1e-9) and len(self.recent) >= 8:
            if self.probs:
                self.at = np.quantile(list(self.recent), self.probs).tolist()
            self.horizon, self.chart, self.left = float(self.width + 2), self.usual, int(math.sqrt(self.recent.maxlen))
        self.left, self.last = max(self.left - 1, 0), x
        return out


class Ordered:
    """Values kept in order, 8 bytes each, in blocks: one is added within its block, which is halved when it is ``most`` long."""

    def __init__(self, most: int = 4096):
        self.most, self.blocks, self.tops, self.ends = most, [], [], None

    def __len__(self) -> int:
        return sum(map(len, self.blocks))

    def __getitem__(self, place: int) -> float:
        if self.ends is None:
            self.ends = list(accumulate(map(len, self.blocks)))
        i = bisect_right(self.ends, place)
        return self.blocks[i][place - self.ends[i]]

    def append(self, x: float) -> None:
        self.ends = None
        if not self.blocks:
            self.blocks, self.tops = [array("d")], [x]
        i = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[i]
        insort(block, x)
        self.tops[i] = block[-1]
        if len(block) >= self.most:
            half = len(block) // 2
            self.blocks[i : i + 1] = block[:half], block[half:]
            self.tops[i : i + 1] = block[half - 1], block[-1]


class ReservoirQuantiles:
    """Quantiles of a seeded uniform sample of ``size`` of all values seen (Vitter's algorithm R), found anew every ``every``
    values; exact while no more than ``size`` were seen, and always if it is None: all values are kept then, 8 bytes each.
    Emits, then moves; zeros until the first time."""

    def __init__(self, probs: list[float] | None = None, size: int | None = 4096, every: int = 100, seed: int = 1):
        self.probs, self.size, self.every = list(probs or probabilities(8)), size, every
        self.rng, self.kept, self.n, self.at = np.random.default_rng(seed), Ordered() if size is None else [], 0, None

    def step(self, x: float) -> list[int]:
        out = [0] * len(self.probs) if self.at is None else [int(x >= t) for t in self.at]
        self.n += 1
        if self.size is None or len(self.kept) < self.size:
            self.kept.append(x)
        else:
            place = int(self.rng.integers(self.n))
            if place < self.size:
                self.kept[place] = x
        if self.n % self.every == 0:
            self.refit()
        return out

    def refit(self) -> None:
        ordered = self.kept if self.size is None else sorted(self.kept)
        self.at = [between(ordered, *at) for at in places(self.probs, len(ordered))]


class WindowQuantiles:
    """Quantiles of the last ``window`` values, found anew every ``every`` values; each value counts once. Emits, then moves;
    zeros until the first time."""

    def __init__(self, k: int = 8, window: int = 1000, every: int = 100):
        self.probs, self.every, self.kept, self.n, self.at = probabilities(k), every, deque(maxlen=window), 0, None

    def step(self, x: float) -> list[int]:
        out = [0] * len(self.probs) if self.at is None else [int(x >= t) for t in self.at]
        self.kept.append(x)
        self.n += 1
        if self.n % self.every == 0:
            self.at = np.quantile(list(self.kept), self.probs).tolist()
        return out
