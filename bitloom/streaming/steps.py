"""Online encoders: one step function a stream and feature, the same over ordered tables and live streams.

A step gives the bits of one value and moves the state. ``encode_rows`` replays an ordered table, ``encode_live`` runs the
same steps in Structured Streaming, their state kept in the state store. ``fitted`` keeps the machines as they are after a
table, and ``encode_fitted`` encodes another table with them: frozen where a machine says how (``hold``), else going on.

Partitions are sorted by stream and order and stepped through in Arrow batches, so a stream of any length needs the memory
of a batch and its machine. Null and non-finite values are skipped everywhere, but by machines that ``takes_all``.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions.thermo import between, places, probabilities


def early_rate(rate: float, t: int) -> float:
    """The averaging rate at the t-th value: corrected for the empty start during the first 199."""
    return min(rate / max(1 - (1 - rate) ** t, 1e-12), 1.0) if t < 200 else rate


def latched(bits: list[int], x: float, thresholds, margin: float) -> list[int]:
    """Bits that rise at threshold + margin and fall at threshold - margin."""
    return [int(x >= t + margin) if not b else int(x > t - margin) for b, t in zip(bits, thresholds, strict=True)]


class GaussianBand:
    """Even thresholds within some deviations of an exponential mean; moves, then emits. Starts from given moments."""

    def __init__(self, k: int = 8, rate: float = 0.1, reach: float = 2.0, mean: float = 0.0, var: float = 1.0):
        self.z, self.rate, self.mean, self.var = np.linspace(-reach, reach, k), rate, mean, var

    def step(self, x: float) -> list[int]:
        d = x - self.mean
        self.mean += self.rate * d
        self.var = (1 - self.rate) * (self.var + self.rate * d * d)
        return (x >= self.mean + self.z * np.sqrt(max(self.var, 1e-6))).astype(int).tolist()


class MovingBand:
    """Levels around an exponential mean in units of deviation, with optional latching; moves, then emits."""

    def __init__(self, k: int = 8, rate: float = 0.02, reach: float = 2.5, latch: float = 0.0):
        self.z, self.rate, self.latch = np.linspace(-reach, reach, k + 2)[1:-1], rate, latch
        self.n, self.mean, self.var, self.bits = 0, 0.0, 0.0, [0] * k

    def step(self, x: float) -> list[int]:
        self.n += 1
        a = early_rate(self.rate, self.n)
        d = x - self.mean
        self.mean += a * d
        self.var = (1 - a) * (self.var + a * d * d)
        return self._emit(x, np.sqrt(max(self.var, 1e-20)))

    def _emit(self, x: float, unit: float) -> list[int]:
        t = self.mean + self.z * unit
        self.bits = latched(self.bits, x, t, self.latch * unit) if self.latch > 0 else (x >= t).astype(int).tolist()
        return self.bits


class TrueRangeBand(MovingBand):
    """The same in units of the exponential mean step size."""

    def __init__(self, k: int = 8, rate: float = 0.01, range_rate: float = 0.05, reach: float = 2.0, latch: float = 0.0):
        super().__init__(k, rate, reach, latch)
        self.range_rate, self.range, self.last = range_rate, 0.0, None

    def step(self, x: float) -> list[int]:
        self.n += 1
        if self.last is None:
            self.mean = x
        else:
            self.mean += early_rate(self.rate, self.n) * (x - self.mean)
            a = early_rate(self.range_rate, self.n)
            self.range = (1 - a) * self.range + a * abs(x - self.last)
        self.last = x
        return self._emit(x, max(self.range, 1e-12))


class Markers:
    """The P-square estimate of k interior quantiles from k + 2 markers (Jain and Chlamtac, 1985)."""

    def __init__(self, k: int = 8, speed: float = 1.0):
        self.goal, self.speed = np.linspace(0, 1, k + 2), speed
        self.first: list[float] = []
        self.height: list[float] | None = None
        self.place = list(range(1, k + 3))
        self.count = 0

    def inner(self) -> list[float]:
        return [0.0] * (len(self.goal) - 2) if self.height is None else self.height[1:-1]

    def add(self, x: float) -> None:
        if self.height is None:
            self.first.append(x)
            if len(self.first) == len(self.goal):
                self.height, self.count = sorted(self.first), len(self.first)
            return
        h, at = self.height, self.place
        self.count += 1
        last = len(h) - 1
        if x < h[0]:
            h[0], cell = x, 0
        elif x >= h[last]:
            h[last], cell = x, last - 1
        else:
            cell = bisect_right(h, x, 1) - 1
        for i in range(cell + 1, last + 1):
            at[i] += 1
        for i in range(1, last):
            gap = (1 + (self.count - 1) * self.goal[i] - at[i]) * self.speed
            if gap >= 1 and at[i + 1] - at[i] > 1 or gap <= -1 and at[i] - at[i - 1] > 1:
                to = 1 if gap >= 0 else -1
                up, down = at[i + 1] - at[i], at[i] - at[i - 1]
                rise, fall = (h[i + 1] - h[i]) / up, (h[i] - h[i - 1]) / down
                curve = h[i] + to / (up + down) * ((down + to) * rise + (up - to) * fall)
                h[i] = curve if h[i - 1] < curve < h[i + 1] else h[i] + to * (rise if to > 0 else fall)
                at[i] += to


class MarkerQuantiles:
    """Bits against marker quantiles; ``first`` says whether a value is emitted before it moves the markers."""

    def __init__(self, k: int = 8, speed: float = 1.0, first: bool = False):
        self.markers, self.first, self.k = Markers(k, speed), first, k

    def step(self, x: float) -> list[int]:
        if not self.first:
            self.markers.add(x)
            if self.markers.height is None:
                return [0] * self.k
        out = [int(x >= t) for t in self.markers.inner()]
        if self.first:
            self.markers.add(x)
        return out


class RecentQuantiles:
    """Bits against the exact quantiles of the ``window`` values before (thresholds 0 at first), kept in order."""

    def __init__(self, k: int = 8, window: int = 500):
        self.probs, self.window, self.sorted, self.line, self.places = probabilities(k), window, [], deque(), []

    def step(self, x: float) -> list[int]:
        out = [int(x >= between(self.sorted, *at)) for at in self.places] or [int(x >= 0)] * len(self.probs)
        self.line.append(x)
        insort(self.sorted, x)
        if len(self.line) > self.window:
            del self.sorted[bisect_left(self.sorted, self.line.popleft())]
        else:
            self.places = places(self.probs, len(self.sorted))
        return out


def recent_quantiles(df: DataFrame, stream: list[str], seq: str, value: str, k: int = 8, window: int = 500) -> DataFrame:
    """(stream..., seq, bits): each value against the exact quantiles of the ``window`` values before it."""
    return encode_rows(df, stream, seq, value, lambda: RecentQuantiles(k, window))


def flip_rates(df: DataFrame, stream: list[str], seq: str, column: str = "bits") -> DataFrame:
    """Per stream and bit: how often the bit differs from the row before, over all rows."""
    w = Window.partitionBy(*stream).orderBy(seq)
    df = df.withColumn("__last", F.lag(column).over(w))
    n = F.length(column)
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("bit"), (F.col("__last").isNotNull() & (F.substr(F.col(column), i, F.lit(1)) != F.substr(F.col("__last"), i, F.lit(1)))).cast("long").alias("flip")))
    return df.select(*stream, F.explode(pairs).alias("p")).groupBy(*stream, F.col("p.bit").cast("long").alias("bit")).agg(F.sum("p.flip").alias("flips"), F.count(F.lit(1)).alias("n_rows"))


def flip_summary(flips: DataFrame) -> DataFrame:
    """The least, mean, largest and spread (population) of the bits' flip rates, of ``flip_rates``."""
    rate = F.col("flips") / F.col("n_rows")
    return flips.agg(F.min(rate).alias("least"), F.avg(rate).alias("mean"), F.max(rate).alias("most"), F.stddev_pop(rate).alias("spread"))


class Replay:
    """A machine on its way through a stream: ``push`` gives the (tag, bits) that are due. One with a warm-up (``begin``) gives
    nothing until it is full, then all of it; ``end`` gives what a stream shorter than the warm-up leaves."""

    def __init__(self, machine, hold: bool = False):
        self.machine, self.waiting = machine, [] if hasattr(machine, "begin") and not hold else None
        self.one = getattr(machine, "hold", machine.step) if hold else machine.step

    def push(self, tag, x: float) -> list[tuple]:
        if self.waiting is None:
            return [(tag, "".join(map(str, self.one(x))))]
        self.waiting.append((tag, x))
        return self.end() if len(self.waiting) >= self.machine.warm else []

    def end(self) -> list[tuple]:
        due, self.waiting = self.waiting or [], None
        if due:
            self.machine.begin([x for _, x in due])
        return [out for tag, x in due for out in self.push(tag, x)]


def usable(df: DataFrame, columns: list[str], value: str, make: Callable) -> DataFrame:
    """The columns and ``__x``, the value as a double, without the rows that the machine is not given."""
    rows = df.select(*columns, F.col(value).cast("double").alias("__x"))
    return rows if getattr(make(), "takes_all", False) else rows.where("__x is not null and not isnan(__x) and abs(__x) < double('infinity')")


def _sorted(rows: DataFrame, stream: list[str], *order: str | Column) -> DataFrame:
    """Whole streams in order within partitions; the number of partitions is fixed, so that few streams aren't merged into one task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *stream).sortWithinPartitions(*stream, *order)


def _runs(batches, n_keys: int):
    """(key, rows as tuples, whether the key is a new one) of the runs of equal keys; a run may go on in the next batch."""
    now = None
    for batch in batches:
        for key, rows in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[:n_keys]):
            yield key, rows, key != now
            now = key


def _nan(x: float | None) -> float:
    return float("nan") if x is None else x


def encode_rows(df: DataFrame, stream: list[str], seq: str, value: str, make: Callable) -> DataFrame:
    """(stream..., seq, bits) of every row, in order of seq within a stream.

    ``make()`` gives a fresh machine; one that ``takes_all`` is given NaN and infinite values too (null as NaN). Parallel over
    streams: split features into streams of their own."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows, names = usable(df, [*stream, seq], value, make), [*stream, seq, "bits"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*stream, seq)), "bits string"])

    def run(batches):
        replay, types = None, None

        def first(batches):
            nonlocal types
            for batch in batches:
                types = [*batch.schema.types[:-1], pa.string()]
                yield batch

        for key, part, new in _runs(first(batches), len(stream)):
            due = []
            if new:
                if replay is not None:
                    due += [((*old, tag), bits) for tag, bits in replay.end()]
                replay, old = Replay(make()), key
            due += [((*key, tag), bits) for *_, tag, x in part for tag, bits in replay.push(tag, _nan(x))]
            if due:
                yield _table(due, types, names)
        due = [((*old, tag), bits) for tag, bits in replay.end()] if replay is not None else []
        if due:
            yield _table(due, types, names)

    return _sorted(rows, stream, seq).mapInArrow(run, schema)


def _table(due: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    columns = [*zip(*(key for key, _ in due), strict=True), [bits for _, bits in due]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def fitted(df: DataFrame, stream: list[str], seq: str, value: str, make: Callable) -> DataFrame:
    """(stream..., machine): each stream's machine after all its rows, by its steps or as it says (``learn``, ``settle``); one row
    a stream, of bounded size."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = usable(df, [*stream, seq], value, make)

    def run(batches):
        replay, old, types = None, None, None

        def first(batches):
            nonlocal types
            for batch in batches:
                types = [*batch.schema.types[: len(stream)], pa.binary()]
                yield batch

        def close():
            replay.end()
            if hasattr(replay.machine, "settle"):
                replay.machine.settle()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*old, pickle.dumps(replay.machine)), types, strict=True)], names=[*stream, "machine"])

        for key, part, new in _runs(first(batches), len(stream)):
            if new:
                if replay is not None:
                    yield close()
                replay, old = Replay(make()), key
            learn = getattr(replay.machine, "learn", None)
            for *_, tag, x in part:
                learn(_nan(x)) if learn else replay.push(tag, _nan(x))
        if replay is not None:
            yield close()

    return _sorted(rows, stream, seq).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in stream), "machine binary"]))


def encode_fitted(df: DataFrame, models: DataFrame, stream: list[str], seq: str, value: str, make: Callable) -> DataFrame:
    """(stream..., seq, bits) with the machines of ``fitted``, one a stream. Frozen, if the machines have ``hold`` (latches and
    the last value still move, as each says); others go on adapting. Streams without a machine are left out."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows, names = usable(df, [*stream, seq], value, make), [*stream, seq, "bits"]
    heads = models.select(*stream, F.lit(None).cast(kinds[seq]).alias(seq), F.lit(None).cast("double").alias("__x"), "machine")
    both = rows.withColumn("machine", F.lit(None).cast("binary")).unionByName(heads)

    def run(batches):
        replay, types = None, None

        def first(batches):
            nonlocal types
            for batch in batches:
                types = [*batch.schema.types[: len(stream) + 1], pa.string()]
                yield batch

        for key, part, new in _runs(first(batches), len(stream)):
            replay, due = None if new else replay, []
            for *_, tag, x, machine in part:
                if machine is not None:
                    replay = Replay(pickle.loads(machine), hold=True)
                elif replay is not None:
                    due += [((*key, tag), bits) for tag, bits in replay.push(tag, _nan(x))]
            if due:
                yield _table(due, types, names)

    return _sorted(both, stream, F.col("machine").isNull(), seq).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*stream, seq)), "bits string"]))


def encode_live(df: DataFrame, stream: str, seq: str, value: str, make: Callable) -> DataFrame:
    """The same over a streaming DataFrame: a micro-batch's rows are sorted by seq, the machine lives in the state store.

    A machine with a warm-up keeps the first values there too, and they come out, encoded, when it is full."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        replay = pickle.loads(state.get[0]) if state.exists else Replay(make())
        pdf = pd.concat(list(chunks)).sort_values(seq, kind="stable")
        due = [out for tag, x in zip(pdf[seq], pdf["__x"], strict=True) for out in replay.push(tag, float(x))]
        state.update((pickle.dumps(replay),))
        yield pd.DataFrame({stream: pd.Series([key[0]] * len(due), dtype=pdf[stream].dtype), seq: pd.Series([t for t, _ in due], dtype=pdf[seq].dtype), "bits": pd.Series([b for _, b in due], dtype=object)})

    rows = usable(df, [stream, seq], value, make)
    return rows.groupBy(stream).applyInPandasWithState(run, f"`{stream}` {kinds[stream]}, `{seq}` {kinds[seq]}, bits string", "machine binary", "append", GroupStateTimeout.NoTimeout)
