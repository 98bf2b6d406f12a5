"""Hashed linear text models: features in Arrow chunks on the executors, fitted on a bounded sample.

Features of a text are hashed character n-grams (on code points) and word n-grams in ``2**bits``
buckets, so a model's size is fixed whatever the corpus. Two weightings:

* ``mean``: a bucket's share of the n-grams of its channel, times ``SCALE``;
* ``presence``: 1 if the bucket occurs.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.shared import written
from bitloom.llm.textstats import shape_buckets

SCALE = 30.0
#: Places that are summed at once: more than a chunk of several texts has.
PIECE = 1 << 21


@dataclass(frozen=True)
class Features:
    chars: tuple[int, ...] = (3, 4)
    words: tuple[int, ...] = (1, 2)
    bits: int = 18
    lower: bool = False
    presence: bool = False
    shape: bool = False


@dataclass
class Sparse:
    """Rows of (bucket, value); ``rows`` ascending."""

    rows: np.ndarray
    idx: np.ndarray
    val: np.ndarray
    n: int


def channels(buf: np.ndarray, off: np.ndarray, spec: Features, live: np.ndarray | None = None):
    """(row, bucket) of every n-gram, channel by channel; with ``live`` only of the buckets where it holds."""
    for buckets, total, a, b in spreads(buf, off, spec):
        bucket, size = buckets(0, total), np.maximum(b - a, 0)
        inside = np.zeros(len(bucket) + 1, np.int8)
        np.add.at(inside, a[size > 0], 1)
        np.add.at(inside, b[size > 0], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
        at = np.flatnonzero(inside if live is None else live[bucket] & inside)
        yield K.rows_of(np.append(a, len(bucket)), at).astype(np.int32), bucket[at]


def featurise(buf: np.ndarray, off: np.ndarray, spec: Features) -> Sparse:
    n, parts = len(off) - 1, []
    for row, bucket in channels(buf, off, spec):
        key, count = np.unique((row.astype(np.int64) << spec.bits) | bucket, return_counts=True)
        r = key >> spec.bits
        total = np.bincount(row, minlength=n)
        parts.append((key, np.ones(len(key)) if spec.presence else SCALE * count / total[r]))
    key, val = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, val = key[order], val[order]
    if len(key):  # channels that meet in a bucket add up, or count once
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        key, val = key[first], (np.maximum if spec.presence else np.add).reduceat(val, first)
    return Sparse(key >> spec.bits, key & ((1 << spec.bits) - 1), val, n)


def margins(buf: np.ndarray, off: np.ndarray, spec: Features, weights: np.ndarray) -> np.ndarray:
    """Sums of weights by row, without an intercept: (rows,) or (rows, classes)."""
    n = len(off) - 1
    if spec.presence:
        keys = []
        for row, bucket in channels(buf, off, spec, weights != 0):
            keys.append((row.astype(np.int64) << spec.bits) | bucket)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        return np.bincount(key >> spec.bits, weights[key & ((1 << spec.bits) - 1)], minlength=n)
    out = np.zeros((n, *weights.shape[1:]))
    for buckets, total, a, b in spreads(buf, off, spec):
        share = SCALE / np.maximum(b - a, 1)
        for i in range(0, total, PIECE):  # more than one only within a single long text
            bucket = buckets(i, min(i + PIECE, total)).astype(np.intp)
            ends = np.clip(a - i, 0, len(bucket)), np.clip(b - i, 0, len(bucket))
            if weights.ndim == 1:
                out += K.range_sums(weights[bucket], *ends) * share
            else:
                for k in range(weights.shape[1]):
                    out[:, k] += K.range_sums(weights[:, k][bucket], *ends) * share
    return out


def spreads(buf: np.ndarray, off: np.ndarray, spec: Features):
    """(buckets, total, first, end) of every channel: buckets(i, j) gives those at places i to j of the total, of which row r's
    are first[r] to end[r]; some belong to no row."""
    if spec.shape:
        row, shape = shape_buckets(buf, off, spec.bits)
        at = np.arange(0, len(row) + 1, 4)
        yield (lambda i, j: shape[i:j]), len(row), at[:-1], at[1:]
    if spec.lower:
        buf = K.lowered(buf)
    if spec.chars:
        cp, at = K.codepoints(buf, off)
        for n in spec.chars:
            yield (lambda i, j, n=n: K.char_hash(cp[i : j + n - 1], n, spec.bits)), max(0, len(cp) - n + 1), at[:-1], at[1:] - n + 1
    if spec.words:
        starts, ends, _ = K.spans(buf, off)
        words, at = K.segment_hash(buf, starts, ends), np.searchsorted(starts, off)
        for n in spec.words:
            yield (lambda i, j, n=n: word_buckets(K.window_hash(words[i : j + n - 1], n), n, spec.bits)), max(0, len(words) - n + 1), at[:-1], at[1:] - n + 1


def word_buckets(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    return (K.mix(h + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.uint32)


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """One row per id: ``__lid``, ``__y``; the largest of several labels holds."""
    rows = labels.select(F.col("doc_id").cast("long").alias("__lid"), F.col(column).cast("double").alias("__y"))
    return rows.where("__lid is not null and __y is not null").groupBy("__lid").agg(F.max("__y").alias("__y"))


def quotas(have: dict, rows: int) -> dict:
    """Rows of each class: in proportion, but a tenth of an even share at least (or all that the class has)."""
    total, least = max(1, sum(have.values())), -(-rows // (10 * max(1, len(have))))
    return {c: min(n, max(least, rows * n // total)) for c, n in have.items()}


def fitting(cost: np.ndarray, rows: int, budget: float) -> np.ndarray:
    """Which rows are taken, in order: each that still fits; if none does, the cheapest."""
    cost, out = np.asarray(cost), np.zeros(len(cost), bool)
    for i, c in enumerate(cost):
        if rows and c <= budget:
            out[i], budget, rows = True, budget - c, rows - 1
    if len(cost) and not out.any():
        out[cost.argmin()] = True
    return out


def sample(docs: DataFrame, marks: DataFrame, rows: int, chars: int, carry: list[Column], bits: int) -> DataFrame:
    """About ``rows`` of the marked documents, by hash of the id and with a quota for each class: a documented bound for fitting.

    Marks are ``__lid``, ``__y`` (the class) and, if some are to come first, ``__o``. Those without a document take no
    place. A class has its share of ``chars``, of which a document takes its length, or ``2**bits`` if that is less (it
    cannot have more features); one that doesn't fit is left out and the next ones are tried. Only the drawn ids, a
    bounded table, meet the documents, by broadcast; of several texts of an id the one with the smallest hash is taken.
    Columns: ``__id``, ``__text``, ``__y``, ``__size`` (documents of the class) and those in ``carry``."""
    spark = docs.sparkSession
    body = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("__id"), F.col("text").alias("__text"), *carry)
    size = body.select("__id", F.length("__text").alias("__len")).groupBy("__id").agg(F.max("__len").alias("__len"))
    order = F.col("__o") if "__o" in marks.columns else F.lit(0)
    there = written(marks.join(size, F.col("__lid") == F.col("__id")).select("__lid", "__y", "__len", order.alias("__o"), F.xxhash64("__lid", F.lit(11)).alias("__h")), "sample")
    have = {r["__y"]: r["n"] for r in there.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a class
    quota, drawn = quotas(have, rows), []
    for y in sorted(have):
        some = there.where(F.col("__y") == y).orderBy("__o", "__h", "__lid").limit(2 * quota[y]).toPandas()
        some = some[fitting(np.minimum(some["__len"], 1 << bits), quota[y], chars * quota[y] / sum(quota.values()))]
        drawn.append(some.assign(__size=float(have[y])))
    drawn = pd.concat(drawn) if drawn else pd.DataFrame({"__lid": [], "__y": [], "__size": []})
    table = spark.createDataFrame(pd.DataFrame({"__lid": drawn["__lid"].to_numpy(np.int64), "__y": drawn["__y"].to_numpy(float), "__size": drawn["__size"].to_numpy(float)}), "__lid long, __y double, __size double")
    names = [c for c in body.columns if c not in ("__id", "__text")]
    got = body.join(F.broadcast(table), F.col("__id") == F.col("__lid")).groupBy("__id").agg(F.min_by(F.struct("__text", "__y", "__size", *names), F.xxhash64("__text")).alias("r"))
    return got.select("__id", "r.*")


def prior_shift(rows: pd.DataFrame) -> float:
    """What the log odds of class 1 are in all marked documents beyond those in the sample."""
    n, size = rows.groupby("__y").size(), rows.groupby("__y")["__size"].first()
    return float(np.log(size[1.0] / size[0.0]) - np.log(n[1.0] / n[0.0])) if {0.0, 1.0} <= set(n.index) else 0.0


def both_classes(rows: pd.DataFrame, what: str) -> bool:
    """Whether there are rows of two classes; if not, says what that means."""
    if rows["__y"].nunique() > 1:
        return True
    warnings.warn(f"{what}: the documents' labels have {rows['__y'].nunique()} of two classes, so nothing can be told apart", RuntimeWarning, stacklevel=2)
    return False


def gather(rows: DataFrame, spec: Features, carry: list[str]) -> tuple[Sparse, pd.DataFrame]:
    """The sample's features, made on the executors and brought to the driver (bounded by the sample's bound)."""
    idx, val, size, rest = gathered(rows, spec, carry)
    return Sparse(np.repeat(np.arange(len(size), dtype=np.int32), size), idx, val, len(size)), rest


def gathered(rows: DataFrame, spec: Features, carry: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pd.DataFrame]:
    """What ``gather`` brings, with the number of entries of each row in place of every entry's row: buckets, values, numbers, the rest."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches):
        for batch in batches:
            for part in K.chunks(batch, "__text"):
                x = featurise(*K.text_buffers(part.column("__text")), spec)
                cut = np.searchsorted(x.rows, np.arange(1, x.n))
                idx, val = x.idx.astype(np.uint32), x.val[: 0 if spec.presence else None].astype(np.float16)
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), *(part.column(c) for c in carry), pa.array([a.tobytes() for a in np.split(idx, cut)], pa.binary()), pa.array([a.tobytes() for a in (np.split(val, cut) if len(val) else [val] * x.n)], pa.binary())],
                    names=["__id", *carry, "__idx", "__val"],
                )

    schema = ", ".join(["__id long", *(f"{c} {kinds[c]}" for c in carry), "__idx binary", "__val binary"])
    got = rows.mapInArrow(run, schema).toArrow()
    order = np.argsort(got.column("__id").to_numpy(), kind="stable")
    rest = got.select(["__id", *carry]).take(order).to_pandas()
    batches = got.select(["__idx", "__val"]).to_batches()
    del got
    (idx, size), (val, _) = _flat(batches, [np.uint32, np.float16], order)
    K.give_back()
    rows.sparkSession._jvm.System.gc()  # the driver's heap gives back what the results took on their way, before a fit takes its own
    return idx, np.broadcast_to(np.float32(1), len(idx)) if spec.presence else val.astype(np.float32), size, rest


def _flat(batches: list[pa.RecordBatch], kinds: list, order: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The numbers that columns of bytes hold, one cell after another in the order given; and how many each has. The list is
    emptied: a batch goes when it is copied, so that the whole is hardly ever there twice."""

    def offsets(column: pa.Array) -> np.ndarray:
        kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)

    sizes = [np.concatenate([np.zeros(0, np.int64), *(np.diff(offsets(b.column(k))) for b in batches)]) for k in range(len(kinds))]
    flats, places = [np.empty(n.sum() // np.dtype(kind).itemsize, kind) for n, kind in zip(sizes, kinds, strict=True)], [np.empty_like(n) for n in sizes]
    for n, place in zip(sizes, places, strict=True):
        place[order] = np.cumsum(n[order]) - n[order]
    first = 0
    while batches:
        batch = batches.pop(0)
        for k, flat in enumerate(flats):
            at, out = offsets(batch.column(k)).tolist(), flat.view(np.uint8)
            data = batch.column(k).buffers()[2]
            data = np.zeros(0, np.uint8) if data is None or not data.size else np.frombuffer(data, np.uint8)
            for a, b, to in zip(at[:-1], at[1:], places[k][first : first + batch.num_rows].tolist(), strict=True):
                out[to : to + b - a] = data[a:b]
        first += batch.num_rows
        del batch, data
    return [(flat, n[order] // np.dtype(kind).itemsize) for flat, n, kind in zip(flats, sizes, kinds, strict=True)]


def pick(x: Sparse, mask: np.ndarray) -> Sparse:
    """The rows where mask holds, renumbered."""
    on = mask[x.rows]
    return Sparse((np.cumsum(mask, dtype=np.int32) - 1)[x.rows[on]], x.idx[on], x.val[on], int(mask.sum()))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z, float)))


def lbfgs(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking; f gives value and gradient."""
    v, g = f(x)
    s_, y_ = [], []
    for _ in range(steps):
        q, alpha = g.copy(), []
        for s, y in zip(reversed(s_), reversed(y_), strict=True):
            a = (s @ q) / (s @ y)
            alpha.append(a)
            q -= a * y
        q *= (s_[-1] @ y_[-1]) / (y_[-1] @ y_[-1]) if s_ else 1 / max(1.0, np.linalg.norm(g))
        for s, y, a in zip(s_, y_, reversed(alpha), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        t, slope = 1.0, g @ q
        if slope <= 0:
            break
        while True:
            x2 = x - t * q
            v2, g2 = f(x2)
            if v2 <= v - 1e-4 * t * slope or t < 1e-6:
                break
            t /= 2
        s, y = x2 - x, g2 - g
        done = v - v2 < 1e-7 * max(1.0, abs(v))
        x, v, g = x2, v2, g2
        if s @ y > 1e-12:
            s_, y_ = [*s_, s][-memory:], [*y_, y][-memory:]
        if done or np.abs(g).max(initial=0) < 1e-6:
            break
    return x


def _dense(idx: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that occur, and each entry's place among them."""
    live = np.bincount(idx, minlength=dim) > 0
    return np.flatnonzero(live), (np.cumsum(live, dtype=np.int32) - 1)[idx]


def fit_binary(x: Sparse, y: np.ndarray, dim: int, l2: float = 1e-3, steps: int = 60, weight: np.ndarray | None = None, start: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression: (weights over all buckets, intercept). y may be soft, within 0..1. Steps begin
    at ``start``, if given."""
    out = np.zeros(dim)
    if not x.n:
        return out, 0.0
    used, idx = _dense(x.idx, dim)
    weight = np.ones(x.n) if weight is None else weight
    total = weight.sum()
    bound = np.searchsorted(x.rows, np.arange(x.n + 1))
    size, idx = np.diff(bound), idx.astype(np.intp)

    def f(p):
        z = K.row_sums(x.val * p[:-1][idx], bound) + p[-1]
        loss = weight @ (np.logaddexp(0, z) - y * z) / total + 0.5 * l2 * (p[:-1] @ p[:-1])
        r = weight * (sigmoid(z) - y) / total
        return loss, np.append(np.bincount(idx, x.val * np.repeat(r, size), minlength=len(used)) + l2 * p[:-1], r.sum())

    base = np.clip((weight @ y) / total, 1e-3, 1 - 1e-3)
    begin = np.append(np.zeros(len(used)), np.log(base / (1 - base))) if start is None else np.append(start[0][used], start[1])
    p = lbfgs(f, begin, steps)
    out[used] = p[:-1]
    K.give_back()
    return out, float(p[-1])


def fit_softmax(x: Sparse, y: np.ndarray, classes: int, dim: int, l2: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """L2-regularised multinomial logistic regression: (weights (dim, classes), intercepts)."""
    out = np.zeros((dim, classes))
    if not x.n:
        return out, np.zeros(classes)
    used, idx = _dense(x.idx, dim)
    hot, d = np.eye(classes)[y], len(used)

    def f(p):
        w, b = p[: d * classes].reshape(classes, d), p[d * classes :]
        z = np.stack([np.bincount(x.rows, x.val * w[k][idx], minlength=x.n) for k in range(classes)], 1) + b
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        loss = -np.log(np.maximum((q * hot).sum(1), 1e-300)).mean() + 0.5 * l2 * (w * w).sum()
        r = (q - hot) / x.n
        grad = np.stack([np.bincount(idx, x.val * r[:, k][x.rows], minlength=d) for k in range(classes)]) + l2 * w
        return loss, np.append(grad.ravel(), r.sum(0))

    prior = np.log((hot.sum(0) + 1) / (x.n + classes))
    p = lbfgs(f, np.append(np.zeros(d * classes), prior), steps)
    out[used] = p[: d * classes].reshape(classes, d).T
    return out, p[d * classes :]


def apply_binary(x: Sparse, w: np.ndarray, b: float) -> np.ndarray:
    return np.bincount(x.rows, x.val * w[x.idx], minlength=x.n) + b


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of Platt's calibration with its smoothed targets; the slope is kept positive."""
    pos, neg = float((y > 0.5).sum()), float((y <= 0.5).sum())
    if not pos or not neg:
        base = (pos + 1) / (pos + neg + 2)
        return (1.0, 0.0) if pos + neg == 0 else (0.0, float(np.log(base / (1 - base))))
    t = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))

    def f(p):
        z = np.exp(p[0]) * margin + p[1]
        r = (sigmoid(z) - t) / len(t)
        return np.mean(np.logaddexp(0, z) - t * z) + 1e-4 * p[0] ** 2, np.array([np.exp(p[0]) * (r @ margin) + 2e-4 * p[0], r.sum()])

    p = lbfgs(f, np.zeros(2), 60)
    return float(np.exp(p[0])), float(p[1])
