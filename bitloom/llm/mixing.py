"""Mixing to target weights with soft domain membership.

The domains are all values of a column of the documents (more than ``max_domains`` is an error). A softmax classifier
fitted on a bounded sample (drawn by domain, rows of the labels table first) gives every document its domain posterior ``p``. Of the rates ``r >= 0`` that meet the domain token targets
``T`` those nearest to 1 are taken (squares weighted by a document's tokens ``t``): they are ``max(0, 1 - p_i . v)`` for
one vector ``v``, as long as there are domains, which damped Newton steps find (``sum_i r_i t_i p_i = T``); each step is
one pass that sums, over posteriors written once, as many numbers as a Gram matrix has. Every domain ends within
``tolerance`` of its own target; where that fails (no rates meet the targets, or ``steps`` passes do not suffice) the
nearest sums found are used and a warning names the domains and their figures. The rates are rebuilt in the last pass.
Posteriors are stored as integers (1/10000ths, adding up to 10000), so sums don't depend on the partitioning.

Targets: ``share ** alpha`` of the posterior token shares, normalised, scaled up so that no domain shrinks.

Defined results: null or empty text has 0 tokens, a rate like any other, and no weight in the sums; repeated rows and
null ids are rows of their own; a null domain is the domain ``null``; without any text there is one domain and
every rate is 1; an empty table gives no rows. Extra columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm import linear as L
from bitloom.llm.shared import column, unused, written

UNIT = 10_000


@dataclass(frozen=True)
class Params:
    domain: str = "lang"
    rows: int = 2000
    chars: int = 6_000_000
    max_domains: int = 64
    features: L.Features = field(default_factory=lambda: L.Features(chars=(3,), words=(), bits=16, lower=True))
    l2: float = 1e-3
    alpha: float = 0.7
    steps: int = 60
    tolerance: float = 1e-4


@dataclass
class Model:
    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray
    reached: np.ndarray | None = None  # tokens by domain at the rates found, and what was aimed at
    targets: np.ndarray | None = None


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """The domain classifier; the domains are those of all documents with a text, and each has rows of its own in the sample."""
    domain = F.coalesce(F.col(p.domain).cast("string"), F.lit("null")).alias("__d")
    named = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("__lid"), domain)
    domains = sorted(r["__d"] for r in named.groupBy("__d").count().limit(p.max_domains + 1).collect())
    if len(domains) > p.max_domains:
        raise ValueError(f"{p.domain} has more than {p.max_domains} domains; raise max_domains")
    if not domains:
        return Model(["all"], np.zeros((1 << p.features.bits, 1), np.float32), np.zeros(1))
    ids = named.groupBy("__lid").agg((F.array_position(F.array(*(F.lit(d) for d in domains)), F.min("__d")) - 1).cast("double").alias("__y"))
    known = L.labelled(labels, "quality").select("__lid", F.lit(0).alias("__k"))
    marks = ids.join(known, "__lid", "left").select("__lid", "__y", F.coalesce("__k", F.lit(1)).alias("__o"))  # labelled ones first
    x, rows = L.gather(L.sample(docs, marks, p.rows, p.chars, [domain], p.features.bits), p.features, ["__d", "__y", "__size"])
    y = np.array([domains.index(d) for d in rows["__d"]])
    w, b = L.fit_softmax(x, y, len(domains), 1 << p.features.bits, p.l2)
    size = rows.groupby("__y")["__size"].first().reindex(range(len(domains)), fill_value=1.0).to_numpy()
    b += np.log(size / size.sum()) - np.log(np.maximum(np.bincount(y, minlength=len(domains)), 1) / len(y))  # from the sample's shares to all documents'
    return Model(domains, w.astype(np.float32), b)


def whole_posterior(z: np.ndarray) -> np.ndarray:
    """Softmax in UNITths, each row adding up to UNIT exactly (the rest goes to the largest)."""
    z = np.exp(z - z.max(1, keepdims=True))
    q = np.floor(UNIT * z / z.sum(1, keepdims=True)).astype(np.int64)
    q[np.arange(len(q)), q.argmax(1)] += UNIT - q.sum(1)
    return q


#: Columns that the posteriors add, under names that the documents leave free (``unused``).
ADDED = ("__tokens", "__p", "__rate")


def posteriors(docs: DataFrame, m: Model, p: Params = Params(), moves: np.ndarray | None = None) -> DataFrame:
    """All columns of docs, ``__tokens`` (words), ``__p`` (posterior in UNITths) and, given the moves, ``__rate``."""
    shared = docs.sparkSession.sparkContext.broadcast((m, moves))  # 2**bits by max_domains + 1 weights at most
    names, added = docs.columns, unused(docs, *ADDED)

    def run(batches):
        m, moves = shared.value
        for batch in batches:
            done = 0
            view = pa.RecordBatch.from_arrays([column(batch, "text").cast(pa.string())], names=["t"])
            for part in K.chunks(view, "t"):
                buf, off = K.text_buffers(part.column("t"))
                row = K.spans(buf, off)[2]
                q = whole_posterior(L.margins(buf, off, p.features, m.weights) + m.bias)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))
                body = batch.slice(done, part.num_rows)
                done += part.num_rows
                rate = [] if moves is None else [pa.array(rates(q, moves))]
                yield pa.RecordBatch.from_arrays([*body.columns, pa.array(np.bincount(row, minlength=len(q)).astype(np.int64)), lists, *rate], names=[*names, *added[: 2 + len(rate)]])

    from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

    kinds = [LongType(), ArrayType(LongType()), *([] if moves is None else [DoubleType()])]
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(added, kinds, strict=False))])
    return docs.mapInArrow(run, schema)


def rates(q: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Rates after the moves (one vector a step), from 1, clipped at 0 after each."""
    r, share = np.ones(len(q)), q / UNIT
    for v in moves:
        r = np.maximum(0.0, r - share @ v)
    return r


def solve(grouped: DataFrame, classes: int, p: Params = Params(), targets: np.ndarray | None = None) -> np.ndarray:
    """The move that meets the targets over (``__p``, ``__w``): a posterior and its tokens; one row, or none without tokens."""
    return solved(grouped, classes, p, targets)[0]


def solved(grouped: DataFrame, classes: int, p: Params = Params(), targets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The move, the tokens by domain that it brings about, and the targets."""
    spark = grouped.sparkSession

    def total(v: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(v)

        def run(batches):
            out = np.zeros(1 + classes + classes * classes)
            for batch in batches:
                if batch.num_rows:
                    q = batch.column("__p").flatten().to_numpy(zero_copy_only=False).reshape(-1, classes)
                    out += sums(q, batch.column("__w").to_numpy(zero_copy_only=False).astype(float), shared.value)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["v"])

        parts = [r["v"] for r in grouped.select("__p", "__w").mapInArrow(run, "v array<double>").collect()]
        return np.sum(parts, 0) if parts else np.zeros(1 + classes + classes * classes)

    return newton(total, classes, p, targets)


def sums(q: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Half the squared rates, the tokens by domain, and the Gram matrix of the rows whose rate is above 0, after the move v."""
    s = q / UNIT
    r = np.maximum(0.0, 1 - s @ v)
    on = s[r > 0]
    return np.concatenate(([w @ (r * r) / 2], (w * r) @ s, ((on * w[r > 0, None]).T @ on).ravel()))


def newton(total, classes: int, p: Params, targets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Damped Newton steps on the dual until every domain is within ``tolerance`` of its target; warns if one is not."""
    split = lambda x: (x[0], x[1 : 1 + classes], x[1 + classes :].reshape(classes, classes))
    v = np.zeros(classes)
    value, have, gram = split(total(v))
    tokens = have.sum()
    if tokens <= 0:
        return np.zeros((0, classes)), have, have
    if targets is None:
        want = np.where(have > 0, (have / tokens) ** p.alpha, 0)
        want /= want.sum()
        targets = want * np.max(np.divide(have, want, out=np.zeros(classes), where=want > 0))
    slack = p.tolerance * np.where(targets > 0, targets, targets.sum())
    eig = np.linalg.eigvalsh(gram)
    least = max(1e-3 * eig[0], 1e-12 * eig[-1])
    damp, now, best = least, have, (np.inf, v, have)
    for _ in range(p.steps):
        gap = now - targets
        best = min(best, (np.linalg.norm(gap), v, now), key=lambda x: x[0])
        if (np.abs(gap) <= slack).all():
            break
        move = np.linalg.solve(gram + damp * np.eye(classes), gap)
        value2, now2, gram2 = split(total(v + move))
        if value2 + targets @ (v + move) <= value + targets @ v - 1e-4 * gap @ move + 1e-12 * abs(value):
            v, value, now, gram, damp = v + move, value2, now2, gram2, max(least, damp / 100)
        else:
            damp *= 100
    gap = now - targets
    _, v, now = min(best, (np.linalg.norm(gap), v, now), key=lambda x: x[0])
    off = np.flatnonzero(np.abs(now - targets) > slack)
    if len(off):
        parts = ", ".join(f"domain {k}: {now[k]:.6g} of {targets[k]:.6g} tokens" for k in off)
        warnings.warn(f"mixing: targets are not met after {p.steps} steps ({parts})", RuntimeWarning, stacklevel=2)
    return v[None, :], now, targets


def with_rates(docs: DataFrame, labels: DataFrame, p: Params = Params(), targets: np.ndarray | None = None) -> tuple[DataFrame, Model]:
    """All columns of docs with ``__tokens``, ``__p``, ``__rate``; and the domain model."""
    m = fit(docs, labels, p)
    # Equal posteriors move alike: tokens are summed by posterior before the steps (map-side combined), exactly.
    narrow = posteriors(docs.select("text"), m, p).groupBy("__p").agg(F.sum("__tokens").alias("__w"))
    moves, m.reached, m.targets = solved(written(narrow, "mixing"), len(m.domains), p, targets)
    return posteriors(docs, m, p, moves), m


def copies(rate, key):
    """Whole copies of a row: the rate's floor, and one more where the row's hash falls under its fraction, so that the
    mean is the rate; a rate within 1e-6 of a whole number is that number."""
    r = F.when(F.abs(rate - F.rint(rate)) < 1e-6, F.rint(rate)).otherwise(rate)
    u = F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(r) + F.when(r - F.floor(r) > u, 1).otherwise(0)).cast("int")


def mixture(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, domain (likeliest), posterior, n_tokens, rate, n_copies; the domain's target and reached (its expected tokens)."""
    df, m = with_rates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(p.domain).alias("domain")), labels, replace(p, domain="domain"))
    names = F.array(*(F.lit(d) for d in m.domains))
    at = F.array_position("__p", F.array_max("__p")).cast("int")
    best = F.element_at(names, at)
    of = lambda v: F.element_at(F.array(*(F.lit(float(x)) for x in v)), at)
    return df.select("doc_id", best.alias("domain"), F.transform("__p", lambda v: v / F.lit(float(UNIT))).alias("posterior"), F.col("__tokens").alias("n_tokens"), F.col("__rate").alias("rate"), copies(F.col("__rate"), F.col("doc_id")).alias("n_copies"), of(m.targets).alias("target"), of(m.reached).alias("reached"))


def mix(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents in their whole number of copies, with all their columns."""
    df, _ = with_rates(docs, labels, p)
    rate, copy = unused(docs, *ADDED)[2], unused(df, "__copy")[0]
    n = copies(F.col(rate), F.col("doc_id"))
    return df.withColumn(copy, F.explode(F.array_repeat(F.lit(1), n))).select(*docs.columns)
