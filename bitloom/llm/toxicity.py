"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed character n-grams of its whole lower-cased text, each scaled by the log of
the ratio of its smoothed shares in toxic and other training texts; n-grams whose ratio is within ``least_z`` standard
errors of none are left out (``least_z`` and ``l2`` were chosen by cross-validation on the training rows of the given tables); an L2-regularised logistic regression is fitted
on the scaled features of about ``Params.rows`` labelled rows, drawn by class within ``Params.chars`` characters (``linear.sample``). A score is the logistic
function of the sum, found in one narrow pass with a table of ``2**bits`` weights.

Defined results: null or empty text scores as a text without n-grams; repeated rows and null ids are scored row by
row; labels that are null or have no document are ignored, of several the largest holds; with one class or none,
every score is 0.0, with a warning. Extra columns are ignored by ``classify`` and kept by ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm import linear as L
from bitloom.llm.shared import column, fold


@dataclass(frozen=True)
class Params:
    rows: int = 5000
    chars: int = 16_000_000
    features: L.Features = field(default_factory=lambda: L.Features(chars=(4, 5), words=(), bits=20, lower=True, presence=True))
    smoothing: float = 1.0
    min_rows: int = 4
    least_z: float = 4.0
    l2: float = 1e-3
    threshold: float = 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def pieces(size: np.ndarray):
    """(first row, end, first entry, end) of rows with about ``L.PIECE`` entries together, in turn."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        start = int(ends[a] - size[a])
        b = max(a + 1, int(np.searchsorted(ends, start + L.PIECE, "right")))
        yield a, b, start, int(ends[b - 1])
        a = b


def select(idx: np.ndarray, size: np.ndarray, y: np.ndarray, p: Params) -> tuple[L.Sparse, np.ndarray]:
    """The entries of the n-grams that tell the classes apart, scaled, and every bucket's scale (0: left out). idx has the
    rows' entries one row after another, size how many each has; piece by piece, since a few numbers for every entry at
    once are several times what the entries take."""
    dim = 1 << p.features.bits
    toxic = y > 0.5
    on, both = np.zeros(dim, np.int64), np.zeros(dim, np.int64)
    for a, b, i, j in pieces(size):
        both += np.bincount(idx[i:j], minlength=dim)
        on += np.bincount(idx[i:j][np.repeat(toxic[a:b], size[a:b])], minlength=dim)
    off = both - on
    s = p.smoothing
    ratio = np.log((on + s) / (toxic.sum() + 2 * s)) - np.log((off + s) / ((~toxic).sum() + 2 * s))
    ratio[(both < p.min_rows) | (np.abs(ratio) < p.least_z * np.sqrt(1 / (on + s) + 1 / (off + s)))] = 0
    keep, rows, kept = ratio != 0, [np.zeros(0, np.int32)], [idx[:0]]
    for a, b, i, j in pieces(size):
        live = keep[idx[i:j]]
        rows.append(np.repeat(np.arange(a, b, dtype=np.int32), size[a:b])[live])
        kept.append(idx[i:j][live])
    rows, kept = np.concatenate(rows), np.concatenate(kept)
    return L.Sparse(rows, kept, ratio.astype(np.float32)[kept], len(size)), ratio


def train(x: L.Sparse, ratio: np.ndarray, y: np.ndarray, p: Params) -> Model:
    """x, ratio: as ``select`` gives them, of rows of two classes."""
    toxic = y > 0.5
    w, b = L.fit_binary(x, y, len(ratio), p.l2, steps=80, weight=np.where(toxic, max(1.0, np.sqrt((~toxic).sum() / toxic.sum())), 1.0))
    return Model((w * ratio).astype(np.float32), b)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, p: Params = Params()) -> Model:
    """learn: a condition on doc_id, which documents may be learnt from (all, if none is given)."""
    labels = labels if learn is None else labels.where(learn)
    idx, _, size, rows = L.gathered(L.sample(docs, L.labelled(labels, "toxic"), p.rows, p.chars, [], p.features.bits), p.features, ["__y", "__size"])
    if not L.both_classes(rows, "toxicity"):
        return Model(np.zeros(1 << p.features.bits, np.float32), -1e9)
    y = rows["__y"].to_numpy(float)
    x, ratio = select(idx, size, y, p)
    del idx  # all entries go before the steps
    K.give_back()
    m = train(x, ratio, y, p)
    m.bias += L.prior_shift(rows)
    del x
    K.give_back()
    return m


def _score(part: pa.RecordBatch, column: str, m: Model, p: Params) -> np.ndarray:
    return L.sigmoid(L.margins(*K.text_buffers(part.column(column)), p.features, m.weights) + m.bias)


def classify(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**bits weights

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.chunks(batch, "text"):
                s = _score(part, "text", m, p)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The documents that are not toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, None, p))

    def run(batches):
        m = shared.value
        for batch in batches:
            view = pa.RecordBatch.from_arrays([column(batch, "text").cast(pa.string())], names=["t"])
            done = 0
            for part in K.chunks(view, "t"):
                yield batch.slice(done, part.num_rows).filter(pa.array(_score(part, "t", m, p) < p.threshold))
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def held_out_toxicity(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt only from rows whose fold is not 0."""
    scored = classify(docs, fit(docs, labels, fold("doc_id") != 0, p), p)
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", "predicted")
