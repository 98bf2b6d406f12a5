"""Quality rules: base text statistics, then a calibrated hashed n-gram logistic regression.

The model (hashed character and word n-grams, ``mean`` weighting) is fitted on about ``Params.rows`` labelled rows,
drawn by class within ``Params.chars`` characters (``linear.sample``), Platt-calibrated on a fifth of them, and scored in Arrow batches against the fixed
``Params.threshold``. Every document is scored on its whole text in one narrow pass; only the labelled ids shuffle.

Defined results: null or empty text has no words, so its counts are 0 and ``base_failed`` is true; repeated rows
give repeated results; rows with a null id are scored and returned; labels without a document, with a null id or a
null label are ignored, and of several labels of one id the largest holds; without any usable label the model
accepts everything the base rules accept, and with a class missing it warns. Extra columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm import linear as L
from bitloom.llm.textstats import statistics

@dataclass(frozen=True)
class Params:
    rows: int = 3000
    chars: int = 9_000_000
    features: L.Features = field(default_factory=lambda: L.Features(chars=(3, 4), words=(1, 2), bits=18))
    l2: float = 1e-3
    threshold: float = 0.5
    min_words: int = 50
    repeat_percent: int = 50


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, buf, off, spec) -> np.ndarray:
        return L.sigmoid(self.slope * (L.margins(buf, off, spec, self.weights) + self.bias) + self.shift)


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    x, rows = L.gather(L.sample(docs, L.labelled(labels, "quality"), p.rows, p.chars, [], p.features.bits), p.features, ["__y", "__size"])
    y = rows["__y"].to_numpy(float)
    dim = 1 << p.features.bits
    if not L.both_classes(rows, "quality rules") and not len(y):
        return Model(np.zeros(dim, np.float32), 0.0, 1.0, 10.0)
    check = np.arange(len(y)) % 5 == 0
    w, b = L.fit_binary(L.pick(x, ~check), y[~check], dim, p.l2)
    slope, shift = L.platt(L.apply_binary(L.pick(x, check), w, b), y[check])
    return Model(w.astype(np.float32), b, slope, shift + L.prior_shift(rows))


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, quality (the calibrated probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the corpus
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.chunks(batch, "text"):
                buf, off = K.text_buffers(part.column("text"))
                s = statistics(buf, off)
                failed = (s["n_words"] < p.min_words) | (100 * s["n_repeat_words"] > p.repeat_percent * s["n_words"])
                prob = m.probability(buf, off, p.features)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(s[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & (prob >= p.threshold)), pa.array(prob)],
                    names=["doc_id", *counts, "base_failed", "kept", "quality"],
                )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, quality double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def quality_rules(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    return score(docs, fit(docs, labels, p), p)
