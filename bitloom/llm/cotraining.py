"""Quality by co-training: a text view and a page-metadata view teach each other, then vote.

Each view is a hashed logistic regression: the text view on character and word n-grams of the whole text and bands of its
length, repetition and symbols, the
metadata view on source, language, length band and their pairs. They are fitted on a bounded labelled sample
(``linear.sample``), and rounds run: both fit, both are Platt-calibrated on a held-out fifth, both score every unlabelled
document, and each hands ``per_round`` documents a class, of those it is sure of (calibrated probability beyond
``confident``), spread evenly over the sources, to the other as pseudo-labels. The calibrated views are combined by a logistic stack fitted on another held-out fifth. All
documents are scored in one narrow Arrow pass.

Defined results: null or empty text and null metadata are ordinary values (no n-grams; the token ``null``); repeated
rows and null ids are scored row by row; with one label class only, or none, everything is kept, with a warning; extra columns pass
through ``keep`` untouched and are ignored by ``classify``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm import linear as L
from bitloom.llm import semi
from bitloom.llm.shared import column, written

META_BITS = 12


@dataclass(frozen=True)
class Params:
    rows: int = 2000
    chars: int = 7_000_000
    features: L.Features = field(default_factory=lambda: L.Features(chars=(3, 4), words=(1,), bits=18, shape=True))
    l2: float = 1e-3
    meta_l2: float = 1e-2
    rounds: int = 3
    per_round: int = 200
    confident: float = 0.95
    threshold: float = 0.5


@dataclass
class View:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(self.slope * (margin + self.bias) + self.shift, -12, 12)


@dataclass
class Model:
    text: View
    meta: View
    stack: tuple[float, float, float]

    def combine(self, text_logit: np.ndarray, meta_logit: np.ndarray) -> np.ndarray:
        a, b, c = self.stack
        return L.sigmoid(a * text_logit + b * meta_logit + c)


def meta_buckets(source: pa.Array, lang: pa.Array, chars: pa.Array) -> np.ndarray:
    """(rows, 4) hashed buckets: source, language, length band, source with language."""

    def token(col: pa.Array, tag: str) -> np.ndarray:
        d = pc.fill_null(col.cast(pa.string()), "null").dictionary_encode()
        codes = np.array([zlib.crc32(f"{tag}={v}".encode()) for v in d.dictionary.to_pylist()] or [0], np.uint64)
        return codes[d.indices.to_numpy(zero_copy_only=False)] if len(d) else np.zeros(0, np.uint64)

    size = pc.fill_null(chars.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
    band = np.where(size < 0, 99, np.floor(2 * np.log2(np.maximum(size, 1)))).astype(np.uint64)
    s, l_ = token(source, "source"), token(lang, "lang")
    cols = [s, l_, band + np.uint64(1 << 40), s * np.uint64(31) + l_ + np.uint64(1 << 50)]
    return np.stack([K.mix(c) >> np.uint64(64 - META_BITS) for c in cols], 1).astype(np.int64)


def meta_sparse(buckets: np.ndarray) -> L.Sparse:
    n = len(buckets)
    return L.Sparse(np.repeat(np.arange(n), buckets.shape[1]), buckets.ravel(), np.ones(buckets.size), n)


def join(a: L.Sparse, b: L.Sparse) -> L.Sparse:
    """The rows of a, then those of b."""
    return L.Sparse(np.concatenate((a.rows, b.rows + a.n)), np.concatenate((a.idx, b.idx)), np.concatenate((a.val, b.val)), a.n + b.n)


def cotrain(text: L.Sparse, meta: L.Sparse, y: np.ndarray, p: Params, teach) -> Model:
    """y: 1 or 0. Of the rows a fifth calibrates the views and another fits the stack. teach(views) gives what the rounds
    hand on: (features, labels) for the text view and for the metadata view, of documents that were not handed to that
    view before."""
    fifth = np.arange(len(y)) % 5
    check, stacked, rest = fifth == 0, fifth == 1, fifth > 1
    dims, l2s, known = (1 << p.features.bits, 1 << META_BITS), (p.l2, p.meta_l2), (text, meta)
    learn, target = [L.pick(x, rest) for x in known], [y[rest].astype(float)] * 2
    views = [None, None]
    for turn in range(p.rounds + 1):
        for k in range(2):
            w, b = L.fit_binary(learn[k], target[k], dims[k], l2s[k], start=views[k] and (views[k].weights, views[k].bias))
            slope, shift = L.platt(L.apply_binary(L.pick(known[k], check), w, b), y[check])
            views[k] = View(w, b, slope, shift)
        if turn == p.rounds:
            break
        for k, (x, cls) in enumerate(teach(views)):
            learn[k], target[k] = join(learn[k], x), np.concatenate((target[k], cls))
    z = [views[k].logit(L.apply_binary(L.pick(known[k], stacked), views[k].weights, 0.0)) for k in range(2)]
    n = int(stacked.sum())
    w, c = L.fit_binary(L.Sparse(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.stack(z, 1).ravel(), n), y[stacked].astype(float), 2, 1e-2)
    return Model(views[0], views[1], (float(max(w[0], 0)), float(max(w[1], 0)), c))


def even(have: np.ndarray, rows: int) -> np.ndarray:
    """How many of each group are taken so that ``rows`` are: all of the small ones, the same number of the others."""
    take, order = np.zeros(len(have)), np.argsort(have, kind="stable")
    for at, g in enumerate(order):
        take[g] = min(have[g], (rows - take.sum()) / (len(have) - at))
    return take


def unlabelled(base: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows with an id that no label names; only ids and the few rows that share a bit with a label shuffle."""
    rows, mark = semi.marked(base.where("doc_id is not null"), "doc_id", marks, "__lid")
    hit = rows.where(F.col(mark)).drop(mark)
    ids = hit.select(F.col("doc_id").alias("__free")).distinct().join(marks, F.col("__free") == F.col("__lid"), "left_anti")
    return rows.where(~F.col(mark)).drop(mark).unionByName(semi.only(hit, "doc_id", written(ids, "unlabelled"), "__free"))


def chosen(scored: DataFrame, view: str, taught: set[int], p: Params) -> pd.DataFrame:
    """Of all scored documents that the view in ``view`` is sure of, ``per_round`` a class, spread evenly over the sources
    and drawn by hash of the id: __id, __class. Documents in ``taught`` are left out."""
    spark, parts = scored.sparkSession, []
    old = spark.createDataFrame([(i,) for i in sorted(taught)], "__old long")  # bounded by rounds and per_round
    sure = scored.join(F.broadcast(old), F.col("__id") == F.col("__old"), "left_anti").withColumn("__class", F.when(F.col(view) >= p.confident, 1.0).when(F.col(view) <= 1 - p.confident, 0.0)).where("__class is not null")
    have = sure.groupBy("__class", "__bucket").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["__class", "__bucket"])  # 2**META_BITS a class
    for _, group in have.groupby("__class"):
        n = group["n"].to_numpy(float)
        parts.append(group.assign(share=np.minimum(1.0, 2 * even(n, p.per_round) / n)))
    if not parts:
        return pd.DataFrame({"__id": np.zeros(0, np.int64), "__class": np.zeros(0)})
    rate = pd.concat(parts)
    rates = spark.createDataFrame([(float(c), int(b), float(s)) for c, b, s in zip(rate["__class"], rate["__bucket"], rate["share"], strict=True)], "__c double, __b long, __share double")
    place = F.pmod(F.xxhash64("__id", F.lit(13)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = sure.join(F.broadcast(rates), (F.col("__class") == F.col("__c")) & (F.col("__bucket") == F.col("__b"))).withColumn("__at", place / F.col("__share")).where("__at < 1")
    drawn = [some.where(F.col("__class") == c).orderBy("__at", "__id").limit(p.per_round).select("__id", "__class").toPandas() for c in (0.0, 1.0)]
    return pd.concat(drawn).drop_duplicates("__id")


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    meta = [F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"), F.col("n_chars").cast("long").alias("__n")]
    marks = L.labelled(labels, "quality")
    carry = ["__source", "__lang", "__n", "__y", "__size"]
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang", "n_chars")
    text, rows = L.gather(L.sample(base, marks, p.rows, p.chars, meta, p.features.bits), p.features, carry)
    if not L.both_classes(rows, "quality co-training"):
        none = View(np.zeros(1 << p.features.bits), 0.0)
        return Model(none, View(np.zeros(1 << META_BITS), 0.0), (0.0, 0.0, 10.0))
    free, taught = unlabelled(base, marks), (set(), set())

    def tokens(rows: pd.DataFrame) -> L.Sparse:
        cat = [pa.array(list(rows[c]), pa.string(), from_pandas=True) for c in ("__source", "__lang")]
        size = pa.array([None if v != v or v is None else int(v) for v in rows["__n"]], pa.int64())
        return meta_sparse(meta_buckets(cat[0], cat[1], size))

    def teach(views: list[View]):
        """Both views score every unlabelled document in one pass; each hands its choice to the other."""
        scored = written(probabilities(free, Model(views[0], views[1], (0.0, 0.0, 0.0)), p), "scored")
        out = []
        for k, view in ((0, "__meta"), (1, "__text")):
            got = chosen(scored, view, taught[k], p)
            taught[k].update(got["__id"].tolist())
            ids = docs.sparkSession.createDataFrame([(int(i), float(c)) for i, c in zip(got["__id"], got["__class"], strict=True)], "__lid long, __y double")
            found = base.join(F.broadcast(ids), F.col("doc_id") == F.col("__lid")).select(F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"), "__y", *meta)
            found = found.groupBy("__id").agg(F.min_by(F.struct("__text", "__y", "__source", "__lang", "__n"), F.xxhash64("__text")).alias("r")).select("__id", "r.*")
            if k:
                found = found.drop("__text").toPandas().sort_values("__id")
                out.append((tokens(found), found["__y"].to_numpy(float)))
            else:
                x, found = L.gather(found, p.features, carry[:4])
                out.append((x, found["__y"].to_numpy(float)))
        return out

    m = cotrain(text, tokens(rows), rows["__y"].to_numpy().astype(int), p, teach)
    return Model(m.text, m.meta, (*m.stack[:2], m.stack[2] + L.prior_shift(rows)))


def probabilities(docs: DataFrame, model: Model, p: Params) -> DataFrame:
    """__id, __bucket (of the source), __text and __meta (calibrated probabilities of the views)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**bits weights

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.chunks(batch, "__text"):
                t, b, _ = _scores(part, m, p)
                bucket = meta_buckets(part.column("__source"), part.column("__lang"), part.column("__n"))[:, 0]
                yield pa.RecordBatch.from_arrays([part.column("__id"), pa.array(bucket), pa.array(t), pa.array(b)], names=["__id", "__bucket", "__text", "__meta"])

    return docs.select(F.col("doc_id").alias("__id"), *_inputs()).mapInArrow(run, "__id long, __bucket long, __text double, __meta double")


def _scores(part: pa.RecordBatch, m: Model, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = m.text.logit(L.margins(*K.text_buffers(part.column("__text")), p.features, m.text.weights.astype(np.float32)))
    b = m.meta.logit(m.meta.weights[meta_buckets(part.column("__source"), part.column("__lang"), part.column("__n"))].sum(1))
    return L.sigmoid(t), L.sigmoid(b), m.combine(t, b)


def _inputs() -> list:
    return [F.col("text").alias("__text"), F.col("source").cast("string").alias("__source"), F.col("lang").cast("string").alias("__lang"), F.col("n_chars").cast("long").alias("__n")]


def classify(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """doc_id, text_score, meta_score, score (all calibrated probabilities), kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2**bits weights

    def run(batches):
        m = shared.value
        for batch in batches:
            for part in K.chunks(batch, "__text"):
                t, b, s = _scores(part, m, p)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(t), pa.array(b), pa.array(s), pa.array(s >= p.threshold)], names=["doc_id", "text_score", "meta_score", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs()).mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The accepted documents, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, p))

    def run(batches):
        m = shared.value
        for batch in batches:
            kinds = {"text": pa.string(), "source": pa.string(), "lang": pa.string(), "n_chars": pa.int64()}
            view = pa.RecordBatch.from_arrays([column(batch, c).cast(t) for c, t in kinds.items()], names=["__text", "__source", "__lang", "__n"])
            done = 0
            for part in K.chunks(view, "__text"):
                _, _, s = _scores(part, m, p)
                yield batch.slice(done, part.num_rows).filter(pa.array(s >= p.threshold))
                done += part.num_rows

    return docs.mapInArrow(run, docs.schema)


def quality_cotraining(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    return classify(docs, fit(docs, labels, p), p)
