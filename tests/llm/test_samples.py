"""Training samples: a long document does not end them, and every class has its rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import kernels, linear, toxicity


def first_by_hash(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64("i", F.lit(11))).first()["i"]


def test_a_long_document_does_not_end_the_sample(spark):
    long = first_by_hash(spark, range(60))
    docs = spark.createDataFrame([(i, "ab " * (20_000 if i == long else 10)) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, float(i % 2)) for i in range(60)], "__lid long, __y double")
    rows = linear.sample(docs, marks, 60, 3000, [], 18).toPandas()
    assert set(rows["__id"]) == set(range(60)) - {long} and set(rows["__y"]) == {0.0, 1.0}


def test_toxicity_learns_beside_a_long_document_and_a_rare_class(spark):
    long = first_by_hash(spark, range(400))
    toxic = {i for i in range(400) if i % 40 == 3 and i != long}
    text = lambda i: "plain words " * 40_000 if i == long else ("vile slur insult " if i in toxic else "kind calm words ") * 5 + str(i)
    docs = spark.createDataFrame([(i, text(i)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400)], "doc_id long, quality int, toxic int")
    p = toxicity.Params(rows=100, chars=20_000)
    kept = {r["doc_id"] for r in toxicity.keep(docs, labels, p).collect()}
    assert not kept & toxic and len(kept) >= 380


def test_a_missing_class_is_reported(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    with pytest.warns(RuntimeWarning, match="toxicity"):
        toxicity.fit(docs, labels)


def test_the_rest_is_drawn_in_order_and_within_the_budget():
    assert linear.fitting(np.array([50, 3, 3, 9, 3]), 4, 10).tolist() == [False, True, True, False, True]
    assert linear.fitting(np.array([50, 30]), 4, 10).tolist() == [False, True]
    assert linear.quotas({0.0: 9990, 1.0: 10}, 100) == {0.0: 99, 1.0: 5}


def features(texts, spec):
    return linear.featurise(*kernels.text_buffers(pa.array(texts)), spec)


def random_texts(n, size):
    rng = np.random.default_rng(3)
    return [bytes(rng.integers(97, 123, size).astype(np.uint8)).decode() for _ in range(n)]


def test_a_fit_takes_little_more_than_its_features(spark, monkeypatch):
    monkeypatch.setattr(linear, "PIECE", 1 << 16)
    spec = linear.Features(chars=(4, 5), words=(), bits=16, lower=True, presence=True)
    texts = random_texts(100, 20_000)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], "doc_id long, quality int, toxic int")
    entries = len(features(texts, spec).idx)
    tracemalloc.start()
    toxicity.fit(docs, labels, None, toxicity.Params(features=spec))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert entries > 1_500_000 and most < 10 * entries


@pytest.mark.parametrize("piece", [1, 1000, 1 << 21])
def test_ngrams_are_selected_by_all_rows_whatever_the_piece(monkeypatch, piece):
    monkeypatch.setattr(linear, "PIECE", piece)
    p = toxicity.Params(features=linear.Features(chars=(4, 5), words=(), bits=12, lower=True, presence=True), least_z=1.0)
    texts = ["", *random_texts(30, 200), "", *(f"vile slur insult {i}" for i in range(20)), ""]
    y = np.array([float("vile" in t or i % 7 == 0) for i, t in enumerate(texts)])
    x = features(texts, p.features)
    got, ratio = toxicity.select(x.idx.astype(np.uint32), np.bincount(x.rows, minlength=x.n), y, p)
    on, off = (np.bincount(x.idx[(y == c)[x.rows]], minlength=1 << 12) for c in (1, 0))
    want = np.log((on + 1) / (sum(y == 1) + 2)) - np.log((off + 1) / (sum(y == 0) + 2))
    want[(on + off < p.min_rows) | (np.abs(want) < np.sqrt(1 / (on + 1) + 1 / (off + 1)))] = 0
    live = want[x.idx] != 0
    assert 0 < live.sum() < len(live) and np.array_equal(ratio, want) and got.n == len(texts)
    assert np.array_equal(got.rows, x.rows[live]) and np.array_equal(got.idx, x.idx[live]) and np.array_equal(got.val, want[got.idx].astype(np.float32))


def test_gathered_features_stand_by_id(spark):
    texts = random_texts(40, 300)
    texts[7] = ""
    ids = np.random.default_rng(5).permutation(40).tolist()
    rows = spark.createDataFrame([(i, texts[i], float(i)) for i in ids], "__id long, __text string, __y double").repartition(5)
    for spec in (linear.Features(bits=14), linear.Features(bits=14, presence=True)):
        x, rest = linear.gather(rows, spec, ["__y"])
        want = features(texts, spec)
        assert rest["__id"].tolist() == list(range(40)) and rest["__y"].tolist() == [float(i) for i in range(40)]
        assert np.array_equal(x.rows, want.rows) and np.array_equal(x.idx, want.idx) and np.array_equal(x.val, want.val.astype(np.float16).astype(np.float32))
    x, rest = linear.gather(rows.where("__id < 0"), linear.Features(bits=14), ["__y"])
    assert x.n == len(rest) == len(x.idx) == 0
