"""Classifiers and mixing against plain dense versions: the same n-grams, written letter by letter, and their own solver."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import cotraining, mixing, quality_rules, toxicity
from bitloom.llm import kernels as K
from bitloom.llm import linear as L
from bitloom.llm.shared import table

DATA = "/root/testdata/sf0.01"


def char_bucket(gram: str, bits: int) -> int:
    """The bucket of a character n-gram, in whole numbers modulo 2**32."""
    m, h = 0xFFFFFFFF, (ord(gram[0]) + len(gram)) & 0xFFFFFFFF
    for c in gram[1:]:
        h = (h * 0x9E3779B1 + ord(c)) & m
    h ^= h >> 15
    h = h * 0x2C1B3C6D & m
    h ^= h >> 13
    h = h * 0x297A2D39 & m
    return h >> (32 - bits)


def lowered(t: str) -> str:
    return t.translate({i: i + 32 for i in range(65, 91)})


def grams(t: str, n: int) -> list[str]:
    return [t[i : i + n] for i in range(len(t) - n + 1)]


def logistic(x: np.ndarray, y: np.ndarray, l2: float, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Newton's steps on the dense problem, in the space of the rows (the weights are combinations of them)."""
    w8 = np.ones(len(y)) if weight is None else weight
    w8 = w8 / w8.sum()
    gram, a, b = x @ x.T, np.zeros(len(y)), 0.0
    for _ in range(100):
        z = gram @ a + b
        p = 1 / (1 + np.exp(-z))
        g = w8 * (p - y) + l2 * a  # the gradient is x.T @ g
        s = w8 * p * (1 - p)
        top = np.hstack((s[:, None] * gram + l2 * np.eye(len(y)), s[:, None]))
        low = np.append(s @ gram, s.sum())[None, :]
        step = np.linalg.lstsq(np.vstack((top, low)), np.append(-g, -(w8 * (p - y)).sum()), rcond=None)[0]
        a, b = a + step[:-1], b + step[-1]
        if np.abs(step).max() < 1e-10:
            break
    return x.T @ a, b


@pytest.fixture(scope="module")
def rows(spark):
    docs = table(spark, DATA, "documents").where("n_chars < 3000")
    labels = table(spark, DATA, "labels")
    return docs, labels, {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def test_character_buckets():
    text = "naïve 日本 \U0001f600 ab"
    buf, off = K.text_buffers(pa.array([text, "xy", ""]))
    for n, bits in ((3, 18), (5, 20)):
        row, bucket = K.char_buckets(*K.codepoints(buf, off), n, bits)
        assert row.tolist() == [0] * (len(text) - n + 1) and bucket.tolist() == [char_bucket(g, bits) for g in grams(text, n)]


def test_toxicity_equals_a_dense_version(spark, rows):
    docs, labels, texts = rows
    p = toxicity.Params(rows=150, l2=1e-2)
    sample = L.sample(docs, L.labelled(labels, "toxic"), p.rows, p.chars, [], p.features.bits).toPandas().sort_values("__id")
    y = sample["__y"].to_numpy()
    sets = [{char_bucket(g, 20) for n in (4, 5) for g in grams(lowered(t), n)} for t in sample["__text"]]
    names = sorted(set().union(*sets))
    x = np.array([[b in s for b in names] for s in sets], float)
    on, off, n1, n0 = x[y == 1].sum(0), x[y == 0].sum(0), (y == 1).sum(), (y == 0).sum()
    ratio = np.log((on + 1) / (n1 + 2)) - np.log((off + 1) / (n0 + 2))
    ratio[(on + off < p.min_rows) | (np.abs(ratio) < p.least_z * np.sqrt(1 / (on + 1) + 1 / (off + 1)))] = 0
    assert (ratio != 0).any()
    w, b = logistic(x * ratio, y, p.l2, np.where(y == 1, max(1.0, np.sqrt(n0 / n1)), 1.0))
    size = sample.groupby("__y")["__size"].first()
    b += np.log(size[1] / size[0]) - np.log(n1 / n0)
    weight = dict(zip(names, w * ratio, strict=True))
    m = toxicity.fit(docs, labels, None, p)
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, m, p).collect()}
    for i, t in texts.items():
        z = b + sum(weight.get(v, 0.0) for v in {char_bucket(g, 20) for n in (4, 5) for g in grams(lowered(t), n)})
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 5e-3


def test_quality_rules_equal_a_dense_version(spark, rows):
    docs, labels, texts = rows
    p = quality_rules.Params(rows=120, features=L.Features(chars=(3,), words=(), bits=14), l2=1e-2)
    sample = L.sample(docs, L.labelled(labels, "quality"), p.rows, p.chars, [], p.features.bits).toPandas().sort_values("__id")

    def dense(t: str) -> np.ndarray:
        out, g = np.zeros(1 << 14), [char_bucket(v, 14) for v in grams(t, 3)]
        np.add.at(out, g, L.SCALE / max(len(g), 1))
        return out

    x, y = np.array([dense(t) for t in sample["__text"]]), sample["__y"].to_numpy()
    check = np.arange(len(y)) % 5 == 0
    w, b = logistic(x[~check], y[~check], p.l2)
    slope, shift = L.platt(x[check] @ w + b, y[check])
    size = sample.groupby("__y")["__size"].first()
    n = np.bincount(y.astype(int))
    shift += np.log(size[1] / size[0]) - np.log(n[1] / n[0])
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels, p).collect()}
    for i, t in texts.items():
        want = 1 / (1 + np.exp(-(slope * (dense(t) @ w + b) + shift)))
        assert abs(got[i]["quality"] - want) < 1e-2
        many = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert got[i]["base_failed"] or many >= 50
        assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["quality"] >= 0.5)


def test_platt_minimises_its_loss():
    rng = np.random.default_rng(0)
    z = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float)
    a, b = L.platt(z, y)
    t = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (400 - y.sum() + 2))
    loss = lambda a, b: np.mean(np.logaddexp(0, a * z + b) - t * (a * z + b)) + 1e-4 * np.log(a) ** 2
    for d in (0.97, 1.03):
        assert loss(a, b) <= loss(a * d, b) + 1e-9 and loss(a, b) <= loss(a, b + d - 1) + 1e-9


def test_cotraining_learns_from_few_labels(spark, rows):
    """Labels that the fit never saw are predicted, and scores are the model's as its weights say."""
    docs, labels, texts = rows
    known = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    other = labels.join(known, "doc_id", "left_anti")
    p = cotraining.Params(per_round=40, rounds=2, features=L.Features(chars=(3,), words=(), bits=14))
    m = cotraining.fit(docs, known, p)
    got = cotraining.classify(docs, m, p).join(docs.select("doc_id", "source", "lang", "n_chars"), "doc_id").toPandas()
    meta = cotraining.meta_buckets(pa.array(got["source"]), pa.array(got["lang"]), pa.array(got["n_chars"]))
    z2 = np.clip(m.meta.slope * (m.meta.weights[meta].sum(1) + m.meta.bias) + m.meta.shift, -12, 12)
    for i, row in enumerate(got.itertuples()):
        g = [char_bucket(v, 14) for v in grams(texts[row.doc_id], 3)]
        z1 = float(np.clip(m.text.slope * (m.text.weights[g].sum() * L.SCALE / max(len(g), 1) + m.text.bias) + m.text.shift, -12, 12))
        assert abs(row.text_score - 1 / (1 + np.exp(-z1))) < 1e-4 and abs(row.meta_score - 1 / (1 + np.exp(-z2[i]))) < 1e-6
        assert abs(row.score - 1 / (1 + np.exp(-(m.stack[0] * z1 + m.stack[1] * z2[i] + m.stack[2])))) < 1e-3 and row.kept == (row.score >= 0.5)
    both = got.merge(other.toPandas(), on="doc_id")
    assert len(both) > 50 and (both["kept"] == (both["quality"] == 1)).mean() > 0.9


def test_mixture_meets_its_targets_in_tokens_and_copies(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = mixing.mixture(docs, labels).toPandas()
    q, w, r = np.array(got["posterior"].tolist()), got["n_tokens"].to_numpy(float), got["rate"].to_numpy()
    have = w @ q
    want = (have / have.sum()) ** 0.7
    want = want / want.sum() * (have / (want / want.sum())).max()
    assert (r >= 0).all() and np.abs((w * r) @ q / want - 1).max() < 1e-3 and np.abs(got["reached"] / got["target"] - 1).max() < 1e-3
    assert np.abs((w * got["n_copies"]) @ q / want - 1).max() < 0.06  # whole copies, on average the rate
    assert ((got["n_copies"] == np.floor(r)) | (got["n_copies"] == np.floor(r) + 1) | (np.abs(r - np.rint(r)) < 1e-6)).all()
    assert abs(got["n_copies"].mean() - r.mean()) < 0.02


def test_copies_have_the_rate_as_their_mean(spark):
    df = spark.range(40_000).withColumn("r", F.when(F.col("id") % 2 == 0, 1.3).otherwise(2 - 1e-9))
    got = df.groupBy(F.col("id") % 2).agg(F.avg(mixing.copies(F.col("r"), F.col("id")))).collect()
    assert abs(dict(got)[0] - 1.3) < 0.01 and dict(got)[1] == 2.0


def test_clashing_names_and_missing_columns(spark, rows):
    docs, labels, _ = rows
    few = docs.limit(200)
    more = few.withColumns({c: F.lit(7) for c in ("__tokens", "__p", "__rate", "__copy", "__hit", "__w", "__bits", "__key", "__id", "__text", "__y", "ids")})
    assert mixing.mix(more, labels).columns == more.columns and mixing.mix(more, labels).where("__hit <> 7 or __p <> 7").count() == 0
    from bitloom.llm import partenum

    kept = partenum.keep_first(more)
    assert kept.columns == more.columns and 0 < kept.count() <= 200
    assert cotraining.keep(more, labels).columns == more.columns and toxicity.keep(more, labels).columns == more.columns
    for f in (toxicity.keep, cotraining.keep, mixing.mix):
        with pytest.raises(Exception, match=r"text|UNRESOLVED"):
            f(few.drop("text"), labels).count()
