"""Co-training learns from all unlabelled documents, whatever their number and source."""

import numpy as np
from pyspark.sql import functions as F

from bitloom.llm import cotraining


def test_groups_share_evenly():
    assert cotraining.even(np.array([100.0, 2.0, 50.0, 1.0]), 23).tolist() == [10.0, 2.0, 10.0, 1.0]


def test_unlabelled_documents_of_every_source_are_handed_on(spark, monkeypatch):
    text = lambda i: ("fine solid prose " if i % 2 else "junk spam click ") * 6 + str(i)
    docs = spark.createDataFrame([(i, text(i), f"s{i % 7}" if i >= 900 else "hot", "en", 100 + i) for i in range(1200)], "doc_id long, text string, source string, lang string, n_chars long")
    labels = docs.where("doc_id < 900").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))  # the labels cover most
    assert {r["doc_id"] for r in cotraining.unlabelled(docs, labels.select(F.col("doc_id").alias("__lid"))).collect()} == set(range(900, 1200))
    seen = []
    keep = cotraining.chosen
    monkeypatch.setattr(cotraining, "chosen", lambda scored, column, taught, p: seen.append((scored.count(), column, keep(scored, column, taught, p))) or seen[-1][2])
    cotraining.fit(docs, labels, cotraining.Params(rows=200, per_round=28, rounds=2, confident=0.9))
    assert [n for n, _, _ in seen] == [300] * 4
    handed = [got for _, column, got in seen if column == "__text"]
    for got in handed:
        assert set(got["__id"] % 7) == set(range(7)) and set(got["__class"]) == {0.0, 1.0} and (got["__id"] % 2 == got["__class"]).all()
    assert not set(handed[0]["__id"]) & set(handed[1]["__id"])
