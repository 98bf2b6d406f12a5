"""Every stage of the pipeline on its own input: against brute force, or against its operator's verdicts."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bitloom.llm import bpe, cotraining, mixing, toxicity
from bitloom.llm.shared import table, written

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage, outputs written and read as the next one's input."""
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        got = written(stage(spark, docs, DATA), name)
        out.append((name, docs, got))
        docs = got
    return {name: (a, b) for name, a, b in out}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_stand_in_order(stages):
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "mixing", "bpe"]
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == stages["quality"][0].columns and stages[name][1].count() > 0


def test_filters_keep_what_their_classifiers_accept(spark, stages):
    labels = table(spark, DATA, "labels")
    docs, kept = stages["quality"]
    good = cotraining.quality_cotraining(docs, labels).where("kept").select("doc_id")
    assert rows(kept) == rows(docs.join(good, "doc_id", "left_semi").select(docs.columns))
    docs, kept = stages["toxicity"]
    clean = toxicity.classify(docs, toxicity.fit(docs, labels)).where("predicted = 0").select("doc_id")
    assert rows(kept) == rows(docs.join(clean, "doc_id", "left_semi").select(docs.columns))
    known = docs.join(labels, "doc_id")
    assert known.where("toxic = 0").join(kept, "doc_id", "left_semi").count() > 0.95 * known.where("toxic = 0").count()


def test_one_of_each_group_stays_by_brute_force(stages):
    docs, kept = stages["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets, holders = {}, {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    shared: dict = {}
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    shared[a, b] = shared.get((a, b), 0) + 1
    up = {i: i for i in texts}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((root(a), root(b)))
            up[b] = a
    want = {i for i in texts if root(i) == i}
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == want and kept.count() == len(want) < len(texts)


def test_mixing_copies_whole_documents(spark, stages):
    docs, mixed = stages["mixing"]
    want = {r["doc_id"]: r["n_copies"] for r in mixing.mixture(docs, table(spark, DATA, "labels")).collect()}
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert rows(mixed.dropDuplicates(["doc_id"])) == rows(docs.join(mixed.select("doc_id").distinct(), "doc_id", "left_semi").select(docs.columns))


def test_tokens_equal_the_library(stages):
    from tokenizers import Tokenizer

    docs, out = stages["bpe"]
    t = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for r in docs.select("doc_id", "text").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(out) == sorted(want, key=str)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_begin_on_executors_that_gave_memory_back(spark, name, stage):
    def full_collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = full_collections()  # in local mode the executor is the driver's JVM
    with pytest.raises(AttributeError):  # without a table no stage goes on
        stage(spark, None, DATA)
    assert full_collections() > before
