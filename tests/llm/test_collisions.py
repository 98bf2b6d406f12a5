"""Results don't rest on hashes: texts made to collide, and hashes made nearly useless."""

import random

import numpy as np
import pyarrow as pa
import pytest

from bitloom.llm import bpe, partenum, wavelet
from bitloom.llm import kernels as K
from bitloom.llm.textstats import statistics


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters that every polynomial hash modulo 2**64 takes for the same."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate({97: 98, 98: 97})


def poor(self, other=0):
    """A hash with 7 values."""
    return (self.size % 7).astype(np.uint64) << np.uint64(50)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary_path())


def splitters():
    with open(bpe.vocabulary_path()) as f:
        text = f.read()
    classes = bpe.character_classes()
    return [bpe.Codec(text, classes).split, wavelet.library_splitter(text, classes)]


def check(split, texts, library):
    ids, at = split(*K.text_buffers(pa.array(texts)))
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert e.ids == ids[at[i] : at[i + 1]].tolist(), texts[i][:80]


def test_words_that_collided_are_encoded_apart(library):
    pairs = [w for n in (1024, 2048, 4096) for w in thue_morse(n)]
    rng = np.random.default_rng(1)
    many = " ".join(np.array(["w", "xy", "zq"])[rng.integers(0, 3, 150_000)] + rng.integers(0, 1 << 40, 150_000).astype(str))
    for split in splitters():
        check(split, pairs, library)
        split(*K.text_buffers(pa.array([many])))
        check(split, [f"x {w} y" for w in pairs] + pairs, library)


def test_encoding_with_a_poor_hash(library, monkeypatch):
    monkeypatch.setattr(K.Segments, "hash", poor)
    random.seed(4)
    parts = ["alpha", " beta", " gamma gamma", "\n", "  ", "1", "é", "<|endoftext|>", "longerthaneightbytes", "longerthaneightbytez", " longerthaneightbytes"]
    for split in splitters():
        split._forget()
        for _ in range(3):  # the cache is used in the second and third
            check(split, ["".join(random.choice(parts) for _ in range(random.randint(0, 12))) for _ in range(40)], library)
        split._forget()


def counted(texts):
    got = statistics(*K.text_buffers(pa.array(texts)))
    return [tuple(int(got[c][i]) for c in ("n_dup_lines", "n_repeat_words")) for i in range(len(texts))]


def test_statistics_compare_bytes(monkeypatch):
    a, b = thue_morse(1024)
    texts = [f"{a}\n{b}", f"{a}\n{a}\n{b}", f"{a} {b} {a} {b} {b} {a}", "", "one two three one two three", "xx yy zz xy yy zz", "p q\nr s\np q\nr t\nr s"]
    want = [(0, 0), (1, 0), (0, 0), (0, 0), (0, 6), (0, 0), (2, 6)]
    assert counted(texts) == want
    monkeypatch.setattr(K.Segments, "hash", poor)
    assert counted(texts) == want


def test_sets_that_collided_are_not_linked(spark):
    a, b = thue_morse(2048)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"{a} b c d e f"), (5, f"{b} b c d e f")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
