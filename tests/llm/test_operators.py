"""The training-data operators on small fixtures: brute force, round trips, edge cases, extra columns."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bitloom.llm import bloom_lm, bpe, cotraining, mixing, partenum, quality_rules, registry, rpforest, toxicity, warc, wavelet
from bitloom.llm import kernels as K
from bitloom.llm.shared import table
from bitloom.llm.textstats import statistics

DATA = "/root/testdata/sf0.001"
EDGE = [(1, ""), (2, None), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "x" * 200_000), (5, " \n\t"), (6, "one two"), (7, "ONE two"), (8, "naïve café 日本語 \U0001f600 <|endoftext|> it's")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, None if i == 5 else "en", None if i == 6 else "s", None if i == 7 else 1, 0.5, "clash") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, ids string")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, DATA, "labels")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_statistics_by_brute_force():
    random.seed(3)
    texts = ["".join(random.choice(["a ", "b ", "é ", "# ", "\n", "ab\n", "  ", "c d e "]) for _ in range(random.randint(0, 60))) for _ in range(300)] + ["", "\n\n", "x"]
    got = statistics(*K.text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        w, seen, dup = words(t), set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        win = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        rep = {j + d for j, x in enumerate(win) if win.count(x) > 1 for d in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(rep))
        assert tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_shingles_and_links_by_brute_force(spark):
    random.seed(5)
    base = [[random.choice("abcdefgh") + str(random.randrange(40)) for _ in range(random.choice([3, 5, 7, 12, 30, 80, 200]))] for _ in range(60)]
    texts = []
    for b in base:
        for _ in range(random.choice([1, 1, 3, 8])):
            c = list(b)
            for _ in range(random.choice([0, 1, 2, 4])):
                c[random.randrange(len(c))] = "z" + str(random.randrange(1000))
            texts.append(" ".join(c))
    texts += ["", None, "A b", "a B"]
    sets = []
    for t in texts:
        w = words((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    comp = list(range(len(texts)))
    changed = True
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            m = min(comp[i], comp[j])
            changed |= comp[i] != m or comp[j] != m
            comp[i] = comp[j] = m
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_signatures_meet_for_every_similar_pair():
    rng = np.random.default_rng(9)
    p = partenum.Params()
    for n in (4, 5, 9, 14, 22, 40, 90, 230, 700):
        for _ in range(25):
            x = rng.integers(1, 1 << 63, n).astype(np.uint64)
            y, most = list(x), int(n * 0.2 / 1.0)
            for _ in range(int(rng.integers(0, most + 1))):
                y.pop(int(rng.integers(len(y)))) if rng.random() < 0.5 else y.append(np.uint64(rng.integers(1, 1 << 63)))
            a, b = np.unique(x), np.unique(np.array(y, np.uint64))
            inter = len(np.intersect1d(a, b))
            if 100 * inter < 80 * (len(a) + len(b) - inter) or len(a) == inter == len(b):
                continue
            (sa, _), (sb, _) = (partenum.signatures(v, np.array([len(v)]), p) for v in (a, b))
            assert len(np.intersect1d(sa >> np.uint64(1), sb >> np.uint64(1)))
            sk = [partenum.sketches(v, np.array([len(v)]))[0] for v in (a, b)]
            assert partenum.sketch_distances([sk[0]], [sk[1]])[0] <= len(a) + len(b) - 2 * inter


def test_bpe_equals_the_library_and_round_trips(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(edge).collect()}
    want = set()
    for i, text in EDGE:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    rows = bpe.encode(edge).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)


def test_bpe_on_random_texts_against_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    random.seed(2)
    parts = ["a", "s", "'s", "'ll", " ", "  ", "\n", "\t", "1", "é", "日本", "!", " ", "　", "<|endoftext|>", "\U0001f600", "՘", "\x1c", "\x85", "q1z" * 30]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 40))) for _ in range(3000)]
    classes = bpe.character_classes()
    with open(bpe.vocabulary_path()) as f:
        text = f.read()
    for split in (bpe.Codec(text, classes).split, wavelet.library_splitter(text, classes)):
        ids, at = split(*K.text_buffers(pa.array(texts)))
        for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert e.ids == ids[at[i] : at[i + 1]].tolist(), texts[i]


def test_wavelet_shard_answers():
    rng = np.random.default_rng(4)
    for n, top in ((0, 5), (1, 5), (3000, 30), (300_000, 900)):
        ids = np.minimum(rng.geometric(min(1.0, 5 / top), n), 50_000).astype(np.uint32)
        s = wavelet.Shard(io.BytesIO(wavelet.build(ids, np.array([7]), np.array([n]))))
        assert (s.decode() == ids).all() and s.documents()[0].tolist() == [7]
        for i in rng.integers(0, max(n, 1), min(n, 20)).tolist():
            assert s.access(i) == ids[i]
            assert s.rank(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        for token in ids[:3].tolist():
            where = np.flatnonzero(ids == token)
            assert s.count(token) == len(where) and s.select(token, len(where) - 1) == where[-1]
            assert s.locate(token) == where.tolist() and s.select(token, len(where) // 2) == where[len(where) // 2]
        assert s.count(49_999_999) == 0


def test_token_files_round_trip(spark, edge):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.vocabulary_path())
    got = wavelet.token_files(edge.where("doc_id is not null"), wavelet.Params(shard_tokens=50)).orderBy("start").collect()
    start = 0
    for r, (i, text) in zip(got, sorted(((i, t) for i, t in EDGE if i is not None), key=lambda x: x[0]), strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_warc_round_trip_and_revisits(spark):
    rows = [(5, "http://a", "same"), (3, None, "same"), (9, "http://c\r\nX: y", "other"), (4, "u", None), (6, "u", ""), (None, "n", "same"), (8, "big", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = {r["page_id"]: r for r in warc.read(warc.write(pages, warc.Params(archive_bytes=100)), payloads=True).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        first = {"same": 3, "": 4}.get(html or "", i)
        r = got[i]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert (r["payload_bytes"], r["payload_digest"]) == (len((html or "").encode()), warc.digest((html or "").encode()))
        assert i != first or bytes(r["payload"]).decode() == (html or "")


def exact_neighbours(x, ids, q, k=5):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u[q]
    s[q] = -9
    return s, set(ids[np.lexsort((ids, -s))[:k]])


def test_forest_scores_and_ranks(spark):
    emb = table(spark, DATA.replace("0.001", "0.01"), "embeddings")
    rows = emb.collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    got = rpforest.search(emb, F.col("vec_id") % 50 == 0).collect()
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s, best = exact_neighbours(x, ids, q)
        mine = [r for r in got if r["query_id"] == ids[q]]
        hit, total = hit + len(best & {r["vec_id"] for r in mine}), total + 5
        assert [r["rank"] for r in sorted(mine, key=lambda r: r["rank"])] == list(range(1, 6))
        assert all(abs(r["score"] - s[ids == r["vec_id"]][0]) < 1e-12 for r in mine)
    assert hit / total >= 0.9


@pytest.mark.parametrize(("kind", "most"), [("clusters", 0.15), ("none", 0.8)])
def test_forest_recall_with_real_trees(spark, kind, most):
    """20,000 rows: trees of depth 5 or more, over 16 leaves a tree; recall against all rows, and the share of rows ranked."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 32)) if kind == "none" else np.repeat(rng.normal(size=(400, 32)) * 4, 50, 0) + rng.normal(size=(20_000, 32))
    x = x.astype(np.float32)
    ids = np.arange(20_000)
    p = rpforest.Params(least_depth=5)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    f = rpforest.fitted(unit, len(x), p)
    filed = f.file(unit)
    size = np.bincount(filed.ravel(), minlength=p.trees << f.depth)
    queries = np.arange(0, 20_000, 50)
    walks = f.walk(unit[queries], f.leaves, size, p.k + 1)
    share = np.mean([np.isin(filed, walk).any(1).mean() for walk in walks])
    assert f.depth >= 5 and (size[: 1 << f.depth] > 0).sum() > 16 and share < most
    for q, walk in zip(queries[:20], walks, strict=False):
        far = f.distance(unit[[q]])[0]
        assert np.allclose(np.sort(far)[: len(walk)], np.sort(far[walk]))  # nearest leaves first
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    found: dict = {}
    for r in rpforest.search(df, F.col("vec_id") % 50 == 0, p).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = np.mean([len(exact_neighbours(x.astype(float), ids, q)[1] & found[q]) / 5 for q in queries])
    print(kind, "depth", f.depth, "leaves", f.leaves, "rows ranked", round(float(share), 3), "recall", recall)
    assert recall >= 0.9


def test_forest_finds_k_beside_copies(spark):
    """Groups of copies fill the leaves that are enough for most; the others still get k neighbours each."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(30, 8))
    rows = [(i, base[i % 3 if i < 2000 else i - 2000 + 3].tolist()) for i in range(2000 + 27)]
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in rows], "vec_id long, embedding array<double>")
    p = rpforest.Params(leaf=8, max_block=64)
    got = rpforest.search(df, (F.col("vec_id") % 50 == 0) | (F.col("vec_id") >= 2000), p).toPandas()
    n = got.groupby("query_id").size()
    assert len(n) == 40 + 27 and (n == 5).all()


def test_forest_edge_cases(spark):
    bad = [(50, None), (100, []), (150, [0.0, 0.0]), (1, [1.0, None]), (2, [float("nan"), 1.0])]
    good = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [2.0, 0.0]), (200, [0.0, 1.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in bad + good], "vec_id long, embedding array<float>, score int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in rpforest.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 4), (0, 3, 200), (200, 1, 0), (200, 2, 3), (200, 3, 4)]
    assert rpforest.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_lm_base_scores_by_brute_force_in_all_ways(spark):
    docs = table(spark, DATA, "documents")
    rows = docs.select("doc_id", "text").collect()
    toks = {r["doc_id"]: [*words(r["text"].translate({i: i + 32 for i in range(65, 91)})), None] for r in rows}
    c: dict = {}
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            for w in t:
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    one = {r["doc_id"]: r for r in bloom_lm.held_out_scores(docs).collect()}
    few = {r["doc_id"]: r for r in bloom_lm.held_out_scores(docs, bloom_lm.Params(head=20, flush=500)).collect()}
    for i, t in toks.items():
        want = sum(np.log10((c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        for got in (one[i], few[i]):
            assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(t), sum(w in c for w in t), n)
            assert abs(got["base_score"] - want) < 1e-6
        assert abs(one[i]["score"] - few[i]["score"]) < 1e-9 and one[i]["score"] < 0


def test_filter_levels_are_found():
    p = bloom_lm.Params()
    keys = np.sort(K.mix(np.arange(1, 8001, dtype=np.uint64)) >> np.uint64(1))
    counts = np.random.default_rng(0).integers(1, 5000, len(keys))
    first, at, size, tables = [], [], [], {}
    for part in range(3):
        mine = np.flatnonzero(bloom_lm.part(keys, 3) == part)
        body = b""
        for some in np.array_split(mine, 4):
            first.append(keys[some[0]])
            at.append(len(body))
            body += bloom_lm.build_segment(keys[some], counts[some], p)
            size.append(len(body) - at[-1])
        tables[part] = np.frombuffer(body, np.uint8)
    f = bloom_lm.Filter(np.array(first), np.array(at), np.array(size), 3, tables, p.hashes)
    shuffled = np.random.default_rng(1).permutation(len(keys))
    found = f.levels(keys[shuffled])
    want = bloom_lm.level(counts[shuffled], p.base)
    assert (found >= want).all() and (found == want).mean() > 0.95
    absent = K.mix(np.arange(10_000, 30_000, dtype=np.uint64)) >> np.uint64(1)
    assert (f.levels(absent) > 0).mean() < 0.05


def test_lm_scores_by_a_plain_model(spark):
    """With a filter too large to err, scores are those of plain counts on the same quantised scale."""
    docs = table(spark, DATA, "documents")
    p = bloom_lm.Params(bits_per_entry=100.0, segment=5000)
    toks = {r["doc_id"]: [*words((r["text"] or "").translate({i: i + 32 for i in range(65, 91)})), "</s>"] for r in docs.collect()}
    one, two = {"<s>": 0}, {}
    for i, t in toks.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            one["<s>"] += 1
            for a, b in zip(["<s>", *t], t, strict=False):
                one[b] = one.get(b, 0) + 1
                two[a, b] = two.get((a, b), 0) + 1
    n, v = sum(one.values()) - one["<s>"], len(one) - 1
    seen = lambda c: bloom_lm.estimate(bloom_lm.level(np.array([c]), p.base), p.base)[0] if c else 0.0
    got = {r["doc_id"]: r["score"] for r in bloom_lm.held_out_scores(docs, p).collect()}
    for i, t in toks.items():
        want = 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            prior = (seen(one.get(b, 0)) + 0.5) / (n + 0.5 * (v + 1))
            ahead = seen(one.get(a, 0))
            want += np.log10((min(seen(two.get((a, b), 0)), ahead) + p.kappa * prior) / (ahead + p.kappa))
        assert abs(got[i] - want) < 1e-6 * max(1.0, abs(want))


def test_classifiers_on_held_out_labels(spark, labels):
    d = DATA.replace("0.001", "0.1")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    t = toxicity.held_out_toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    assert (t["predicted"] == t["toxic"]).mean() > 0.97
    q = cotraining.quality_cotraining(docs, labels).join(labels, "doc_id").toPandas()
    assert (q["kept"] == (q["quality"] == 1)).mean() > 0.97
    r = quality_rules.quality_rules(docs, labels).where("not base_failed").drop("quality").join(labels, "doc_id").toPandas()
    assert (r["kept"] == (r["quality"] == 1)).mean() > 0.97


def test_mixing_meets_its_targets(spark, labels):
    docs = table(spark, DATA.replace("0.001", "0.01"), "documents")
    labels = table(spark, DATA.replace("0.001", "0.01"), "labels")
    m = mixing.fit(docs, labels)
    k = len(m.domains)
    narrow = mixing.posteriors(docs.select("text"), m).groupBy("__p").agg(F.sum("__tokens").alias("__w")).toPandas()
    q, w = np.array(narrow["__p"].tolist()), narrow["__w"].to_numpy(float)
    have = w @ (q / mixing.UNIT)
    targets = have.sum() * np.array([0.4, 0.3, 0.2, 0.1][:k])
    moves = mixing.solve(spark.createDataFrame(narrow), k, mixing.Params(steps=200), targets)
    r = mixing.rates(q, moves)
    assert (r >= 0).all() and np.abs((w * r) @ (q / mixing.UNIT) - targets).max() < 0.02 * targets.sum()


def test_edge_rows_and_empty_tables(spark, edge, labels):
    n = len(EDGE)
    for f in (lambda d: quality_rules.quality_rules(d, labels), lambda d: cotraining.quality_cotraining(d, labels), lambda d: toxicity.held_out_toxicity(d, labels), lambda d: mixing.mixture(d, labels), bloom_lm.held_out_scores, partenum.near_duplicates, bpe.digests, wavelet.token_files):
        assert f(edge).count() == n
        assert f(edge.limit(0)).count() == 0
    comp = {r["doc_id"]: r["component_id"] for r in partenum.near_duplicates(edge).collect()}
    assert comp == {1: 1, 2: 2, None: None, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8}
    for f in (lambda d: cotraining.keep(d, labels), lambda d: toxicity.keep(d, labels), partenum.keep_first, lambda d: mixing.mix(d, labels)):
        assert f(edge).columns == edge.columns and f(edge.limit(0)).count() == 0
    assert sorted(r["doc_id"] or 0 for r in partenum.keep_first(edge).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_pipeline_and_sql(spark):
    import corpus_pipeline

    docs = table(spark, DATA, "documents")
    out = corpus_pipeline.run(spark, DATA)
    assert 0 < out.count() and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.join(docs, "doc_id", "left_anti").count() == 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
