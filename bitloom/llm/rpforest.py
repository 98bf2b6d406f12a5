"""Approximate nearest neighbours by cosine: a forest of random-projection trees, one priority queue, exact reranking.

Trees are perfect binary trees fitted on a bounded sample of the distinct vectors (``Params.sample`` of them, more for larger tables, up to
``most_sample``): a node's normal joins two random sample points and splits its sample at the median. Every row is filed under
its leaf in every tree. A query walks all trees through one shared queue, the branch with the smallest largest distance to
a crossed plane first, until enough leaves with rows are gathered and they hold ``k + 1`` rows; their rows are ranked by
exact cosine in double precision. How many leaves are enough is found on the sample, for every depth: as many as reach
``Params.recall`` of the true neighbours of ``trial`` sample queries. The depth is the one at which that costs least (a probe
of a leaf counting as ``probe`` rows), but ``least_depth`` at least, or what the table's size allows, so that there are always trees to search. On data without structure
the leaves that are enough are a large share of all (nothing less finds the neighbours); on clustered data a few. A query that still has fewer than ``k`` neighbours than there are
candidates is searched again in all leaves of one tree.

The plan: equal vectors share a key. Of a batch's equal vectors only the ``k + 1`` smallest ids can matter (ties go to
smaller ids), so the others are left out before the shuffle, exactly. Distinct query vectors are searched once and
their results handed to every query that holds them. Leaves are cut into blocks of rows and of queries (``max_block`` at
most; sizes are summed map-side; as many numbers as leaves), so that no leaf, however full or wanted, falls to one task; a block of
rows and one of queries meet in a cogroup, which passes on the best ``k + 1`` of each query.

Defined results: a null, empty or zero vector, one with null or non-finite components, or one whose length differs
from the sample's commonest takes no part as query or candidate; rows without vec_id take no part; repeated rows are
candidates of their own, but a vec_id is never its own neighbour and appears once in a result; ties go to the smaller vec_id; a query with
fewer candidates gets them all; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.shared import written


@dataclass(frozen=True)
class Params:
    k: int = 5
    trees: int = 2
    sample: int = 20_000
    most_sample: int = 131_072
    leaf: int = 64
    least_depth: int = 4
    probe: int = 500
    recall: float = 0.95
    trial: int = 256
    max_block: int = 16_384
    seed: int = 7


@dataclass
class Forest:
    normals: np.ndarray  # (trees, 2**depth - 1, dim)
    cuts: np.ndarray  # (trees, 2**depth - 1)
    depth: int
    dim: int
    leaves: int = 1

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered over all trees: (rows, trees)."""
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t][node]) >= self.cuts[t][node]
                node = 2 * node + 1 + side
            out[:, t] = node - (2**self.depth - 1) + (t << self.depth)
        return out

    def walk(self, x: np.ndarray, leaves: int, size: np.ndarray, least: int) -> list[list[int]]:
        """The leaves of each query, through one queue over all trees: so many with rows, and ``least`` rows of one tree."""
        inner = 2**self.depth - 1
        gaps = np.einsum("qd,tnd->qtn", x, self.normals) - self.cuts if inner else None
        found = []
        for q in range(len(x)):
            queue = [(0.0, t, 0) for t in range(len(self.normals))]
            got: list[int] = []
            held = [0] * len(self.normals)
            while queue and (len(got) < leaves or max(held) < least):
                far, t, node = heapq.heappop(queue)
                while node < inner:
                    gap = gaps[q, t, node]
                    near = 2 * node + 1 + (gap >= 0)
                    heapq.heappush(queue, (max(far, abs(gap)), t, 4 * node + 3 - near))
                    node = near
                leaf = node - inner + (t << self.depth)
                if size[leaf]:
                    got.append(leaf)
                    held[t] += size[leaf]
            found.append(got)
        return found

    def distance(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): the largest distance to a plane crossed on the way to every leaf, by which the queue goes."""
        far = np.zeros((len(x), len(self.normals), 1))
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            gap = np.einsum("qd,tnd->qtn", x, self.normals[:, nodes]) - self.cuts[:, nodes]
            both = np.repeat(far, 2, axis=2)
            both[:, :, 0::2] = np.where(gap >= 0, np.maximum(far, gap), far)
            both[:, :, 1::2] = np.where(gap >= 0, far, np.maximum(far, -gap))
            far = both
        return far.reshape(len(x), -1)

    def order(self, x: np.ndarray) -> np.ndarray:
        """(rows, leaves): the place of every leaf in each row's queue, from 1 (but for ties)."""
        far = self.distance(x)
        place = np.empty(far.shape, np.int64)
        np.put_along_axis(place, np.argsort(far, axis=1, kind="stable"), np.arange(1, far.shape[1] + 1)[None, :], 1)
        return place if self.depth else np.ones((len(x), len(self.normals)), np.int64)


def plant(sample: np.ndarray, rows: int, p: Params) -> Forest:
    """The forest for so many rows: leaves of about p.leaf rows, but of 8 sample points at least."""
    rng = np.random.default_rng(p.seed)
    dim = sample.shape[1]
    depth = max(0, int(np.floor(np.log2(max(1.0, min(rows / p.leaf, len(sample) / 8))))))
    inner = 2**depth - 1
    normals, cuts = np.zeros((p.trees, inner, dim)), np.zeros((p.trees, inner))
    for t in range(p.trees):
        held = {0: np.arange(len(sample))}
        for node in range(inner):
            ids = held.pop(node)
            normal = np.zeros(dim)
            for _ in range(8):  # equal points give no direction; then any will do
                if len(ids) >= 2:
                    a, b = sample[rng.choice(ids, 2, replace=False)]
                    normal = a - b
                if np.linalg.norm(normal) > 1e-9:
                    break
                normal = rng.standard_normal(dim)
            normal /= max(np.linalg.norm(normal), 1e-12)
            along = sample[ids] @ normal
            cut = np.median(along) if len(ids) else 0.0
            normals[t, node], cuts[t, node] = normal, cut
            side = along >= cut
            held[2 * node + 1], held[2 * node + 2] = ids[~side], ids[side]
    return Forest(normals, cuts, depth, dim)


def fitted(sample: np.ndarray, rows: int, p: Params) -> Forest:
    """The forest cut to the depth, and with the number of leaves, that the sample (of different vectors) calls for."""
    full = plant(sample, rows, p)
    q, k = np.arange(0, len(sample), max(1, len(sample) // p.trial)), min(p.k, len(sample) - 1)
    if k < 1:
        return Forest(full.normals[:, :0], full.cuts[:, :0], 0, full.dim, p.trees)
    true = []
    for at in range(0, len(q), 32):
        near = sample[q[at : at + 32]] @ sample.T
        near[np.arange(len(near)), q[at : at + 32]] = -np.inf
        true.append(np.argpartition(-near, k - 1, 1)[:, :k])
    true = np.concatenate(true)
    best = None
    for depth in range(full.depth, min(full.depth, p.least_depth) - 1, -1):
        inner = 2**depth - 1
        f = Forest(full.normals[:, :inner], full.cuts[:, :inner], depth, full.dim)
        filed, need = f.file(sample), np.zeros(true.shape, int)
        for at in range(0, len(q), 32):
            place = f.order(sample[q[at : at + 32]])
            for i in range(len(place)):
                need[at + i] = place[i][filed[true[at + i]]].min(1)
        f.leaves = int(np.sort(need, axis=None)[min(need.size - 1, int(np.ceil(p.recall * need.size)))])
        cost = f.leaves * (rows / 2**depth + p.probe)
        if best is None or cost < best[0]:
            best = (cost, f)
    return best[1]


def _vectors(col: pa.Array, dim: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors as stored). dim None: any one length, the commonest."""
    size = np.asarray(col.value_lengths().fill_null(0))
    if dim is None:
        live = size[size > 0]
        dim = int(np.bincount(live).argmax()) if len(live) else 0
    ok = np.flatnonzero((size == dim) & (dim > 0))
    if not len(ok):
        return ok, np.zeros((0, dim or 1))
    x = col.take(pa.array(ok)).flatten()
    whole = np.ones(len(ok), bool) if not x.null_count else ~np.asarray(x.is_null()).reshape(len(ok), dim).any(1)
    x = x.fill_null(0).to_numpy(zero_copy_only=False).reshape(len(ok), dim)
    whole &= np.isfinite(x).all(1)
    with np.errstate(all="ignore"):
        norm = np.linalg.norm(x.astype(float), axis=1)
    whole &= (norm > 0) & np.isfinite(norm)
    return ok[whole], x[whole]


def _keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each vector's bytes."""
    words = np.ascontiguousarray(x.astype(np.float64) + 0.0).view(np.uint64)
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        h = np.full(len(x), seed, np.uint64)
        for j in range(words.shape[1]):
            h = K.mix(h * np.uint64(seed | 1) + words[:, j])
        out.append(h.view(np.int64))
    return out[0], out[1]


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, the same for the same two vectors wherever they stand."""
    q, x = q.astype(float), x.astype(float)
    return (q * x).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1)))


def nearest(qs: np.ndarray, xs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best of each query among xs: largest cosine, then smallest id; an id counts once."""
    out = []
    xn = xs.astype(float)
    xn /= np.linalg.norm(xn, axis=1)[:, None]
    for at in range(0, len(qs), 256):
        q = qs[at : at + 256].astype(float)
        rough = (q / np.linalg.norm(q, axis=1)[:, None]) @ xn.T
        least = np.partition(rough, -min(k, len(xs)), 1)[:, -min(k, len(xs))] if len(xs) else np.zeros(len(q))
        row, col = np.nonzero(rough >= least[:, None] - 1e-9)
        score = cosine(q[row], xs[col])
        order = np.lexsort((ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < k
        out.append((row[best] + at, ids[col[best]], score[best]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def search(embeddings: DataFrame, is_query: Column, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest other rows."""
    spark = embeddings.sparkSession
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    store = np.float32 if kind == "float" else np.float64
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and embedding is not null")
    n = rows.count()
    most = int(min(p.most_sample, max(p.sample, 8 * n / p.leaf)))
    place = F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), F.lit(1 << 30))  # a bounded draw, without a sort of all rows
    some = rows.where(place < F.lit(int(min(1.0, most / max(n, 1)) * (1 << 30)) + 1)).limit(2 * most).select("embedding").toArrow().column("embedding").combine_chunks()
    _, sample = _vectors(some, None)
    del some
    dim = sample.shape[1]
    if len(sample):
        sample = sample[np.unique(_keys(sample)[0], return_index=True)[1]]
    unit = sample.astype(float) / np.linalg.norm(sample.astype(float), axis=1)[:, None] if len(sample) else np.zeros((0, dim))
    forest = spark.sparkContext.broadcast(fitted(unit, n, p))  # bounded by the sample
    keep = p.k + 1

    def file(batches):
        f = forest.value
        for batch in batches:
            ok, x = _vectors(batch.column("embedding"), f.dim)
            if not len(ok):
                continue
            ids = batch.column("vec_id").to_numpy()[ok]
            h1, h2 = _keys(x)
            order = np.lexsort((ids, h2, h1))
            new = np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))
            again = np.concatenate(([False], (ids[order][1:] == ids[order][:-1]) & ~new[1:]))
            order, new = order[~again], new[~again]
            first = np.flatnonzero(new)
            take = np.sort(order[np.arange(len(order)) - first[np.cumsum(new) - 1] < keep])
            x, ids = x[take], ids[take]
            leaf = f.file(x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None])
            body = np.ascontiguousarray(x.astype(store))
            cells = pa.array([r.tobytes() for r in body], pa.binary())
            for t in range(leaf.shape[1]):
                yield pa.RecordBatch.from_arrays([pa.array(leaf[:, t]), pa.array(ids), cells], names=["leaf", "vec_id", "body"])

    def ask(batches):
        f = forest.value
        for batch in batches:
            ok, x = _vectors(batch.column("embedding"), f.dim)
            if not len(ok):
                continue
            h1, h2 = _keys(x)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("vec_id").to_numpy()[ok]), pa.array(h1), pa.array(h2), pa.array([r.tobytes() for r in np.ascontiguousarray(x.astype(store))], pa.binary())], names=["query_id", "h1", "h2", "body"])

    def probe(batches, whole: bool = False):
        f, size = forest.value, sizes.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = np.frombuffer(b"".join(b.column("body").to_pylist()), store).reshape(b.num_rows, f.dim).astype(float)
                if whole:
                    lists = [np.flatnonzero(size[: 1 << f.depth]).tolist()] * b.num_rows
                else:
                    lists = f.walk(x / np.linalg.norm(x, axis=1)[:, None], f.leaves, size, keep)
                which = pa.array(np.repeat(np.arange(b.num_rows), [len(g) for g in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int64)), *(b.column(c).take(which) for c in ("h1", "h2", "body"))], names=["leaf", "h1", "h2", "body"])

    filed = rows.select("vec_id", "embedding").mapInArrow(file, "leaf long, vec_id long, body binary")
    held = rows.select("vec_id", "embedding").mapInArrow(file, "leaf long, vec_id long, body binary").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a leaf
    size = np.zeros(p.trees << forest.value.depth, np.int64)
    for r in held:
        size[r["leaf"]] = r["n"]
    sizes = spark.sparkContext.broadcast(size)
    asked = written(rows.where("q").select("vec_id", "embedding").mapInArrow(ask, "query_id long, h1 long, h2 long, body binary"), "queries")
    distinct = asked.groupBy("h1", "h2").agg(F.first("body").alias("body"))

    def rank(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"h1": [], "h2": [], "vec_id": [], "score": []})
        xs = np.frombuffer(b"".join(left["body"]), store).reshape(len(left), -1)
        qs = np.frombuffer(b"".join(right["body"]), store).reshape(len(right), -1)
        q, ids, score = nearest(qs, xs, left["vec_id"].to_numpy(), keep)
        return pd.DataFrame({"h1": right["h1"].to_numpy()[q], "h2": right["h2"].to_numpy()[q], "vec_id": ids, "score": score})

    def ranked(queries: DataFrame, whole: bool) -> DataFrame:
        """(h1, h2, vec_id, score): the best of each query in each block of the leaves it probes."""
        probes = written(queries.mapInArrow(lambda batches: probe(batches, whole), "leaf long, h1 long, h2 long, body binary"), "probes")
        wanted = {r["leaf"]: r["n"] for r in probes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a leaf
        cuts = [(leaf, -(-int(size[leaf]) // p.max_block), -(-n // p.max_block)) for leaf, n in wanted.items()]
        cuts = spark.createDataFrame(cuts, "__leaf long, __cuts int, __asks int")
        part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        xs = filed.join(F.broadcast(cuts), F.col("leaf") == F.col("__leaf")).select("leaf", part("vec_id", "__cuts").alias("cut"), every("__asks").alias("ask"), "vec_id", "body")
        qs = probes.join(F.broadcast(cuts), F.col("leaf") == F.col("__leaf")).select("leaf", every("__cuts").alias("cut"), part("h1", "__asks").alias("ask"), "h1", "h2", "body")
        return xs.groupBy("leaf", "cut", "ask").cogroup(qs.groupBy("leaf", "cut", "ask")).applyInPandas(rank, "h1 long, h2 long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        found = found.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
        found = found.withColumn("__r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id"))).where(F.col("__r") <= keep)
        return written(found.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("best")), "best")

    got = best(ranked(distinct, False))
    named = lambda x: x.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "best")
    same = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))
    short = got.where(F.size("best") < keep)
    if not short.isEmpty() and rows.select("vec_id").distinct().limit(keep).count() >= keep:
        again = distinct.join(short.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")), same, "left_semi")
        got = got.where(F.size("best") >= keep).unionByName(best(ranked(again, True)))
    asked = asked.select("query_id", "h1", "h2").join(named(got), same)
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, p.k)
    out = asked.select("query_id", F.posexplode(own).alias("pos", "b"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
