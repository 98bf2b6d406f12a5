"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs of all training texts are summed (each task adds up its own first), quantised on a
logarithmic scale, ``level(c) = 1 + floor(log_base(c))``, and an n-gram is entered once for each of its levels 1, 2, ...,
level(c). A lookup probes level after level until one is absent; the last present gives the count. The filter is cut
into segments of about ``segment`` n-grams in order of their hashes, however many there are, each sized for what it holds. A task
writes its segments to one file of the shared folder; what is broadcast is the list of segments, and the workers map
the files, read-only, so that those of a machine share one copy and one pass serves a filter of any size (where
the folder is no mounted one, Spark ships the files to the executors).

``score`` is the sum over tokens of log10 of ``(c(v w) + kappa P(w)) / (c(v) + kappa)`` with looked-up counts, where v is the
token before (a text's start counts as a token there) and ``P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))``.

An absent n-gram is taken for a present one at a rate that ``bits_per_entry`` sets; which ones depends on how the
segments are cut, thus also on the number of shuffle partitions.

``kappa`` was chosen on fold 2 of the given tables, a part of the training rows, by a model of folds 0, 3 and 4 (the
held-out fold 1 had no part in it).

``base_score`` uses exact counts, by 128-bit hashes of the tokens: those of the commonest tokens, ``head`` at most, are broadcast (a fixed size) and settle most
tokens in place; the rest, of which none is frequent, meet their counts in a join.

Tokens are the words of the whole text, A-Z lower-cased, then one end. Defined results: null or empty text is the
end alone; rows with a null id belong to the fold of the empty text; repeated rows are scored, and counted, each; with
no training rows N and V are 0 and every token has the same probability; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.files import Writer
from bitloom.llm.shared import fold, shared_path, slots, written

#: Hashes (63 bits) of a text's end and start, and their second hashes.
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
_ONE = np.uint64(1)


@dataclass(frozen=True)
class Params:
    base: float = 1.5
    kappa: float = 300.0
    bits_per_entry: float = 9.6
    hashes: int = 6
    segment: int = 1 << 17
    head: int = 200_000
    flush: int = 1_500_000


@dataclass
class Tokens:
    """The tokens of a chunk, each text's end after its words: different words once, and which of them each token is.

    ``key`` and ``key2`` are two hashes (63 bits) of the different tokens, the end being the last one."""

    key: np.ndarray
    key2: np.ndarray
    which: np.ndarray
    row: np.ndarray

    def pairs(self) -> np.ndarray:
        """The hash of each token with the one before it in its text."""
        words = self.key[self.which]
        before = np.concatenate(([START], words[:-1]))[: len(words)]
        before[self.first()] = START
        return K.mix(before * _PAIR + words) >> _ONE

    def first(self) -> np.ndarray:
        """Where texts begin."""
        return np.flatnonzero(np.concatenate(([True], self.row[1:] != self.row[:-1]))[: len(self.row)])


def tokens(buf: np.ndarray, off: np.ndarray) -> Tokens:
    low = K.lowered(buf)
    starts, ends, row = K.spans(low, off)
    rows = len(off) - 1
    at = np.searchsorted(starts, off[1:])
    words = K.Segments(low, starts, ends)
    h = words.hash()
    where, which = words.distinct(h)
    key, key2 = np.append(h[where] >> _ONE, END), np.append(words.hash(1)[where] >> _ONE, END)
    return Tokens(key, key2, np.insert(which, at, len(where)), np.insert(row, at, np.arange(rows)))


def level(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(base) + 1e-9).astype(np.int64)


def estimate(levels: np.ndarray, base: float) -> np.ndarray:
    """The mean whole count that has the level; 0 for level 0."""
    top = int(levels.max(initial=0))
    low = np.ceil(base ** np.arange(0, top + 1) - 1e-9)
    mids = np.concatenate(([0.0], (low[:-1] + np.maximum(low[:-1], low[1:] - 1)) / 2))
    return mids[levels]


def _start(key: np.ndarray, lev) -> tuple[np.ndarray, np.ndarray]:
    """What the places of a (key, level) begin with, and what is added for each further hash."""
    a = K.mix(key + np.asarray(lev, np.uint64) * _PAIR)
    return a, K.mix(a ^ END) | _ONE


def _spot(a: np.ndarray, bits) -> np.ndarray:
    """A place among ``bits`` (below 2**32) bits."""
    return ((a >> np.uint64(32)) * bits) >> np.uint64(32)


def build_segment(keys: np.ndarray, counts: np.ndarray, p: Params) -> bytes:
    """One segment's bits (little-endian in bytes), a whole number of 64."""
    lev = level(counts, p.base)
    key = np.repeat(keys, lev)
    step = np.arange(len(key)) - np.repeat(np.cumsum(lev) - lev, lev) + 1
    bits = max(64, -(-int(len(key) * p.bits_per_entry) // 64) * 64)
    table = np.zeros(bits, bool)
    a, more = _start(key, step)
    for _ in range(p.hashes):
        table[_spot(a, np.uint64(bits)).astype(np.int64)] = True
        a += more
    return np.packbits(table, bitorder="little").tobytes()


def part(key: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal ranges of hashes a key lies in."""
    return ((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(31)


class _Range:
    """Bytes from one address to another, as numpy reads them."""

    def __init__(self, first: int, size: int):
        self.__array_interface__ = {"data": (first, True), "shape": (size,), "typestr": "|u1", "version": 3}


class Filter:
    """The segments of a filter, in files (``tables``: their bytes, by part)."""

    def __init__(self, first: np.ndarray, at: np.ndarray, size: np.ndarray, parts: int, tables: dict[int, np.ndarray], hashes: int):
        """first: each segment's least key, ascending; at, size: its place in its part's file."""
        self.first, self.bits, self.parts, self.hashes, self.tables = first, (8 * size).astype(np.uint64), parts, hashes, tables
        where = {f: t.__array_interface__["data"][0] for f, t in tables.items()}
        low = min(where.values(), default=0)
        # One view over all mapped files, wherever they lie; only places within segments are read.
        self.bytes = np.asarray(_Range(low, max((where[f] + len(t) for f, t in tables.items()), default=0) - low))
        self.part = part(first, parts)
        self.at = at + np.array([where[int(f)] - low for f in self.part.tolist()], np.int64)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """The last level present without a gap; 0 for absent n-grams."""
        out = np.zeros(len(key), np.int64)
        if not len(self.first):
            return out
        segment = np.searchsorted(self.first, key, "right") - 1
        ids = np.flatnonzero((segment >= 0) & (self.part[segment] == part(key, self.parts)))  # else its part holds nothing that low
        k, at, bits, lev = key[ids], self.at[segment[ids]], self.bits[segment[ids]], 1
        while len(ids):
            a, more = _start(k, lev)
            live, own_at, own_bits = np.arange(len(ids)), at, bits
            for _ in range(self.hashes):
                spot = _spot(a, own_bits)
                hit = np.flatnonzero(self.bytes[own_at + (spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
                if len(hit) < len(live):
                    live, a, more, own_at, own_bits = live[hit], a[hit], more[hit], own_at[hit], own_bits[hit]
                a = a + more
            if len(live) < len(ids):
                ids, k, at, bits = ids[live], k[live], at[live], bits[live]
            out[ids] = lev
            lev += 1
        return out


def _counted(docs: DataFrame, p: Params) -> DataFrame:
    """(key, key2, n, kind): kind 1 for tokens and starts, 2 for pairs (without key2); each task's sums, flushed beyond
    p.flush n-grams."""

    def run(batches):
        held: dict[int, list] = {1: [], 2: []}
        sizes = {1: 0, 2: 0}

        def flush(kind):
            keys, other, counts = (np.concatenate(x) for x in zip(*held[kind], strict=True))
            order = np.argsort(keys, kind="stable")
            keys, other = keys[order], other[order]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1]))))
            held[kind] = [(keys[first], other[first], np.add.reduceat(counts[order], first))]
            sizes[kind] = len(first)

        def emit(kind):
            for keys, other, counts in held[kind]:
                for at in range(0, len(keys), 1 << 16):
                    k, o, c = (x[at : at + (1 << 16)] for x in (keys, other, counts))
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(o.view(np.int64)), pa.array(c), pa.array(np.full(len(k), kind, np.int8))], names=["key", "key2", "n", "kind"])
            held[kind], sizes[kind] = [], 0

        for batch in batches:
            for chunk in K.chunks(batch, "text"):
                t = tokens(*K.text_buffers(chunk.column("text")))
                single = np.append(np.bincount(t.which, minlength=len(t.key)), chunk.num_rows)
                both, counts = np.unique(t.pairs(), return_counts=True)
                for kind, x in ((1, (np.append(t.key, START), np.append(t.key2, START), single)), (2, (both, np.zeros(len(both), np.uint64), counts))):
                    held[kind].append(x)
                    sizes[kind] += len(x[0])
                    if sizes[kind] > p.flush:
                        flush(kind)
                        if sizes[kind] > p.flush // 2:
                            yield from emit(kind)
        for kind in (1, 2):
            if held[kind]:
                flush(kind)
                yield from emit(kind)

    return docs.select("text").mapInArrow(run, "key long, key2 long, n long, kind byte")


def _built(counts: DataFrame, parts: int, p: Params) -> DataFrame:
    """The filter's files, and rows of two kinds, written: (key, uri, at, n) for a segment, where key is its least and n its bytes;
    (key, key2, n) for a token. One shuffle, in which equal n-grams meet and add up."""
    folder = shared_path(counts.sparkSession, "bloom")

    def run(batches):
        held, size = [], 0
        out = None

        def close(whole: bool):
            """Segments of what is held; unless all is, the last key's rows wait for more of them."""
            nonlocal held, size, out
            keys, other, n, kind = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(keys) if whole else int(np.searchsorted(keys, keys[-1]))
            held, size = [(keys[end:], other[end:], n[end:], kind[end:])], len(keys) - end
            if not end:
                return
            keys, other, n, kind = keys[:end], other[:end], n[:end], kind[:end]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            body = build_segment(keys[first].view(np.uint64), np.add.reduceat(n, first), p)
            if out is None:
                out = Writer(folder, "segments", ".bloom")
            at = out.size
            out.write(body)
            yield pa.RecordBatch.from_arrays([pa.array([keys[0]]), pa.nulls(1, pa.int64()), pa.array([len(body)], pa.int64()), pa.array([out.uri]), pa.array([at], pa.int64())], names=["key", "key2", "n", "uri", "at"])
            word = kind == 1
            keys, other, n = keys[word], other[word], n[word]
            first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (other[1:] != other[:-1])))[: len(keys)])
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(other[first]), pa.array(np.add.reduceat(n, first)), pa.nulls(len(first), pa.string()), pa.nulls(len(first), pa.int64())], names=["key", "key2", "n", "uri", "at"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(batch.column(c).to_numpy() for c in ("key", "key2", "n", "kind")))
                size += batch.num_rows
            if size >= p.segment:
                yield from close(False)
        if held:
            yield from close(True)
        if out is not None:
            out.close()

    where = F.shiftright(F.shiftright("key", 32) * F.lit(parts), 31).cast("int")
    dealt = counts.repartitionById(parts, where).sortWithinPartitions("key", "kind", "key2")
    return written(dealt.mapInArrow(run, "key long, key2 long, n long, uri string, at long"), "ngrams")


_MAPPED: dict[str, np.ndarray] = {}


def _mapped(uri: str) -> np.ndarray:
    """A file of the shared folder, mapped read-only; one that isn't mounted is where Spark put it."""
    if uri not in _MAPPED:
        from pyspark import SparkFiles

        path = uri.removeprefix("file://") if uri.startswith(("/", "file:")) else SparkFiles.get(uri.rpartition("/")[2])
        _MAPPED[uri] = np.memmap(path.removeprefix("file:"), np.uint8, "r")
    return _MAPPED[uri]


@dataclass
class Base:
    """Exact statistics: totals, and the commonest tokens' counts."""

    n: int
    v: int
    keys: np.ndarray
    keys2: np.ndarray
    counts: np.ndarray


def score(docs: DataFrame, train: Column, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), train.alias("train"))
    parts = slots(spark)
    built = _built(_counted(docs.where("train"), p), parts, p)
    words = built.where(F.col("uri").isNull() & (F.col("key") != int(START))).select("key", "key2", "n")
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The head are the tokens of the highest bands of counts that hold ``head`` or fewer: no sort, no more rows than that.
    band = F.floor(8 * F.log2("n")).cast("int")
    bands = sorted(map(tuple, words.groupBy(band.alias("b")).count().collect()), reverse=True)  # some hundreds
    least = next((b for (b, _), n in zip(bands, np.cumsum([n for _, n in bands]), strict=True) if n > p.head), -1)
    top = words.where(band > least).toPandas().sort_values("key")
    base = Base(int(total["n"] or 0), int(total["v"]), *(top[c].to_numpy(np.int64) for c in ("key", "key2", "n")))
    segments = built.where(F.col("uri").isNotNull()).select("key", "at", "n", "uri").toPandas().sort_values("key")  # one row a segment
    first = segments["key"].to_numpy(np.int64).view(np.uint64)
    files = {int(f): uri for f, uri in zip(part(first, parts), segments["uri"], strict=True)}
    for uri in files.values():
        if not uri.startswith(("/", "file:")):
            spark.sparkContext.addFile(uri)
    shared = spark.sparkContext.broadcast((base, first, segments["at"].to_numpy(np.int64), segments["n"].to_numpy(np.int64), files))

    def run(batches):
        b, first, at, size, files = shared.value
        bloom = Filter(first, at, size, parts, {f: _mapped(uri) for f, uri in files.items()}, p.hashes)
        floor = 0.5 * (b.v + 1) + b.n
        begin = estimate(bloom.levels(np.array([START])), p.base)[0]
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in K.chunks(batch, "text"):
                rows = chunk.num_rows
                t = tokens(*K.text_buffers(chunk.column("text")))
                n = len(t.which)
                one = estimate(bloom.levels(t.key), p.base)[t.which]
                ahead = np.concatenate(([begin], one[:-1]))[:n]
                ahead[t.first()] = begin
                two = np.minimum(estimate(bloom.levels(t.pairs()), p.base), ahead)
                prob = (two + p.kappa * (one + 0.5) / floor) / (ahead + p.kappa)
                key, key2 = t.key.view(np.int64), t.key2.view(np.int64)
                place = np.minimum(np.searchsorted(b.keys, key), max(len(b.keys) - 1, 0))
                known = (b.keys[place] == key) & (b.keys2[place] == key2) if len(b.keys) else np.zeros(len(key), bool)
                count = np.where(known, b.counts[place], 0) if len(b.keys) else np.zeros(len(key), np.int64)
                if len(b.keys) == b.v:
                    known[:] = True
                settled, count, row = known[t.which], count[t.which], t.row
                logs = np.bincount(row[settled], np.log10(count[settled] + 0.5), minlength=rows)
                hits = np.bincount(row[settled], count[settled] > 0, minlength=rows).astype(np.int64)
                rest = t.which[~settled]
                ends = np.concatenate(([0], np.cumsum(np.bincount(row[~settled], minlength=rows))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(key[rest]), pa.array(key2[rest])], names=["a", "b"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + rows)), chunk.column("doc_id"), pa.array(np.bincount(row, minlength=rows)), pa.array(hits), pa.array(logs), pa.array(np.bincount(row, np.log10(prob), minlength=rows)), lists],
                    names=["rid", "doc_id", "n_tokens", "hits", "logs", "score", "rest"],
                )
                rid += rows

    scored = written(docs.mapInArrow(run, "rid long, doc_id long, n_tokens long, hits long, logs double, score double, rest array<struct<a: bigint, b: bigint>>"), "scored")
    rest = scored.select("rid", F.explode("rest").alias("key")).groupBy("rid", "key").agg(F.count(F.lit(1)).alias("f"))
    rest = rest.join(words.select(F.col("key").alias("__k"), F.col("key2").alias("__k2"), F.col("n").alias("__c")), (F.col("key.a") == F.col("__k")) & (F.col("key.b") == F.col("__k2")), "left")
    rest = rest.groupBy(F.col("rid").alias("__rid")).agg(F.sum(F.when(F.col("__c") > 0, F.col("f")).otherwise(0)).alias("__hits"), F.sum(F.col("f") * F.log10(F.coalesce("__c", F.lit(0)) + 0.5)).alias("__logs"))
    out = scored.drop("rest").join(rest, F.col("rid") == F.col("__rid"), "left")
    floor = float(np.log10(base.n + 0.5 * (base.v + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("hits") + F.coalesce("__hits", F.lit(0))).alias("n_known"),
        F.lit(base.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("__logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        "score",
    )


def held_out_scores(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Scores of all documents; learnt from those whose fold is not 1."""
    out = score(docs, fold("doc_id") != 1, p)
    return out.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
