"""Exact n-gram Jaccard join by PartEnum signatures, and the components of its links.

Sets are the distinct 5-word shingles of whole, A-Z lower-cased texts. Set sizes are cut into bands such that two sets
of similarity ``num/den`` lie in one band or in neighbours; instance ``j`` joins band ``j`` with itself and with band
``j - 1``. Within an instance sets at the threshold differ in at most ``k`` shingles. The shingle domain is hashed into
``n1`` parts of ``n2`` pieces; with more than ``k // (k2 + 1)`` parts, some part has at most ``k2`` differing shingles,
so its shingles in some choice of ``n2 - k2`` pieces are the same in both sets. One signature stands for each part and
choice, but none for an empty choice, which would join strangers. If either set of a pair has fewer parts with an empty
choice than the parts that must agree, the pair still shares a signature; a set that has more issues signatures under
a second hashing of the domain too, then a third, and so on: two sets that are both short both go on, so they meet at
the first hashing that suits either, and the join stays exact (after ``TURNS`` hashings empty choices are signed as
well). ``n1``, ``n2``, ``k2`` of each band are searched for the fewest signatures.

The plan: equal sets fall into classes by a 128-bit hash (summed map-side; a class's documents are never paired).
Signatures, once per class and task, are dealt out by hash and sorted; a streaming pass links every member of a
signature to its first, so rows stay linear in members, and notes the members of signatures that three or more share.
Distinct links are tested: first by the sets' parity sketches (two sets differ in at least as many shingles as their
sketches differ in bits, so a sketch only ever rejects pairs that are too far apart), then on the documents' whole
texts, of which every shared shingle is compared byte by byte. Words are hashed under a secret seed drawn for each join, so no text
can be made to collide; equal classes rest on 128 bits of such hashes. Linked pairs are contracted to components. Where a signature's members still lie in different components, all their pairs across
components are compared by sketch within the task (in blocks of ``BLOCK`` members, a task a pair of blocks, so no
signature is one task's); only pairs that the sketches leave become rows, and are tested as before: no link is lost,
and nothing is capped.

Defined results: null text, or text without words, is the empty set, linked with nothing; fewer than five words are one
shingle; rows without doc_id take no part in links and have no component; rows of one doc_id are one document for
links (any of its texts may link it); repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import math
import secrets
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.components import components
from bitloom.llm.semi import only, without
from bitloom.llm.shared import slots, written

#: Hashings of the domain a set tries before it issues signatures of empty choices as well.
TURNS = 24
#: Members of a signature that one task compares with each other or with as many others.
BLOCK = 1024
_SALT = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Params:
    words: int = 5
    num: int = 80
    den: int = 100
    seed: int | None = None  # of the words' hashes; a secret one for each join if None


@dataclass(frozen=True)
class Instance:
    """How band ``j`` is joined with itself and the band below."""

    j: int
    low: int
    high: int
    k: int
    n1: int
    n2: int
    k2: int

    @property
    def good(self) -> int:
        """Parts with at most k2 differing shingles, at least."""
        return self.n1 - self.k // (self.k2 + 1)

    @property
    def choices(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.n2), self.n2 - self.k2))


@lru_cache(None)
def band(j: int, num: int, den: int) -> tuple[int, int]:
    low = 1 if j == 0 else band(j - 1, num, den)[1] + 1
    return low, max(low, low * den // num)


def _short_of_parts(size: int, n1: int, n2: int, k2: int, spare: int) -> float:
    """About how likely a set of this size has more than ``spare`` parts with an empty choice (Poisson)."""
    parts = n1 * min(1.0, math.comb(n2, k2) * (1 - (n2 - k2) / (n1 * n2)) ** size)
    term = total = math.exp(-parts)
    for i in range(1, spare + 1):
        term *= parts / i
        total += term
    return max(0.0, 1 - total)


@lru_cache(None)
def instance(j: int, num: int, den: int) -> Instance | None:
    """The plan with the fewest expected signatures, repeats included; None where sets at the threshold are equal."""
    low, high = band(j, num, den)
    k = 2 * (den - num) * high // (den + num)
    if k == 0:
        return None
    below = band(max(j - 1, 0), num, den)[0]
    best = None
    for k2 in range(1, min(k, 4) + 1):
        for n2 in range(k2 + 1, k2 + 5):
            spare = 0
            while True:
                n1 = k // (k2 + 1) + 1 + spare
                cost = n1 * math.comb(n2, k2)
                if spare > 4 + k // 2 or best and 2 * cost >= best[0]:
                    break
                cost = sum(cost / max(1e-3, 1 - _short_of_parts(size, n1, n2, k2, spare)) for size in ((low + high) // 2, (below + low) // 2))
                if best is None or cost < best[0]:
                    best = (cost, Instance(j, low, high, k, n1, n2, k2))
                spare += 1 + spare // 8
    return best[1]


def bands_of(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """The band of each size (at least 1)."""
    highs, j = [], 0
    while not highs or highs[-1] < sizes.max(initial=1):
        highs.append(band(j, num, den)[1])
        j += 1
    return np.searchsorted(highs, sizes)


@dataclass
class Shingles:
    """Distinct shingles of each text, one text after another: hashes, counts by text, and where each stands."""

    h: np.ndarray
    count: np.ndarray
    at: np.ndarray  # the shingle's first word
    size: np.ndarray  # words of a text
    words: K.Segments

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(buf: np.ndarray, off: np.ndarray, p: Params) -> Shingles:
    n, rows = p.words, len(off) - 1
    low = K.lowered(buf)
    starts, ends, row = K.spans(low, off)
    words = K.Segments(low, starts, ends, p.seed or 0)
    hashed = words.hash()
    h, at = K.windows(hashed, row, n)
    r = row[at]
    bound = np.searchsorted(starts, off)
    count = np.diff(bound)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = bound[:-1]
        whole = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            live = count[short] > i
            whole[live] = K.mix(whole[live] * K._BASE + hashed[first[short[live]] + i])
        h, r, at = np.concatenate((h, K.mix(whole ^ _SALT))), np.concatenate((r, short)), np.concatenate((at, first[short]))
    order = np.lexsort((h, r))
    h, r, at = h[order], r[order], at[order]
    if len(h):
        first = np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))
        h, r, at = h[first], r[first], at[first]
    return Shingles(h, np.bincount(r, minlength=rows), at, count, words)


def shingle_sets(buf: np.ndarray, off: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one text after another, and their counts."""
    s = shingles(buf, off, p)
    return s.h, s.count


def common(a: Shingles, b: Shingles, p: Params) -> np.ndarray:
    """Shingles that texts a[i] and b[i] share, by i: found by hash, compared byte by byte."""
    ra, rb = a.row(), b.row()
    mark = K.mix(np.arange(1, len(a.count) + 1, dtype=np.uint64))
    _, i, j = np.intersect1d(K.mix(a.h ^ mark[ra]), K.mix(b.h ^ mark[rb]), return_indices=True)
    size = np.minimum(a.size[ra[i]], p.words)
    ok = (ra[i] == rb[j]) & (size == np.minimum(b.size[rb[j]], p.words))
    for k in range(p.words):
        live = np.flatnonzero(ok & (size > k))
        ok[live] = a.words.same(a.at[i[live]] + k, b.words, b.at[j[live]] + k)
    return np.bincount(ra[i[ok]], minlength=len(a.count))


def _sum64(values: np.ndarray, cell: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by cell."""
    low = np.bincount(cell, (values & np.uint64(0xFFFFFFFF)).astype(float), minlength=n).astype(np.uint64)
    high = np.bincount(cell, (values >> np.uint64(32)).astype(float), minlength=n).astype(np.uint64)
    return low + (high << np.uint64(32))


def set_hashes(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    row = np.repeat(np.arange(len(count)), count)
    return tuple(K.mix(_sum64(K.mix(h ^ s), row, len(count)) + count.astype(np.uint64)) for s in (_SALT, _SALT ^ K._GOLD))


def signatures(h: np.ndarray, count: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of each set (with its row): 63 bits and, lowest, whether the set is of the lower band there."""
    out, rows = [], []
    start = np.cumsum(count) - count
    own = bands_of(np.maximum(count, 1), p.num, p.den)
    live = count > 0
    for lower in (0, 1):
        for j in np.unique(own[live]):
            plan = instance(int(j) + lower, p.num, p.den)
            if plan is None:
                continue
            who = np.flatnonzero(live & (own == j))
            for turn in range(TURNS):
                size = count[who]
                d = np.repeat(np.arange(len(who)), size)
                e = h[np.arange(size.sum()) + np.repeat(start[who] - (np.cumsum(size) - size), size)]
                place = K.mix(e ^ K.mix(np.array([(plan.j + 1) << 8 | turn], np.uint64)))
                part = ((place >> np.uint64(32)) * np.uint64(plan.n1)) >> np.uint64(32)
                piece = ((place & np.uint64(0xFFFFFFFF)) * np.uint64(plan.n2)) >> np.uint64(32)
                cell = (d * plan.n1 + part.astype(np.int64)) * plan.n2 + piece.astype(np.int64)
                cells = len(who) * plan.n1 * plan.n2
                content = K.mix(_sum64(K.mix(e + _SALT), cell, cells)).reshape(len(who), plan.n1, plan.n2)
                full = (np.bincount(cell, minlength=cells) > 0).reshape(len(who), plan.n1, plan.n2)
                content = np.where(full, content * (2 * np.arange(plan.n2, dtype=np.uint64) + np.uint64(3)), np.uint64(0))
                name = K.mix(np.arange(plan.n1, dtype=np.uint64) + np.uint64((plan.j + 1) << 40 | turn << 32))
                empty = np.stack([~full[:, :, list(c)].any(2) for c in plan.choices], 2)
                short = empty.any(2).sum(1) >= plan.good
                for i, c in enumerate(plan.choices):
                    sig = K.mix(content[:, :, list(c)].sum(2) + name[None, :] * np.uint64(2 * i + 1))
                    use = ~empty[:, :, i]
                    if turn == TURNS - 1:
                        use |= short[:, None]
                    out.append((sig[use] & ~np.uint64(1)) | np.uint64(lower))
                    rows.append(who[np.nonzero(use)[0]])
                who = who[short]
                if not len(who):
                    break
    cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return cat(out, np.uint64), cat(rows, np.int64)


def sketches(h: np.ndarray, count: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: bit i is the parity of its shingles that hash to i; 2 bits a shingle or more.

    Sizes are powers of two, and a longer sketch folds to a shorter by XOR of its halves."""
    size = 64 << np.maximum(0, np.ceil(np.log2(np.maximum(count, 1) / 32)).astype(np.int64))
    start = np.cumsum(size) - size
    at = (K.mix(h ^ K._M2) & (np.repeat(size, count) - 1).astype(np.uint64)).astype(np.int64) + np.repeat(start, count)
    bits = np.packbits((np.bincount(at, minlength=int(size.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [bits[a // 8 : (a + n) // 8] for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches of one size as rows of so many 64-bit words."""
    x = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def sketch_distances(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Bits in which the parity sketches of each pair differ: at most the number of shingles in just one of the sets. Pairs of
    like sizes are compared at once."""
    size = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    out = np.zeros(len(a), np.int64)
    for m, n in np.unique(size, axis=0).tolist():
        which = np.flatnonzero((size == (m, n)).all(1))
        words = min(m, n) // 8
        out[which] = np.bitwise_count(folded([a[i] for i in which], words) ^ folded([b[i] for i in which], words)).sum(1, dtype=np.int64)
    return out


def near_pairs(doc: np.ndarray, comp: np.ndarray, lower: np.ndarray, block: np.ndarray, n: np.ndarray, sketch: list[bytes], p: Params) -> np.ndarray:
    """The pairs (doc, doc) of different components, not both lower, that size and sketch don't rule out.

    With two blocks, pairs within a block are left to others. The largest component is only compared with the rest."""
    words = min(map(len, sketch)) // 8
    x, long = np.empty((len(sketch), words), np.uint64), np.array([len(s) for s in sketch])
    for m in np.unique(long).tolist():
        which = np.flatnonzero(long == m)
        x[which] = folded([sketch[i] for i in which], words)
    names, size = np.unique(comp, return_counts=True)
    two = block.min() != block.max()
    out = []
    rows = np.flatnonzero(comp != names[size.argmax()])
    step = max(1, (1 << 22) // (len(doc) * words))
    for at in range(0, len(rows), step):
        i = rows[at : at + step, None]
        ok = (comp[i] != comp) & (lower[i] + lower < 2)
        if two:
            ok &= block[i] != block
        both = n[i] + n
        ok &= (p.den + p.num) * np.abs(n[i] - n) <= (p.den - p.num) * both
        r, c = np.nonzero(ok)
        far = np.concatenate([np.bitwise_count(x[i[r[k : k + (1 << 16)], 0]] ^ x[c[k : k + (1 << 16)]]).sum(1, dtype=np.int64) for k in range(0, len(r), 1 << 16)] or [np.zeros(0, np.int64)])
        good = (p.den + p.num) * far <= (p.den - p.num) * both[r, c]
        a, b = doc[i[r[good], 0]], doc[c[good]]
        out.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
    return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)


def _sets(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n_shingles, h1, h2, sketch of every row."""

    def run(batches):
        for batch in batches:
            for part in K.chunks(batch, "text"):
                h, count = shingle_sets(*K.text_buffers(part.column("text")), p)
                a, b = set_hashes(h, count)
                columns = [part.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sketches(h, count), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, sketch binary")


def _signed(docs: DataFrame, p: Params) -> DataFrame:
    """(sig, doc) of every set, once for equal sets of a task."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in K.chunks(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                h, count = shingle_sets(*K.text_buffers(part.column("text")), p)
                a, b = set_hashes(h, count)
                new = np.zeros(len(ids), bool)
                for i, key in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    if count[i] and key not in seen:
                        seen.add(key)
                        new[i] = True
                sig, row = signatures(h[np.repeat(new, count)], count * new, p)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[row].astype(np.int64))], names=["sig", "doc"])

    return docs.where("doc_id is not null").mapInArrow(run, "sig long, doc long")


def _runs(signed: DataFrame) -> DataFrame:
    """(key, a, b), written. key 0: a link of a signature's member with its first member of the upper band. Other keys:
    member a, of the lower band if b is 1, of a signature with three members or more. Linear, streaming."""

    def run(batches):
        sig_, doc_ = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # of the last run, while it is short
        long_, hub_, high_ = None, 0, False  # its key, if it is long; its first member
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = len(sig_)
            sig = np.concatenate((sig_, batch.column("sig").to_numpy().view(np.uint64)))
            doc = np.concatenate((doc_, batch.column("doc").to_numpy()))
            key = sig >> np.uint64(1)
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(first, len(key)))
            hub, high = doc[first].copy(), (sig[first] & np.uint64(1)) == 0
            goes_on = long_ is not None and key[0] == long_
            if goes_on:
                hub[0], high[0] = hub_, high_
            many = size >= 3
            many[0] |= goes_on
            long_, hub_, high_ = (key[-1], hub[-1], high[-1]) if many[-1] else (None, 0, False)
            sig_, doc_ = (sig[:0], doc[:0]) if many[-1] else (sig[first[-1] :], doc[first[-1] :])
            hubs = np.repeat(hub, size)
            ok = np.repeat(high, size) & (hubs != doc)
            ok[:carried] &= carried < 2  # those were linked before
            pair = np.stack((np.minimum(hubs[ok], doc[ok]), np.maximum(hubs[ok], doc[ok])), 1)
            if len(pair):
                pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
                pair = pair[np.concatenate(([True], (pair[1:] != pair[:-1]).any(1)))]
            member = np.repeat(many & high, size)
            keys = np.concatenate((np.zeros(len(pair), np.int64), key[member].astype(np.int64)))
            a = np.concatenate((pair[:, 0], doc[member]))
            b = np.concatenate((pair[:, 1], (sig[member] & np.uint64(1)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(a), pa.array(b)], names=["key", "a", "b"])
        K.give_back()

    dealt = signed.repartition(slots(signed.sparkSession), F.shiftright("sig", 1)).sortWithinPartitions("sig", "doc")
    return written(dealt.mapInArrow(run, "key long, a long, b long"), "runs")


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, written."""
    ends = lambda x: x.select(F.col("a").alias("__e")).unionByName(x.select(F.col("b").alias("__e"))).distinct()
    some = only(sets, "doc_id", written(ends(pairs), "ends"), "__e")
    some = written(some.groupBy("doc_id", "h1", "h2").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("s")), "sketches")
    side = lambda x, end: x.select(F.col("doc_id").alias(end), F.col("n").alias(f"n{end}"), F.col("s").alias(f"s{end}"))
    both = pairs.join(side(some, "a"), "a").join(side(some, "b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def near(batches):
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            far = sketch_distances(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            ok = (p.den + p.num) * np.maximum(far, np.abs(na - nb)) <= (p.den - p.num) * (na + nb)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = written(both.mapInArrow(near, "a long, b long").distinct(), "near")
    texts = only(docs, "doc_id", written(ends(pairs), "ends"), "__e").select(F.col("doc_id").alias("__d"), F.col("text").alias("__t"))
    texts = written(texts.groupBy("__d", F.xxhash64("__t").alias("__h")).agg(F.first("__t").alias("__t")).select("__d", "__t"), "texts")
    both = pairs.join(texts.select(F.col("__d").alias("a"), F.col("__t").alias("ta")), "a").join(texts.select(F.col("__d").alias("b"), F.col("__t").alias("tb")), "b")

    def exact(batches):
        for batch in batches:
            for part in K.chunks(batch, "ta", K.CHUNK_BYTES // 2):
                for q in K.chunks(part, "tb", K.CHUNK_BYTES // 2):
                    one, two = (shingles(*K.text_buffers(q.column(t)), p) for t in ("ta", "tb"))
                    inter, ca, cb = common(one, two, p), one.count, two.count
                    ok = (p.den * inter >= p.num * (ca + cb - inter)) & (ca > 0) & (cb > 0)
                    yield q.select(["a", "b"]).filter(pa.array(ok))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long"), "linked")


def _mapped(pairs: DataFrame, to: DataFrame) -> DataFrame:
    """Pairs with both ends replaced by what (__n, __to) says; distinct, a < b."""
    for end in ("a", "b"):
        pairs = pairs.join(to, F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("__to", end)).select("a", "b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _rest(members: DataFrame, tested: DataFrame, comps: DataFrame, copies: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """The untested pairs across components of the signatures that the links so far leave divided, as sketches allow."""
    spark = members.sparkSession
    rows = members.select("key", F.col("b").alias("lower"), F.col("a").alias("doc"))
    rows = rows.join(copies, F.col("doc") == F.col("__n"), "left").select("key", "lower", F.coalesce("__to", "doc").alias("doc"))
    rows = rows.join(comps.select(F.col("node").alias("__n"), F.col("comp").alias("__c")), F.col("doc") == F.col("__n"), "left").select("key", "lower", "doc", F.coalesce("__c", "doc").alias("comp"))
    divided = rows.groupBy("key").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"), F.count(F.lit(1)).alias("__m")).where("__lo <> __hi")
    divided = written(divided.select(F.col("key").alias("__k"), F.ceil(F.col("__m") / BLOCK).cast("int").alias("__cuts")), "divided")
    rows = rows.join(divided, F.col("key") == F.col("__k")).select("key", "lower", "doc", "comp", "__cuts").distinct()
    ends = written(rows, "members")
    some = only(sets, "doc_id", written(ends.select(F.col("doc").alias("__e")).distinct(), "ends"), "__e")
    some = some.groupBy("doc_id", "h1", "h2").agg(F.first("n_shingles").alias("n"), F.first("sketch").alias("s"))
    rows = ends.join(some.select(F.col("doc_id").alias("__d"), "n", "s"), F.col("doc") == F.col("__d"))
    own = F.pmod(F.xxhash64("doc"), F.col("__cuts")).cast("int")
    rows = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("__cuts") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc", "comp", "lower", "block", "n", "s")

    def run(batches):
        held: list[pa.Table] = []
        now = None

        def close():
            t = pa.concat_tables(held).combine_chunks()
            held.clear()
            col = lambda c: t.column(c).to_numpy()
            if t.num_rows < 2 or now[1] != now[2] and len(set(col("block").tolist())) < 2:
                return None
            got = near_pairs(col("doc"), col("comp"), col("lower"), col("block"), col("n"), t.column("s").to_pylist(), p)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            cut = np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], 0)) + 1, [batch.num_rows]))
            table = pa.Table.from_batches([batch])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                name = tuple(int(x[a]) for x in at)
                if now is not None and name != now and (out := close()) is not None:
                    yield out
                elif name != now:
                    held.clear()
                now = name
                held.append(table.slice(a, b - a))
        if held and (out := close()) is not None:
            yield out
        K.give_back()

    dealt = rows.repartition(slots(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(run, "a long, b long").distinct()
    return written(pairs.join(tested.select(F.col("a").alias("__a"), F.col("b").alias("__b")), (F.col("a") == F.col("__a")) & (F.col("b") == F.col("__b")), "left_anti"), "rest")


def join(docs: DataFrame, p: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, copies, links): every row's set; (__n, __to) from a document to its class's smallest; links (a, b)
    between class representatives that connect all that any link connects."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    p = p if p.seed is not None else replace(p, seed=secrets.randbits(63))
    sets = written(_sets(docs, p), "sets")
    named = sets.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("__rep"), F.max("doc_id").alias("__last")).where("__rep <> __last")
    classes = written(classes.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("__rep").alias("__to")), "classes")
    copies = named.join(classes, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).where("doc_id <> __to").select(F.col("doc_id").alias("__n"), "__to")
    copies = written(copies.groupBy("__n").agg(F.min("__to").alias("__to")), "copies")
    runs = _runs(_signed(docs, p))
    pairs = written(_mapped(runs.where("key = 0").select("a", "b").distinct(), copies), "pairs")
    links = _linked(pairs, docs, sets, p)
    rest = _rest(runs.where("key <> 0"), pairs, components(links), copies, sets, p)
    if not rest.isEmpty():
        links = links.unionByName(_linked(rest, docs, sets, p))
    return sets, copies, links


def near_duplicates(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets, copies, links = join(docs, p)
    # A doc_id with several texts is one document: its classes are linked through it.
    comps = components(links.unionByName(copies.select(F.col("__to").alias("a"), F.col("__n").alias("b"))))
    comps = comps.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
    return sets.join(comps, F.col("doc_id") == F.col("__n"), "left").select("doc_id", "n_shingles", F.coalesce("__c", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One document of each component (the smallest doc_id), with all its columns; rows without doc_id stay."""
    # Written once: the components are wanted for the documents that go, and the ids for those that come twice.
    found = written(near_duplicates(docs, p).where("doc_id is not null"), "components")
    gone = written(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    kept = without(docs, "doc_id", gone, "__gone")
    twice = written(found.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__twice")).count().where("count > 1").select("__twice"), "twice")
    if twice.isEmpty():
        return kept
    return without(kept, "doc_id", twice, "__twice").unionByName(only(kept, "doc_id", twice, "__twice").dropDuplicates(["doc_id"]))
