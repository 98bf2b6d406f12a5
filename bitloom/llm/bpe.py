"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Two neighbouring bytes that no vocabulary token contains in a row can never be merged, so a cut between them is
certain. Texts are split into pre-tokens (the library's ByteLevel rule, vectorised over an Arrow chunk, with the
library's own character classes), pre-tokens are cut at the forced boundaries, every fragment is encoded on its own
(lowest-rank merge first), and the ids are concatenated. Distinct pre-tokens of a chunk are encoded once and kept in a
bounded cache, so Python touches distinct strings only. Decoding joins the ids' bytes and reads them as UTF-8 with
replacement. One narrow pass, no shuffle; the vocabulary file (a fixed size) is what is broadcast.

Defined results: null or empty text has no ids and decodes to the empty text; added tokens in a text become their
id; bytes that are no UTF-8 are read as U+FFFD first; repeated rows and null ids are encoded row by row; extra columns
pass through ``encode`` untouched (output columns are ``ids`` and ``decoded``, replacing any of those names).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm import kernels as K
from bitloom.llm.shared import column, small_batches

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHE_ENTRIES, CACHE_BYTES = 800_000, 64
NEVER = np.int32(1 << 30)
CHUNK_BYTES = 1 << 20
SIDE_BY_SIDE = 1 << 17  # bytes of fragments that merge at once
VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(1)
def character_classes() -> bytes:
    """The class of every code point as the tokenizers library sees it (its Unicode tables differ from Python's).

    Asked of the library itself: between ``a`` and ``1`` a letter joins the first, a number the second, and what
    stands apart is white space if it also stays apart from ``!``."""
    from tokenizers.pre_tokenizers import ByteLevel

    rule = ByteLevel(add_prefix_space=False, use_regex=True)
    out = np.full(0x110000, OTHER, np.uint8)
    for a in range(0, 0x110000, 8192):
        points = [c for c in range(a, min(a + 8192, 0x110000)) if not 0xD800 <= c < 0xE000]
        if not points:
            continue
        found = rule.pre_tokenize_str("".join(f"!{chr(c)}1a" for c in points))  # 4 characters each
        starts = np.array([span[0] for _, span in found])
        begins = np.zeros(4 * len(points) + 1, bool)
        begins[starts] = True
        begins[-1] = True
        at = 4 * np.arange(len(points))
        own, number = begins[at + 1], begins[at + 2]
        out[points] = np.where(~own, OTHER, np.where(~number, NUMBER, SPACE))
    # What parted from both is a letter or white space: a letter joins the next letter.
    for a in range(0, 0x110000, 8192):
        points = [c for c in range(a, min(a + 8192, 0x110000)) if out[c] == SPACE]
        if not points:
            continue
        found = rule.pre_tokenize_str("".join(f"1{chr(c)}a" for c in points))
        begins = np.zeros(3 * len(points), bool)
        begins[[span[0] for _, span in found]] = True
        at = 3 * np.arange(len(points))
        out[points] = np.where(~begins[at + 2], LETTER, SPACE)
    out[0x20] = SPACE
    return out.tobytes()


def pretokens(buf: np.ndarray, off: np.ndarray, classes: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the pre-tokens, and whether each is white space; ``cuts`` are further byte positions where texts end and begin.

    Runs of letters, numbers or others, each with the one blank before it; white space otherwise, of which the last
    character before a run stands apart; and 's 't 're 've 'm 'll 'd where a lone apostrophe starts a token."""
    cp, _ = K.codepoints(buf, off)
    n = len(cp)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(bool)
    heads = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    kind = classes[cp]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(heads, off)] = True
    if cuts is not None and len(cuts):
        edge[np.searchsorted(heads, cuts)] = True
    edge[n] = True
    run = edge.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[0] = True
    begin = run.copy()
    after = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    begin[after - 1] = True
    begin[after[cp[after - 1] == 0x20]] = False
    lone = np.flatnonzero((cp == 0x27) & begin[:n])
    lone = lone[(lone + 1 < n)]
    lone = lone[run[lone + 1] & ~edge[lone + 1] & (kind[lone + 1] == LETTER) & run[lone]]
    if len(lone):
        one = np.isin(cp[lone + 1], [ord(c) for c in "stmd"])
        third = np.minimum(lone + 2, n - 1)
        pair = cp[lone + 1].astype(np.int64) << 21 | cp[third]
        two = ~one & (lone + 2 < n) & ~edge[np.minimum(lone + 2, n)] & np.isin(pair, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])
        begin[lone[one | two] + 1] = False
        begin[lone[one] + 2] = True
        begin[lone[two] + 3] = True
    at = np.flatnonzero(begin[:n])
    to = np.append(at[1:], n)
    return heads[at], heads[to], kind[to - 1] == SPACE


def gather_lists(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``flat[start:start+size]`` chosen by ``which``, one after another, and their sizes."""
    count = size[which]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start[which] - (ends - count), count)], count


class Splitter:
    """Pre-tokens of a chunk, encoded by ``encode``, distinct ones once, with a cache of bounded size in arrays. Hashes
    only propose: bytes are compared within the chunk and on every hit in the cache.

    ``encode(buf, starts, ends, blank)`` gives the ids of the byte segments, one after another, and their counts."""

    def __init__(self, classes: bytes, added: dict[str, int], encode, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.classes = np.frombuffer(classes, np.uint8)
        self.added = {k.encode(): v for k, v in added.items()}
        self.marks = re.compile(b"|".join(re.escape(k) for k in sorted(self.added, key=len, reverse=True))) if added else None
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        """Only the added tokens are known: where their bytes stand in a text, they are that token."""
        self.keys, self.raw, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.uint32)
        self.from_, self.to, self.start, self.size = (np.zeros(0, np.int32) for _ in range(4))  # few enough bytes for 32 bits
        if self.added:
            buf = np.frombuffer(b"".join(self.added), np.uint8)
            ends = np.cumsum([len(k) for k in self.added])
            starts = np.concatenate(([0], ends[:-1]))
            segments = K.Segments(buf, starts, ends)
            self._remember(segments, segments.hash(), np.arange(len(ends)), np.array(list(self.added.values()), np.uint32), np.ones(len(ends), np.int64))

    def _remember(self, segments: K.Segments, h: np.ndarray, which: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Segments ``which`` with their ids, one after another; of those of one hash only one is kept."""
        start = np.cumsum(size) - size
        order = np.argsort(h[which])
        key = h[which][order]
        at = np.searchsorted(self.keys, key)
        free = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
        free &= (at == len(self.keys)) | (np.append(self.keys, np.uint64(0))[at] != key)
        order, at = order[free], at[free]
        length = segments.size[which[order]]
        body, _ = gather_lists(segments.buf, segments.starts, segments.size, which[order])
        kept, _ = gather_lists(ids, start, size, order)
        opens = np.cumsum(length) - length + len(self.raw)
        begins = np.cumsum(size[order]) - size[order] + len(self.flat)
        self.keys = np.insert(self.keys, at, key[free])
        self.from_, self.to = np.insert(self.from_, at, opens), np.insert(self.to, at, opens + length)
        self.start, self.size = np.insert(self.start, at, begins), np.insert(self.size, at, size[order])
        self.raw, self.flat = np.concatenate((self.raw, body)), np.concatenate((self.flat, kept))

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's."""
        buf, off = K.clean(buf, off)
        raw = buf.tobytes()
        marks = []
        if self.marks and any(k in raw for k in self.added):
            for i in range(len(off) - 1):
                marks += [(m.start() + off[i], m.end() + off[i]) for m in self.marks.finditer(raw[off[i] : off[i + 1]])]
        starts, ends, blank = pretokens(buf, off, self.classes, np.array([x for m in marks for x in m], np.int64))
        if marks:  # pre-tokens inside an added token fall together into one
            first = np.searchsorted(starts, [m[0] for m in marks])
            last = np.searchsorted(starts, [m[1] for m in marks])
            alive = np.ones(len(starts), bool)
            for (_, to), a, b in zip(marks, first, last, strict=True):
                alive[a + 1 : b] = False
                ends[a] = to
            starts, ends, blank = starts[alive], ends[alive], blank[alive]
        segments = K.Segments(buf, starts, ends)
        h = segments.hash()
        where, which = segments.distinct(h)
        at = np.minimum(np.searchsorted(self.keys, h[where]), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[at] == h[where]) if len(self.keys) else np.zeros(0, np.int64)
        held = K.Segments(self.raw, self.from_[at[hit]], self.to[at[hit]])
        hit = hit[segments.same(where[hit], held, np.arange(len(hit)))]
        start, size = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        start[hit], size[hit] = self.start[at[hit]], self.size[at[hit]]
        known = np.zeros(len(where), bool)
        known[hit] = True
        flat, new = self.flat, np.flatnonzero(~known)
        if len(new):
            got = where[new]
            ids, size[new] = self.encode(buf, starts[got], ends[got], blank[got])
            start[new] = np.cumsum(size[new]) - size[new] + len(flat)
            flat = np.concatenate((flat, ids))
        out, count = gather_lists(flat, start, size, which)
        short = new[ends[where[new]] - starts[where[new]] <= CACHE_BYTES]
        if len(self.keys) + len(short) > self.entries:
            self._forget()
        elif len(short):
            kept, _ = gather_lists(flat, start, size, short)
            self._remember(segments, h, where[short], kept, size[short])
        running = np.concatenate(([0], np.cumsum(count)))
        return out, running[np.searchsorted(starts, off)]


class Codec:
    """Encoder and decoder built from a byte-level BPE tokenizer file (JSON text)."""

    def __init__(self, text: str, classes: bytes):
        spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer without a normalizer or added prefix is needed")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        as_bytes = {t: bytes(byte[c] for c in t) for t in vocab}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = as_bytes[t]
        for t, i in added.items():
            self.bytes[i] = t.encode()
        self.single = np.zeros(256, np.uint32)
        for t, i in vocab.items():
            if len(t) == 1:
                self.single[byte[t]] = i
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.within = np.zeros((256, 256), bool)
        for t in as_bytes.values():
            if len(t) > 1:
                x = np.frombuffer(t, np.uint8)
                self.within[x[:-1], x[1:]] = True
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        key = np.array(sorted(self.merges), np.uint64)
        self.pairs = key
        self.rank = np.array([self.merges[k][0] for k in key.tolist()] + [NEVER], np.int32)
        self.made = np.zeros(len(key), np.uint32)
        for rank, new in self.merges.values():
            self.made[rank] = new
        self.split = Splitter(classes, added, self.encode_pretokens)

    def encode_pretokens(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens: cut all at the forced boundaries, encode fragment by fragment, concatenate."""
        size = ends - starts
        flat, _ = gather_lists(buf, starts, size, np.arange(len(size)))
        opens = np.cumsum(size) - size
        edge = np.ones(len(flat), bool)
        edge[1:] = ~self.within[flat[:-1], flat[1:]]
        edge[opens[size > 0]] = True
        cuts = np.flatnonzero(edge)
        ids, counts = self.encode_fragments(flat, cuts, np.diff(np.append(cuts, len(flat))))
        running = np.concatenate(([0], np.cumsum(counts)))
        bounds = running[np.searchsorted(cuts, np.append(opens, len(flat)))]
        return ids, np.diff(bounds)

    def encode_fragments(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the fragments, one after another, and their counts. Fragments of one length merge side by side, one
        pair each a round, so all that still merge stay of one length."""
        done = []
        for n in np.unique(size).tolist():
            who = np.flatnonzero(size == n)
            if n > CACHE_BYTES:
                done += [(np.array([i]), np.array([self.merge(flat[start[i] : start[i] + n].tobytes())], np.uint32)) for i in who.tolist()]
                continue
            for at in range(0, len(who), max(1, SIDE_BY_SIDE // n)):
                some = who[at : at + max(1, SIDE_BY_SIDE // n)]
                ids = self.single[flat[start[some][:, None] + np.arange(n)]]
                rank = self.ranks(ids[:, :-1], ids[:, 1:])
                while len(some):
                    best = rank.argmin(1) if ids.shape[1] > 1 else np.zeros(len(some), np.int64)
                    row = np.arange(len(some))
                    on = rank[row, best] < NEVER if ids.shape[1] > 1 else np.zeros(len(some), bool)
                    if not on.all():
                        done.append((some[~on], ids[~on]))
                        some, ids, rank, best = some[on], ids[on], rank[on], best[on]
                        row = row[: len(some)]
                    if not len(some):
                        break
                    width = ids.shape[1]
                    new = self.made[rank[row, best]]
                    ids = ids[:, :-1].copy() if width == 2 else np.take_along_axis(ids, np.arange(width - 1) + (np.arange(width - 1) > best[:, None]), 1)
                    ids[row, best] = new
                    if width == 2:
                        done.append((some, ids))
                        break
                    rank = np.take_along_axis(rank, np.arange(width - 2) + (np.arange(width - 2) >= best[:, None]), 1)
                    left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
                    rank[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], new[left])
                    rank[right, best[right]] = self.ranks(new[right], ids[right, best[right] + 1])
        counts = np.zeros(len(start), np.int64)
        for who, ids in done:
            counts[who] = ids.shape[1]
        begins, out = np.cumsum(counts) - counts, np.zeros(int(counts.sum()), np.uint32)
        for who, ids in done:
            out[begins[who][:, None] + np.arange(ids.shape[1])] = ids
        return out, counts

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids; NEVER for pairs that don't merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b
        at = np.searchsorted(self.pairs, key)
        hit = self.pairs[np.minimum(at, len(self.pairs) - 1)] == key if len(self.pairs) else np.zeros(key.shape, bool)
        return self.rank[np.where(hit, at, len(self.pairs))]

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of one long fragment: always the lowest-rank pair first, the leftmost of equals."""
        ids = self.single[np.frombuffer(fragment, np.uint8)].tolist()
        merges = self.merges
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            m = merges.get(ids[i] << 32 | ids[i + 1])
            if m:
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n:
                    m = merges.get(ids[left] << 32 | ids[right])
                    if m:
                        heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [ids[i] for i in range(n) if alive[i]]

    def forget(self) -> None:
        """Empties the caches: worker processes live on after their task."""
        self.split._forget()
        K.give_back()

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of the ids in UTF-8; incomplete characters become U+FFFD."""
        out = gather_lists(self.flat, self.start, self.length, ids.astype(np.int64))[0].tobytes()
        return out.decode("utf-8", "replace").encode()


_CODECS: dict[str, Codec] = {}


def codec(text: str, classes: bytes) -> Codec:
    """One codec a worker process and vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(text, classes)
    return _CODECS[key]


def shipped(spark: SparkSession, path: str | None):
    """The vocabulary file's text and the character classes (about 3 MB whatever the corpus), broadcast."""
    small_batches(spark)
    with open(path or vocabulary_path()) as f:
        return spark.sparkContext.broadcast((f.read(), character_classes()))


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>) and ``decoded`` (the ids' text)."""
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

    shared = shipped(docs.sparkSession, path)
    docs = docs.drop("ids", "decoded") if text not in ("ids", "decoded") else docs

    def run(batches):
        c = codec(*shared.value)
        for batch in batches:
            view, done = pa.RecordBatch.from_arrays([column(batch, text).cast(pa.string())], names=["t"]), 0
            for part in K.chunks(view, "t", CHUNK_BYTES):
                ids, at = c.split(*K.text_buffers(part.column("t")))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
                back = pa.array([c.decode(ids[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
                body = batch.slice(done, part.num_rows)
                done += part.num_rows
                yield pa.RecordBatch.from_arrays([*body.columns, lists, back], names=[*batch.schema.names, "ids", "decoded"])
        c.forget()

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian uint32), decoded_sha256 (UTF-8), n_chars_decoded."""
    shared = shipped(docs.sparkSession, path)

    def run(batches):
        c = codec(*shared.value)
        for batch in batches:
            for part in K.chunks(batch, "text", CHUNK_BYTES):
                ids, at = c.split(*K.text_buffers(part.column("text")))
                ids = ids.astype("<u4")
                rows = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(at)), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in rows]), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in rows])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        c.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
