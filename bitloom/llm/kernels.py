"""Vectorised text kernels: one Arrow chunk of texts at a time, no per-row Python.

A chunk is its concatenated UTF-8 bytes (``buf``) with int64 offsets (``off``, one more than rows).
Words are ``[^\\x20\\x09-\\x0D]+``; null text counts as empty. Whole texts are always used: a chunk
holds about ``CHUNK_BYTES`` of text, or one longer text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_MUL32 = np.uint32(0x9E3779B1)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of 8


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buf, off) of a string array; null is empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    off = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text stands alone."""
    _, off = text_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, min(to, n) - at)
        at = to
    give_back()


def give_back() -> None:
    """Freed memory back to the system (where the C library can): worker processes live on after their task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.frombuffer(buf.tobytes().translate(_LOWER), np.uint8)


def blank(buf: np.ndarray) -> np.ndarray:
    """Where no word's byte stands: ``[\\x20\\x09-\\x0D]``."""
    return (buf == 32) | (buf - np.uint8(9) <= 4)


def spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; no word crosses rows."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~blank(buf)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[off] = True
    at = np.flatnonzero(edge)  # where a run begins
    word = inside[at[:-1]]
    starts = at[:-1][word]
    return starts, at[1:][word], rows_of(off, starts)


def rows_of(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row of each ascending position."""
    return np.repeat(np.arange(len(off) - 1), np.diff(np.searchsorted(at, off)))


class Segments:
    """Byte segments of a buffer: a 64-bit hash of each, and exact comparison.

    Every 8 bytes are mixed with their place and the seed, and the results are added up, so equal hashes of different
    segments are as rare as chance has them; whoever needs certainty compares bytes (``same``, ``distinct``)."""

    PIECE = 1 << 20

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0):
        self.buf, self.starts, self.size = buf, starts, ends - starts
        self._view = np.ndarray(len(buf) + 1, "<u8", buffer=np.concatenate((buf, np.zeros(8, np.uint8))), strides=(1,))
        self.head = self._view[starts] & _KEEP[np.minimum(self.size, 8)]
        self._seed = mix(np.array([seed], np.uint64) + _GOLD)

    def _blocks(self, which: np.ndarray):
        """The segments' 8-byte blocks after the first, in pieces: (place among which, place in the segment, block)."""
        count = (self.size[which] - 1) >> 3
        ends = np.cumsum(count)
        for a in range(0, int(ends[-1]) if len(ends) else 0, self.PIECE):
            b = min(a + self.PIECE, int(ends[-1]))
            some = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(ends, b - 1, "right") + 1)
            of = np.repeat(some, np.minimum(ends[some], b) - np.maximum((ends - count)[some], a))
            place = np.arange(a, b) - (ends - count)[of] + 1
            left = np.minimum(self.size[which[of]] - 8 * place, 8)
            yield of, place, self._view[self.starts[which[of]] + 8 * place] & _KEEP[left]

    def hash(self, other: int = 0) -> np.ndarray:
        """The segments' hashes; with ``other`` different ones, independent of these."""
        seed = self._seed ^ mix(np.array([other], np.uint64)) if other else self._seed
        out = mix(self.head ^ seed)
        long = np.flatnonzero(self.size > 8)
        for of, place, block in self._blocks(long):
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            out[long[of[first]]] += np.add.reduceat(mix(block ^ mix(place.astype(np.uint64) * _GOLD + seed)), first)
        return mix(out ^ (self.size.astype(np.uint64) * _BASE))

    def same(self, i: np.ndarray, other: Segments, j: np.ndarray) -> np.ndarray:
        """Whether segments i have the bytes of the other's segments j."""
        ok = (self.size[i] == other.size[j]) & (self.head[i] == other.head[j])
        long = np.flatnonzero(ok & (self.size[i] > 8))
        for (of, _, x), (_, _, y) in zip(self._blocks(i[long]), other._blocks(j[long]), strict=True):
            ok[long[of[x != y]]] = False
        return ok

    def bytes(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.starts[i] + self.size[i]].tobytes()

    def distinct(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One of each of the different segments, and which of those each is; by hash, with every byte compared."""
        where, which = unique(hashes)
        odd = np.flatnonzero(~self.same(np.arange(len(which)), self, where[which]))
        if len(odd):
            names: dict[bytes, int] = {}
            which[odd] = [names.setdefault(self.bytes(i), len(where) + len(names)) for i in odd.tolist()]
            first = {k: i for k, i in zip(which[odd].tolist()[::-1], odd.tolist()[::-1], strict=True)}
            where = np.concatenate((where, [first[len(where) + k] for k in range(len(names))]))
        return where, which


def ranked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, short of the lowest bits that their places take, and their places; ties in order."""
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    packed = np.sort((h >> bits << bits) | np.arange(len(h), dtype=np.uint64))
    return packed >> bits, (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the first of each different value (but for the lowest bits) stands, and which of them each is."""
    s, order = ranked(h)
    first = np.concatenate(([True], s[1:] != s[:-1]))[: len(s)]
    which = np.empty(len(s), np.int64)
    which[order] = np.cumsum(first) - 1
    return order[first], which


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte segment."""
    return Segments(buf, starts, ends, seed).hash() if len(starts) else np.zeros(0, np.uint64)


def windows(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first index of each run of ``n`` words within a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1 :])
    return window_hash(words, n)[at], at


def window_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, whatever their rows."""
    m = max(0, len(words) - n + 1)
    h = words[:m].copy()
    for j in range(1, n):
        h = mix(h * _BASE + words[j : j + m])
    return h


def codepoints(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points (uint32) and their offsets by row."""
    buf, off = clean(buf, off)
    heads = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    return np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32), heads[off]


def char_buckets(cp: np.ndarray, off: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed bucket of every run of ``n`` characters; a shorter text has none."""
    m = max(0, len(cp) - n + 1)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    ok = np.flatnonzero(row[:m] == row[n - 1 :][:m])
    return row[ok], char_hash(cp, n, bits)[ok]


def char_hash(cp: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashed bucket (uint32) of every run of ``n`` characters, whatever their rows."""
    m = max(0, len(cp) - n + 1)
    h = cp[:m] + np.uint32(n)
    for j in range(1, n):
        h = h * _MUL32 + cp[j : j + m]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0x297A2D39)
    return h >> np.uint32(32 - bits)


def range_sums(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of values[a:b] in double precision, each added up by itself; 0 where b <= a."""
    out = np.zeros(len(a))
    some = np.flatnonzero(b > a)
    if len(some):
        ends = np.stack((a[some], b[some]), 1).ravel()
        out[some] = np.add.reduceat(np.append(values, values.dtype.type(0)), ends, dtype=np.float64)[::2]
    return out


def row_sums(values: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Sums of each row's values, rows following one another without gaps."""
    out, some = np.zeros(len(bound) - 1), np.flatnonzero(np.diff(bound))
    if len(some):
        out[some] = np.add.reduceat(values, bound[some])
    return out


def counts(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How often mask holds, by row."""
    off = off.tolist()
    return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], np.int64)


def ties(key: np.ndarray, same) -> tuple[np.ndarray, np.ndarray]:
    """(places, group) of the items that occur twice or more, each group's in order. ``same(i, j)`` compares items whose
    64-bit keys are (all but) equal; keys only propose."""
    s, order = ranked(key)
    tie = np.flatnonzero(s[1:] == s[:-1])
    if not len(tie):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.unique(np.concatenate((tie, tie + 1)))
    s, at = s[at], order[at]
    group = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
    near = group[1:] == group[:-1]
    equal = near.copy()
    equal[near] = same(at[:-1][near], at[1:][near])
    for g in np.unique(group[1:][near & ~equal]).tolist():  # different items of one key: the first of each names it
        some = np.flatnonzero(group == g)
        rest, name = some, int(group.max())
        while len(rest):
            name += 1
            own = same(np.full(len(rest), at[rest[0]]), at[rest])
            group[rest[own]], rest = name, rest[~own]
    order = np.argsort(group, kind="stable")
    at, group = at[order], group[order]
    many = np.bincount(group)[group] > 1
    return at[many], group[many]


def later(key: np.ndarray, same) -> np.ndarray:
    """Of items in order, True where an equal one stands before (see ``ties``)."""
    at, group = ties(key, same)
    out = np.zeros(len(key), bool)
    out[at[1:][group[1:] == group[:-1]]] = True
    return out


def clean(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where all is UTF-8; else with U+FFFD for what isn't."""
    raw = buf.tobytes()
    try:
        raw.decode()
        return buf, off
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
