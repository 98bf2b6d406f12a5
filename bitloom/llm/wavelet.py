"""Token ids in a wavelet matrix per shard: succinct bit-planes with access, rank, select and occurrence lookup.

A shard file holds the ids of consecutive documents (ascending doc_id). Ids are renumbered by frequency within the
shard, so a shard with few distinct ids has few planes and its upper planes are nearly all zeros. Plane ``l`` holds bit
``l`` (highest first) of each symbol after stable partitions by the bits above. Planes are cut into blocks of
``BLOCK_BITS`` bits, each a Zstandard frame of its own, with the count of ones before every block, so one access reads
one block a plane; a block that is read gets counts of ones before every ``SAMPLE`` bytes, so a rank adds up that many bytes at most and a
select searches the counts. The documents' ids and lengths follow. One compressed file answers ``access``, ``count``,
``rank``, ``select``, ``locate`` and full decoding.

``write`` deals documents out by doc_id range, sorts within partitions, encodes with the tokenizers library
(distinct pre-tokens of a chunk once each) and writes shards of about ``Params.shard_tokens`` ids to the shared
folder; its result is the manifest, a written table, and only files in it count. Starts come from totals by partition
(as many numbers as partitions) and a running sum within each.

Defined results: null or empty text is the end id alone; rows without a doc_id come first; rows of one doc_id come in
the order of their text's hash; a text so long that it exceeds a shard gets a shard of its own; an empty table gives
no shards and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.llm import bpe
from bitloom.llm import kernels as K
from bitloom.llm.files import Writer, open_input
from bitloom.llm.shared import shared_path, slots, written

MAGIC = b"BLWM0001"
BLOCK_BITS = 1 << 17
SAMPLE = 64
CHUNK_BYTES = 3 << 20
CACHE_ENTRIES = 1_200_000
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Params:
    path: str | None = None
    end_id: int = 2
    shard_tokens: int = 2_000_000


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, level: int = 1) -> bytes:
    """The bytes of a shard file. doc_ids: int64, the smallest int64 for none."""
    pack = zstandard.ZstdCompressor(level=level).compress
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    symbols = np.flatnonzero(counts)
    symbols = symbols[np.lexsort((symbols, -counts[symbols]))].astype(np.uint32)
    code = np.zeros(len(counts), np.uint32)
    code[symbols] = np.arange(len(symbols), dtype=np.uint32)
    now = code[ids] if len(ids) else np.zeros(0, np.uint32)
    now = now.astype(np.uint16) if len(symbols) <= 1 << 16 else now
    levels = max(1, int(len(symbols) - 1).bit_length()) if len(symbols) else 0
    body, at, planes = [], 0, []

    def put(data: bytes) -> list[int]:
        nonlocal at
        body.append(data)
        at += len(data)
        return [at - len(data), len(data)]

    for shift in range(levels - 1, -1, -1):
        bit = (now >> shift & 1).astype(bool)
        raw = np.packbits(bit)
        step = BLOCK_BITS // 8
        blocks = [raw[i : i + step] for i in range(0, len(raw), step)]
        ones = np.concatenate(([0], np.cumsum([int(_ONES[b].sum()) for b in blocks])))
        planes.append({"zeros": int(len(ids) - ones[-1]), "ones": ones[:-1].tolist(), "blocks": [put(pack(b.tobytes())) for b in blocks]})
        now = np.concatenate((now[~bit], now[bit]))
    head = {"n": len(ids), "docs": len(doc_ids), "levels": levels, "block_bits": BLOCK_BITS, "planes": planes}
    for name, x in (("symbols", symbols.astype("<u4")), ("doc_ids", np.asarray(doc_ids, "<i8")), ("lengths", np.asarray(lengths, "<u4"))):
        head[name] = put(pack(x.tobytes()))
    text = pack(json.dumps(head).encode())
    return MAGIC + struct.pack("<I", len(text)) + text + b"".join(body)


class Shard:
    """A shard file, read block by block from an open file (anything with seek and read)."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        if f.read(8) != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack("<I", f.read(4))
        self._unpack = zstandard.ZstdDecompressor().decompress
        self.head = json.loads(self._unpack(f.read(size)))
        self.base = 12 + size
        self.n, self.levels, self.block_bits = self.head["n"], self.head["levels"], self.head["block_bits"]
        self.symbols = self._array("symbols", "<u4")
        self.code = {int(s): i for i, s in enumerate(self.symbols)}
        self._blocks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _section(self, place: list[int]) -> bytes:
        self.f.seek(self.base + place[0])
        return self._unpack(self.f.read(place[1]))

    def _array(self, name: str, kind: str) -> np.ndarray:
        return np.frombuffer(self._section(self.head[name]), kind)

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        return self._array("doc_ids", "<i8"), self._array("lengths", "<u4")

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's bytes, and the ones before every SAMPLE of them."""
        if (level, k) not in self._blocks:
            if len(self._blocks) >= 256:
                self._blocks.clear()
            block = np.frombuffer(self._section(self.head["planes"][level]["blocks"][k]), np.uint8)
            whole = np.add.reduceat(_ONES[block], np.arange(0, len(block), SAMPLE), dtype=np.int64)
            self._blocks[level, k] = block, np.concatenate(([0], np.cumsum(whole)))
        return self._blocks[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, j = divmod(i, self.block_bits)
        return int(self._block(level, k)[0][j >> 3] >> (7 - (j & 7)) & 1)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        plane = self.head["planes"][level]
        k, j = divmod(i, self.block_bits)
        if k >= len(plane["blocks"]):
            return self.n - plane["zeros"]
        block, before = self._block(level, k)
        s = j // (8 * SAMPLE)
        whole = int(before[s]) + int(_ONES[block[s * SAMPLE : j >> 3]].sum())
        return plane["ones"][k] + whole + (int(_ONES[block[j >> 3] >> (8 - (j & 7))]) if j & 7 else 0)

    def _find(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0, rising) given bits of a plane; a block is read once, and of it the samples that hold some."""
        plane = self.head["planes"][level]
        before = np.array(plane["ones"], np.int64)
        if not bit:
            before = np.arange(len(before)) * self.block_bits - before
        where, out = np.searchsorted(before, nth, "right") - 1, np.empty(len(nth), np.int64)
        for k in np.unique(where).tolist():
            mine = np.flatnonzero(where == k)
            block, ones = self._block(level, k)
            marks = ones if bit else np.minimum(np.arange(len(ones)) * 8 * SAMPLE, self.block_bits) - ones
            rest = nth[mine] - before[k]
            sample = np.searchsorted(marks, rest, "right") - 1
            for s in np.unique(sample).tolist():
                some = mine[sample == s]
                bits = np.unpackbits(block[s * SAMPLE : (s + 1) * SAMPLE])
                out[some] = k * self.block_bits + s * 8 * SAMPLE + np.flatnonzero(bits == bit)[rest[sample == s] - marks[s]]
        return out

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for level, plane in enumerate(self.head["planes"]):
            bit = self._bit(level, i)
            ones = self._ones(level, i)
            i = plane["zeros"] + ones if bit else i - ones
            code = code << 1 | bit
        return int(self.symbols[code])

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i positions."""
        if token not in self.code:
            return 0
        code, a, b = self.code[token], 0, min(max(i, 0), self.n)
        for level, plane in enumerate(self.head["planes"]):
            one, two = self._ones(level, a), self._ones(level, b)
            a, b = (plane["zeros"] + one, plane["zeros"] + two) if code >> (self.levels - 1 - level) & 1 else (a - one, b - two)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, nth: int) -> int:
        """Position of the nth occurrence (from 0)."""
        if not 0 <= nth < self.count(token):
            raise IndexError(nth)
        return int(self._up(token, np.array([nth]))[0])

    def locate(self, token: int) -> list[int]:
        """All positions of the id, found together plane by plane."""
        n = self.count(token)
        return self._up(token, np.arange(n)).tolist() if n else []

    def _up(self, token: int, nth: np.ndarray) -> np.ndarray:
        """The positions of these occurrences (rising): down to where the id's symbols stand, and up again."""
        code, a = self.code[token], 0
        for level, plane in enumerate(self.head["planes"]):
            one = self._ones(level, a)
            a = plane["zeros"] + one if code >> (self.levels - 1 - level) & 1 else a - one
        at = a + nth
        for level in range(self.levels - 1, -1, -1):
            zeros = self.head["planes"][level]["zeros"]
            at = self._find(level, 1, at - zeros) if code >> (self.levels - 1 - level) & 1 else self._find(level, 0, at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions undone plane by plane, lowest first."""
        now = np.zeros(self.n, np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            plane = self.head["planes"][level]
            raw = np.concatenate([np.frombuffer(self._section(b), np.uint8) for b in plane["blocks"]])
            bit = np.unpackbits(raw, count=self.n).view(bool)
            out = np.empty_like(now)
            out[~bit] = now[: plane["zeros"]]
            out[bit] = now[plane["zeros"] :] | now.dtype.type(1 << (self.levels - 1 - level))
            now = out
        return self.symbols[now] if self.n else np.zeros(0, np.uint32)


_SPLITTERS: dict[int, bpe.Splitter] = {}
NO_ID = np.iinfo(np.int64).min


def library_splitter(text: str, classes: bytes) -> bpe.Splitter:
    """Pre-tokens encoded by the tokenizers library, single-threaded, once a worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    key = zlib.crc32(text.encode())
    if key not in _SPLITTERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}

        line = tokenizer.encode("\n", add_special_tokens=False).ids

        def encode(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pre-tokens that aren't white space go to the library as lines of one text: a line break before a
            pre-token, with or without its leading blank, is a pre-token and a token of its own. The others go singly."""
            sizes, parts = np.zeros(len(starts), np.int64), []
            lines = np.flatnonzero(~blank) if len(line) == 1 else np.zeros(0, np.int64)
            if len(lines):
                size = ends[lines] - starts[lines]
                to = np.cumsum(size + 1)
                text = np.full(int(to[-1]), 10, np.uint8)
                within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
                text[within + np.repeat(to - size - 1, size)] = buf[within + np.repeat(starts[lines], size)]
                ids = np.array(tokenizer.encode_batch_fast([text.tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
                breaks = np.flatnonzero(ids == line[0])
                if len(breaks) != len(lines):
                    raise ValueError("the tokenizer doesn't keep line breaks apart")
                sizes[lines] = np.diff(np.concatenate(([-1], breaks))) - 1
                parts.append(ids[ids != line[0]])
            rest = np.flatnonzero(sizes == 0)
            for i, e in zip(rest.tolist(), tokenizer.encode_batch_fast([buf[starts[i] : ends[i]].tobytes().decode() for i in rest], add_special_tokens=False), strict=True):
                sizes[i] = len(e.ids)
                parts.append(np.array(e.ids, np.uint32))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            order = np.concatenate((lines, rest))
            start = np.zeros(len(sizes), np.int64)
            start[order] = np.cumsum(sizes[order]) - sizes[order]
            return bpe.gather_lists(flat, start, sizes, np.arange(len(sizes)))

        _SPLITTERS[key] = bpe.Splitter(classes, added, encode, CACHE_ENTRIES)
    return _SPLITTERS[key]


def write(docs: DataFrame, p: Params = Params(), folder: str | None = None) -> DataFrame:
    """Writes the shards; the manifest: part, seq, uri, n_docs, n_tokens, n_bytes."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "wavelet")
    shared = bpe.shipped(spark, p.path)

    def run(batches):
        from pyspark import TaskContext

        split, part = library_splitter(*shared.value), TaskContext.get().partitionId()
        ids, names, sizes, seq, held = [], [], [], 0, 0

        def flush():
            nonlocal seq, held
            out = Writer(folder, f"shard-{part:05d}-{seq:05d}", ".blwm")
            lengths = np.concatenate(sizes)
            out.write(build(np.concatenate(ids), np.concatenate(names), lengths))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "uri": [out.close()], "n_docs": [len(lengths)], "n_tokens": [int(lengths.sum())], "n_bytes": [out.size]})
            seq, held = seq + 1, 0
            ids.clear(), names.clear(), sizes.clear()
            return row

        for batch in batches:
            for chunk in K.chunks(batch, "text", CHUNK_BYTES):
                x, at = split(*K.text_buffers(chunk.column("text")))
                ids.append(np.insert(x, at[1:], p.end_id).astype(np.uint32))
                names.append(chunk.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(at) + 1)
                held += len(ids[-1])
                if held >= p.shard_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("__h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(slots(spark), F.col("doc_id").asc_nulls_first(), "__h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "__h", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(run, "part long, seq long, uri string, n_docs long, n_tokens long, n_bytes long"), "wavelet-manifest")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of each document, from the files of a manifest."""
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()  # one row a partition
    total, base = 0, []
    for part, n in sorted(map(tuple, totals)):
        base.append((part, total))
        total += n
    starts = spark.createDataFrame(base, "part long, base long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with open_input(uri) as f:
                    shard = Shard(f)
                    ids = shard.decode().astype("<u4")
                    names, sizes = shard.documents()
                at = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, mask=names == NO_ID), pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([uri] * len(names))],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    return shards.select("uri", "start").repartition(slots(spark), "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_files(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """Writes the documents' shards, then reads them back."""
    return read(docs.sparkSession, write(docs, p))
