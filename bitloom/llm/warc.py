"""Dictionary-compressed WARC archives (.warc.zst): write, read back, and identical-payload revisits.

Every archive starts with a skippable frame (magic 0x184D2A5D) that holds the Zstandard dictionary, itself a
Zstandard frame; then each record is a frame of its own. The dictionary is trained on a bounded sample of the records
(``Params.sample_rows`` and ``sample_bytes``, by hash of the id), the same for all archives of a run; where there is too
little to train on, the sample itself is the dictionary. A record's payload is the page's html in UTF-8 (null: empty).
Of the records with equal payloads of at least ``min_revisit`` bytes, the one with the smallest page_id is a response,
the others revisit it (``WARC-Refers-To``); a revisit's block is the HTTP head, whose Content-Length is the payload's.

Payload digests are grouped map-side first; only digests that occur twice go to a table (written), which is joined on
the digest (Spark broadcasts it if small; else a sort-merge join whose hot keys adaptive execution splits). Archives
roll over at ``archive_bytes``; a task's files have names of their own and only those in the manifest count.

Defined results: rows that share a page_id and payload with the response are responses too, so is each row of a
digest group without any page_id; a row without page_id in a group with one revisits it; a null url is written as
``about:blank`` and line breaks in a url are percent-encoded; an empty table gives no archives and no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.files import Writer, open_input
from bitloom.llm.shared import shared_path, slots, written

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Params:
    min_revisit: int = 0
    archive_bytes: int = 48 << 20
    sample_rows: int = 1500
    sample_bytes: int = 6 << 20
    dictionary_bytes: int = 64 << 10
    level: int = 3
    date: str = "2000-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers: int | None, p: Params) -> bytes:
    """One WARC/1.1 record; refers: the response's page_id, for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers is None else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    name = lambda i: f"<urn:x-page:{'none' if i is None else i}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {p.date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers)}"] if refers is not None else []),
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], p: Params) -> bytes:
    """A trained dictionary, or the samples' last bytes as plain content where training can't work."""
    if sum(map(len, samples)) >= 8 * 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(p.dictionary_bytes, sum(map(len, samples)) // 8), samples, level=p.level).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-p.dictionary_bytes :] or record(None, None, b"", digest(b""), None, p)


def _loaded(raw: bytes) -> zstandard.ZstdCompressionDict:
    trained = raw[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(raw: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=12).compress(raw)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed


def records(f, step: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, frame by frame, in bounded memory."""
    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = f.read(size)
    raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == b"\x28\xb5\x2f\xfd" else raw
    unpack = zstandard.ZstdDecompressor(dict_data=_loaded(raw))
    frame, out, data = unpack.decompressobj(), [], f.read(step)
    while data:
        out.append(frame.decompress(data))
        if frame.eof:
            data = frame.unused_data or f.read(step)
            yield b"".join(out)
            frame, out = unpack.decompressobj(), []
        else:
            data = f.read(step)
    if any(out):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of a record; field names in lower case."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = lambda rows: {k.strip().lower(): v.strip() for k, _, v in (r.partition(":") for r in rows)}
    warc = fields(lines[1:])
    block = rest[: int(warc["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http.decode("utf-8", "replace").split("\r\n")[1:]), payload


def _dictionary_of(pages: DataFrame, p: Params) -> bytes:
    spark = pages.sparkSession
    ids = pages.where("page_id is not null").select("page_id", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"))
    ids = ids.orderBy(F.xxhash64("page_id"), "page_id").limit(p.sample_rows).collect()  # bounded
    total, take = 0, set()
    for r in ids:
        if total + r["n"] <= p.sample_bytes:
            total += r["n"]
            take.add(r["page_id"])
    picked = spark.createDataFrame([(i,) for i in sorted(take)], "page_id long")
    rows = pages.join(F.broadcast(picked), "page_id", "left_semi").dropDuplicates(["page_id"]).collect()
    samples = []
    for r in sorted(rows, key=lambda r: r["page_id"]):
        body = (r["html"] or "").encode()
        samples.append(record(r["page_id"], r["url"], body, digest(body), None, p))
    return dictionary(samples, p)


def write(pages: DataFrame, p: Params = Params(), folder: str | None = None) -> DataFrame:
    """Writes the archives; the manifest: uri, n_records, n_bytes."""
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = spark.sparkContext.broadcast(_dictionary_of(pages, p))  # dictionary_bytes at most
    rows = pages.withColumn("__body", F.coalesce(F.col("html"), F.lit(""))).withColumn("__sha1", F.unhex(F.sha1(F.col("__body").cast("binary")))).withColumn("__n", F.octet_length("__body"))
    groups = rows.where(F.col("__n") >= p.min_revisit).groupBy("__sha1").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__rows")).where("__rows > 1 and __first is not null")
    groups = written(groups.select(F.col("__sha1").alias("__of"), "__first"), "warc-groups")
    linked = rows.join(groups, (F.col("__sha1") == F.col("__of")) & (F.col("__n") >= p.min_revisit), "left")
    linked = linked.select("page_id", "url", F.col("__body").alias("html"), F.when(~F.col("page_id").eqNullSafe(F.col("__first")), F.col("__first")).alias("refers"))

    def run(batches):
        pack = zstandard.ZstdCompressor(level=p.level, dict_data=_loaded(shared.value), write_content_size=True, write_checksum=True)
        out, count, raw = None, 0, 0
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    out, count, raw = Writer(folder, "pages", ".warc.zst"), 0, 0
                    out.write(leading_frame(shared.value))
                body = html.encode()
                data = record(page_id, url, body, digest(body), refers, p)
                out.write(pack.compress(data))
                count, raw = count + 1, raw + len(data)
                if raw >= p.archive_bytes:
                    yield pa.RecordBatch.from_pydict({"uri": [out.close()], "n_records": [count], "n_bytes": [out.size]})
                    out = None
        if out is not None:
            yield pa.RecordBatch.from_pydict({"uri": [out.close()], "n_records": [count], "n_bytes": [out.size]})

    return written(linked.mapInArrow(run, "uri string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of every archived record.

    Lengths and digests of responses are found anew from their payloads; those of revisits are their fields."""
    spark = manifest.sparkSession

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", *["payload"] * payloads]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.binary()] * payloads]
        number = lambda s: None if s is None or s.rpartition(":")[2] == "none>" else int(s.rpartition(":")[2][:-1])
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                rows, held = [], 0
                with open_input(uri) as f:
                    for raw in records(f):
                        warc, http, payload = parse(raw)
                        kind = warc["warc-type"]
                        size, sha1 = (len(payload), digest(payload)) if kind == "response" else (int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"))
                        if f"sha1:{sha1}" != warc["warc-payload-digest"]:
                            raise ValueError(f"{uri}: a payload's digest is wrong")
                        rows.append((number(warc["warc-record-id"]), size, sha1, kind, number(warc.get("warc-refers-to")), warc["warc-target-uri"], *[payload] * payloads))
                        held += len(payload) * payloads
                        if len(rows) >= 4096 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    return manifest.select("uri").repartition(slots(spark), "uri").mapInArrow(run, schema)


def archive(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Writes the archives, then reads them back."""
    return read(write(pages, p))
