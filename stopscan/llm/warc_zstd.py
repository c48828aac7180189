"""Web archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: a dictionary is trained on a bounded sample of payloads. Every task writes archives of its
own under a fresh name in the shared folder and returns their names, which are settled as the list
of what was written; what a lost or repeated task leaves behind is not in the list and is not read.
An archive is closed once it holds `ARCHIVE_BYTES`, so any archive fits a task.

Reading: a task opens an archive, loads the dictionary from the skippable frame, then decodes one
frame after another. Each record must be one whole frame with a version line, the headers its type
needs, a block of exactly Content-Length bytes and the closing blank lines, and a response's payload
must have the length and the digest that its headers tell; anything else is an error that names the
archive and the offset.

Of records with equal payloads of at least `LEAST` bytes, the one with the largest page_id is a
response. The others are revisits: they keep the HTTP headers, which tell the payload's length, and
point to the response.

Defined results: a null html is an empty payload; a null url leaves the target out; line breaks and
other control characters in a url are percent-encoded. Repeated rows of an id are written each, with
the same type. A null id loses to any id, and stays among null ids. An empty table writes no
archive. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopscan.llm.common import id_text, if_small, settle
from stopscan.session import scratch_path

LEAST = 1000
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 32 << 10
DICTIONARY_PAGES = 600
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
#: Fixed by the formats: the skippable frame of dictionaries, a trained dictionary, a frame.
SKIPPABLE, TRAINED, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
FEED = 32 << 10


def open_file(path: str, write: bool = False):
    """A stream in whatever store the shared folder is in."""

    system, inner = fs.FileSystem.from_uri(path)
    if write:
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        return system.open_output_stream(inner)
    return system.open_input_stream(inner)


def as_dictionary(told: bytes) -> zstandard.ZstdCompressionDict:
    """A dictionary as a frame carries it: trained, raw, or compressed itself."""

    if len(told) >= 4 and struct.unpack("<I", told[:4])[0] == FRAME:
        told = zstandard.ZstdDecompressor().decompress(told, max_output_size=1 << 27)
    return zstandard.ZstdCompressionDict(told)


def trained(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; plain header text where they are too few to train on."""

    samples = [s for s in samples if s]
    if len(samples) >= 16 and sum(map(len, samples)) > 8 * DICTIONARY_BYTES:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    return record("0", "http://", b"<!DOCTYPE html><html><head><body>", "0" * 40, None)


def record(page: str | None, url: str | None, payload: bytes, digest: str,
           refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP headers alone."""

    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {len(payload)}\r\n\r\n").encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{page_urn(page)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=SAFE)}")
    if refers_to is None:
        block += payload
    else:
        lines += [f"WARC-Refers-To: <{page_urn(refers_to)}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}",
              "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Printable ASCII stays as it is in a url.
SAFE = "".join(chr(c) for c in range(33, 127))


def page_urn(page: str | None) -> str:
    return "urn:page" if page is None else f"urn:page:{quote(page, safe='')}"


def urn_page(urn: str) -> str | None:
    head, _, page = urn.strip("<>").partition("urn:page")
    if head or (page and not page.startswith(":")):
        raise ValueError(f"unknown record id {urn}")
    return unquote(page[1:]) if page else None


class Writer:
    """An archive being written."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        self.path, self.records, self.bytes = path, 0, 8 + len(dictionary)
        self.file = open_file(path, write=True)
        self.file.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=as_dictionary(dictionary),
                                             write_checksum=True)

    def add(self, told: bytes) -> None:
        frame = self.pack.compress(told)
        self.file.write(frame)
        self.records += 1
        self.bytes += len(frame)

    def close(self) -> dict:
        self.file.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def frames(data: bytes, path: str) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of every record frame after the dictionary's."""

    if len(data) < 8:
        raise ValueError(f"{path}: no dictionary frame")
    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE or 8 + size > len(data):
        raise ValueError(f"{path}: no dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=as_dictionary(data[8:8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        start, parts, one = at, [], unpack.decompressobj()
        while not one.eof:
            if at >= len(data):
                raise ValueError(f"{path}@{start}: the last frame is cut short")
            piece = view[at:at + FEED]
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as error:
                raise ValueError(f"{path}@{start}: {error}") from error
            at += len(piece) - len(one.unused_data)
        yield start, b"".join(parts)


def parsed(told: bytes, where: str) -> dict:
    """The fields of one record, after its headers and lengths were checked."""

    head, found, rest = told.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"{where}: not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"{where}: bad header line {line!r}")
        fields[name.strip().lower()] = value.strip()
    kind = fields.get("warc-type")
    needed = ["warc-record-id", "warc-date", "content-length", "warc-payload-digest"]
    needed += ["warc-refers-to"] if kind == "revisit" else []
    if kind not in ("response", "revisit") or any(n not in fields for n in needed):
        raise ValueError(f"{where}: type {kind!r} or a header it needs is missing")
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError(f"{where}: the block is not of Content-Length {size}")
    http, _, payload = rest[:-4].partition(b"\r\n\r\n")
    told_size = [line.partition(b":")[2] for line in http.lower().split(b"\r\n")
                 if line.startswith(b"content-length:")]
    if not told_size:
        raise ValueError(f"{where}: no payload length")
    length, digest = int(told_size[0]), fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length
                               or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the payload is not what its headers tell")
    return {"page": urn_page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"),
            "payload": payload if kind == "response" else None, "payload_bytes": length,
            "payload_digest": digest, "record_type": kind,
            "refers": urn_page(fields["warc-refers-to"]) if kind == "revisit" else None}


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page; the settled list (path, records, bytes) of archives."""

    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"),
                        F.sha1(payload).alias("digest"))
    groups, _ = settle(rows.where(F.length("payload") >= LEAST).groupBy("digest").agg(
        F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1"),
        "payload-groups")
    total = max(1, pages.count())
    drawn = F.pmod(F.xxhash64(id_text("page_id"), F.lit("dictionary")), F.lit(1 << 30))
    sample = rows.where(drawn / float(1 << 30) < 2 * DICTIONARY_PAGES / total).select(
        "payload").limit(DICTIONARY_PAGES).toPandas()["payload"]
    dictionary = trained(sorted(map(bytes, sample)))
    typed = rows.join(if_small(groups.select(F.col("digest").alias("__digest"), "keep_id"),
                               groups.count(), 100),
                      F.col("digest") == F.col("__digest"), "left").select(
        F.col("page_id").cast("string").alias("page"), "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("keep_id")),
               F.col("keep_id").cast("string")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if archive is None:
                    archive = Writer(f"{folder}/{uuid.uuid4().hex}.warc.zst", dictionary)
                archive.add(record(*row))
                if archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
            if done:
                yield pa.RecordBatch.from_pylist(done, LIST)
        if archive is not None:
            yield pa.RecordBatch.from_pylist([archive.close()], LIST)

    return settle(typed.mapInArrow(run, "path string, records bigint, bytes bigint"),
                  "archives")[0]


LIST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
READ = pa.schema([("page", pa.string()), ("url", pa.string()), ("payload", pa.binary()),
                  ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers", pa.string()),
                  ("archive", pa.string()), ("offset", pa.int64())])


def read_archives(listed: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the listed archives: page, url, payload (null for revisits), its length and
    digest, type, the page referred to, archive and offset."""

    names = [n for n in READ.names if payloads or n != "payload"]
    schema = pa.schema([READ.field(n) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_file(path) as file:
                    data = file.read()
                rows, held = [], 0
                for offset, told in frames(data, path):
                    found = parsed(told, f"{path}@{offset}")
                    found |= {"archive": path.rpartition("/")[2], "offset": offset}
                    rows.append({n: found[n] for n in names})
                    held += len(told)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"payload": "binary", "payload_bytes": "bigint", "offset": "bigint"}
    number = max(1, listed.count())
    return listed.select("path").repartition(min(number, 10_000), "path").mapInArrow(
        run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, archive) read back."""

    kind = dict(pages.dtypes)["page_id"]
    back = read_archives(write_archives(pages), payloads=False)
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes",
                       "payload_digest", "record_type",
                       F.col("refers").cast(kind).alias("refers_to"), "archive")
