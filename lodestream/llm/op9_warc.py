"""WARC in seekable Zstandard bundles: independent frames of records, a seek table at the end, an index by record.

A bundle is a file of Zstandard frames. Each holds whole records up to `FRAME` bytes, or one longer record. Behind them come two
skippable frames: the bundle's index, which maps a record identifier to its frame and place within the frame's content, and the
seek table of the Zstandard seekable format, with the sizes of all other frames. Reading one record decodes one frame, found
by the table at the file's end.

Files are written by Spark's text writer, a bundle each, whatever file system the shared folder is in: it writes a row's bytes as they
are, and then the line separator, here the number that ends a seek table. Its commit puts whole files in place, once for each task, so
that a file's path is the bundle's name. They are read as binary files; the index of all bundles is made from their index frames.

Of records with equal payloads of at least `least` bytes, that with the largest id is a response and holds
the payload; others revisit it. A null payload is empty. Rows with one id and equal payloads are alike: all
responses where the id is the largest, each with a record of its own; with unequal ones they are separate.
A null id is smaller than any, and a group of null ids only is all responses. An empty table makes no record. A payload is held
whole, in a frame of its own if it is long: up to the 2 GB that a row may have. Other columns of the table are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.common import documents, shared_folder

FRAME = 1 << 18
#: Bytes of records after which a bundle ends.
BUNDLE = 1 << 25
LEVEL = 3
#: Fixed values of the Zstandard formats: two skippable frames' magic numbers, and the number that ends a seek table.
SKIPPABLE = 0x184D2A5E
INDEX = 0x184D2A50
SEEKABLE = 0x8F92EAB1
#: An entry of a bundle's index: whether the record has an id, the id, frame, offset, size.
_ENTRY = struct.Struct("<?qIQQ")
ENTRIES = "page_id long, bundle string, frame_no int, offset long, size long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, size: int) -> bytes:
    """A WARC/1.1 record. A revisit has no payload; its headers tell the full payload's digest and size."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, with names in lower case, and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length doesn't match its header")
    return headers, rest[:size]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame for frames of (compressed, raw) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, size, raw offset, raw size) of each frame of a bundle, from its end."""
    count, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    at = raw = 0
    out = []
    for size, raw_size in struct.iter_unpack("<II", data[-9 - 8 * count : -9]):
        out.append((at, size, raw, raw_size))
        at, raw = at + size, raw + raw_size
    return out


def index_frame(entries: list[tuple[int | None, int, int, int]]) -> bytes:
    """The skippable frame of a bundle's index, from (record id, frame, offset, size)."""
    body = b"".join(_ENTRY.pack(page_id is not None, page_id or 0, *place) for page_id, *place in entries)
    return struct.pack("<II", INDEX, len(body)) + body


def write_bundles(frame_size: int = FRAME, bundle_size: int = BUNDLE):
    """Bundles of a partition's records, without the four bytes that end each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        buffer, done, entries, sizes, raw_total = bytearray(), [], [], [], 0

        def frame() -> None:
            nonlocal raw_total
            done.append(pack.compress(bytes(buffer)))
            sizes.append((len(done[-1]), len(buffer)))
            raw_total += len(buffer)
            buffer.clear()

        def bundle() -> pa.RecordBatch:
            nonlocal raw_total
            done.append(index_frame(entries))
            sizes.append((len(done[-1]), 0))
            content = b"".join([*done, seek_table(sizes)[:-4]])
            for x in (done, entries, sizes):
                x.clear()
            raw_total = 0
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to, size in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to", "payload_bytes")), strict=True):
                data = record(page_id, url, b"" if kind == "revisit" else (html or "").encode(), digest, kind, refers_to, size)
                if buffer and len(buffer) + len(data) > frame_size:
                    frame()
                    if raw_total >= bundle_size:
                        yield bundle()
                entries.append((page_id, len(done), len(buffer), len(data)))
                buffer += data
        if buffer:
            frame()
        if done:
            yield bundle()

    return run


def own_index(data: bytes) -> list[tuple[int | None, int, int, int]]:
    """(record id, frame, offset, size) of a bundle's records, from its index frame; decodes nothing. An empty file has none: it is of a table without rows."""
    if not data:
        return []
    at, size, _, _ = read_seek_table(data)[-1]
    magic, length = struct.unpack("<II", data[at : at + 8])
    if magic != INDEX or length + 8 != size:
        raise ValueError("no index where the seek table says")
    return [(i if has else None, *place) for has, i, *place in _ENTRY.iter_unpack(data[at + 8 : at + size])]


def read_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of bundles' index frames."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            found = own_index(content.as_buffer().to_pybytes())
            columns = ([e[0] for e in found], [path.as_py()] * len(found), *([e[k] for e in found] for k in (1, 2, 3)))
            types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in ENTRIES.split(", ")])


def read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of bundles (content, wanted: their entries, null: all) each record's id, type and what it refers to, with the payload's size and digest: of responses as found in the payload."""
    for batch in batches:
        for content, wanted in zip(batch.column("content"), batch.column("wanted").to_pylist(), strict=True):
            data, out = content.as_buffer().to_pybytes(), []
            places = [e[1:] for e in own_index(data)] if wanted is None else [(e["frame_no"], e["offset"], e["size"]) for e in wanted]
            for headers, payload in records(data, places) if places else ():
                name = headers["warc-record-id"][10:-1]
                page_id = int(name) if name else None
                if headers["warc-type"] == "response":
                    out.append((page_id, len(payload), base32_sha1(payload), "response", None))
                else:
                    out.append((page_id, int(headers["x-payload-length"]), headers["warc-payload-digest"][5:], "revisit", int(headers["warc-refers-to"][10:-1])))
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def records(data: bytes, places: list[tuple[int, int, int]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records at (frame, offset, size) of a bundle's file, by its seek table: only their frames are decoded, each once."""
    unpack, frames = zstandard.ZstdDecompressor(), read_seek_table(data)
    last, content = -1, b""
    for frame_no, offset, size in sorted(places):
        if frame_no != last:
            at, length, _, raw = frames[frame_no]
            last, content = frame_no, unpack.decompress(data[at : at + length], max_output_size=raw)
        yield parse(content[offset : offset + size])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, sha1, payload_bytes, record_type, refers_to), once for each id and payload. pages: page_id, sha1, payload_bytes.

    The largest id of each payload is aggregated before its shuffle; in the join back a payload with many copies can be split.
    """
    unique = pages.dropDuplicates(["page_id", "sha1", "payload_bytes"])
    largest = pages.groupBy("sha1").agg(F.max("page_id").alias("largest"))
    first = (F.col("payload_bytes") < least) | F.col("largest").isNull() | F.col("page_id").eqNullSafe(F.col("largest"))
    return unique.join(largest, "sha1").select(
        "page_id", "sha1", "payload_bytes",
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("largest")).alias("refers_to"),
    )


def archive(pages: DataFrame, folder: str, least: int = 0, frame_size: int = FRAME, bundle_size: int = BUNDLE) -> None:
    """Writes pages (page_id, url, html) as bundles to a new folder."""
    body = F.coalesce("html", F.lit(""))
    known = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("sha1"), F.octet_length(body).cast("bigint").alias("payload_bytes"))
    role = roles(known.select("page_id", "sha1", "payload_bytes"), least).withColumnsRenamed({"page_id": "of_page", "sha1": "of_sha1"}).drop("payload_bytes")
    placed = known.join(role, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha1") == F.col("of_sha1"))).select(
        "page_id", "url",
        F.when(F.col("record_type") == "response", F.col("html")).alias("html"),
        base32(F.col("sha1")).alias("digest"), "record_type", "refers_to", "payload_bytes",
    )
    bundles = placed.mapInArrow(write_bundles(frame_size, bundle_size), "content binary").select(F.col("content").cast("string"))
    # In ISO 8859-1 a character is a byte.
    end = struct.pack("<I", SEEKABLE).decode("latin-1")
    bundles.write.option("maxRecordsPerFile", 1).option("lineSep", end).option("encoding", "ISO-8859-1").option("compression", "none").text(folder)


def bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's bundles."""
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def index(files: DataFrame) -> DataFrame:
    """(page_id, bundle, frame_no, offset, size) of each record of bundles."""
    return files.mapInArrow(read_index, ENTRIES)


def fetch(files: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """The records of some entries of the index, whose bundles meet them in a join; without entries all, by each bundle's own index: what read_records returns."""
    places = "array<struct<frame_no: int, offset: bigint, size: bigint>>"
    if entries is None:
        found = files.select("content", F.lit(None).cast(places).alias("wanted"))
    else:
        wanted = entries.groupBy("bundle").agg(F.collect_list(F.struct("frame_no", "offset", "size")).alias("wanted"))
        found = files.join(wanted, F.col("path") == F.col("bundle")).select("content", "wanted")
    return found.mapInArrow(read_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def base32(hexadecimal):
    """Base32 of 160 bits given as hexadecimal: each five digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    group = lambda i: F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda v, shift: F.substring(F.lit(letters), F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1))
    return F.concat(*(letter(group(i), shift) for i in range(8) for shift in (15, 10, 5, 0)))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    archive(documents(spark, sf_dir, "pages"), folder)
    return fetch(bundles(spark, folder))


SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
n AS (SELECT digest, max(page_id) AS largest FROM d GROUP BY digest),
g AS (SELECT d.*, largest, [CAST('0x' || substr(d.digest, 5 * i + 1, 5) AS INTEGER) for i in range(8)] AS groups FROM d JOIN n USING (digest))
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (groups[j // 4 + 1] >> (15 - 5 * (j % 4))) % 32 + 1, 1) for j in range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = largest OR largest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest OR (page_id IS NULL AND largest IS NOT NULL) THEN largest END AS refers_to
FROM g"""
