"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that are compressed independently; a bundle is a file of
frames with the seek table of the public seekable format in a skippable frame at its end.
An index maps each record's identifier to bundle, frame, offset inside the frame and
length, so one record costs one frame.  Payloads that occur more than once are stored once,
the other records revisit it.

Bundles are ordinary files in a shared folder, written and read by the tasks through
``pyarrow.fs``, which opens the folder's own file system.  A task names its files by a
random identifier and the index lists those of finished tasks only, so a task that is run
again leaves no wrong records.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import new_folder, settle

MIN_REVISIT_BYTES = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Bytes of records that a task reads back, about.
READ_BYTES = 32 << 20
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format and of the revisit profile.
_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_INDEX = "record_id string, page_id long, bundle string, frame int, offset int, length int"


def record_id(page_id: int | None, digest: str) -> str:
    """The same for the same page and payload, in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable frame that lists (compressed, decompressed) sizes of all frames."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIPPABLE, len(body)) + body


class Bundle:
    """A bundle opened for reading frames in any order."""

    def __init__(self, files: fs.FileSystem, path: str):
        self.file = files.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != _SEEKABLE or flags:
            raise ValueError(f"{path} has no seek table that can be read")
        table = struct.unpack(f"<{2 * count}I", self.file.read_at(8 * count, size - 9 - 8 * count))
        self.sizes = list(zip(table[::2], table[1::2]))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        data = self.file.read_at(packed, self.starts[number])
        return zstandard.ZstdDecompressor().decompress(data, max_output_size=plain)


class _Writer:
    """Collects records into frames and frames into bundles."""

    def __init__(self, files: fs.FileSystem, folder: str, frame_bytes: int, bundle_bytes: int):
        self.files, self.folder = files, folder
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.pack = zstandard.ZstdCompressor(level=3)
        self.index: list[tuple] = []
        self._new_bundle()

    def _new_bundle(self) -> None:
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.out, self.frames, self.written, self.frame = None, [], 0, bytearray()

    def add(self, page_id: int | None, digest: str, record: bytes) -> None:
        self.index.append((record_id(page_id, digest), page_id, self.name, len(self.frames), len(self.frame), len(record)))
        self.frame += record
        if len(self.frame) >= self.frame_bytes:
            self._end_frame()
            if self.written >= self.bundle_bytes:
                self.close()

    def _end_frame(self) -> None:
        data = self.pack.compress(bytes(self.frame))
        if self.out is None:
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        self.out.write(data)
        self.frames.append((len(data), len(self.frame)))
        self.written += len(data)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._end_frame()
        if self.out is not None:
            self.out.write(seek_table(self.frames))
            self.out.close()
        self._new_bundle()

    def taken(self) -> pa.RecordBatch:
        rows, self.index = self.index, []
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
        return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's own file system; Spark writes local URIs as file:/path, too."""
    return fs.FileSystem.from_uri(folder if "://" in folder else folder.removeprefix("file:"))


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is the largest page with the same payload, if another.

    Only digests and ids are grouped and joined; payloads are shuffled once, by page.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.where((F.octet_length("payload") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    largest = settle(large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"))
                     .where("least < refers_to").select("digest", "refers_to"), "largest")
    revisits = settle(large.join(largest, "digest").where("page_id < refers_to").distinct(), "revisits")
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = MIN_REVISIT_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write a record for every row and return the index, settled.

    Of equal payloads of at least ``least_bytes`` the row with the largest page id is the
    response, the others revisit it.

    * A null page is an empty payload, a null url is left out, a null id has no page number
      and neither revisits nor is revisited.
    * Rows of the largest id that are repeated are all responses.
    * An empty table writes no bundle; extra columns are ignored.
    """
    files, path = _open(folder)
    files.create_dir(path, recursive=True)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        writer = _Writer(files, path, frame_bytes, bundle_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (batch.column(c)[k].as_py() for c in range(5))
                writer.add(page_id, digest, _record(page_id, url, payload, digest, refers_to))
            yield writer.taken()
        writer.close()

    rows = with_revisits(pages, id_col, url_col, html_col, least_bytes)
    return settle(rows.sortWithinPartitions("page_id").mapInArrow(work, _INDEX), "warc-index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of the records that ``index`` lists.

    Rows of the index are sorted by bundle and frame, so every frame is read once; of a
    part of the index only its frames are.  A response's payload must have its digest.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        at, bundle, frame = (None, None), None, b""
        for batch in batches:
            rows = []
            for name, number, offset, length in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if (name, number) != at:
                    bundle = Bundle(files, f"{path}/{name}") if name != at[0] else bundle
                    at, frame = (name, number), bundle.frame(number)
                fields, payload = parse_record(frame[offset : offset + length])
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                size = int(fields["X-Payload-Length"])
                if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                    raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                number_of = lambda field: int(fields[field]) if field in fields else None
                rows.append((number_of("X-Page-ID"), size, digest, kind, number_of("X-Refers-To-Page-ID"), payload))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    schema = T.StructType([
        T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    ])
    # A number of its own: adaptive execution would join partitions by the few bytes of the
    # index, not by the records behind them.
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    rows = index.select("bundle", "frame", "offset", "length").repartition(max(1, -(-size // READ_BYTES)), "bundle")
    return rows.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(work, schema)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages to bundles in the shared folder and read every record back."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_records(write_bundles(pages, folder, id_col, url_col, html_col), folder)
