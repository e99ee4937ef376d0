"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; after the frames of a bundle comes a seek table
in a skippable frame, as the seekable Zstandard format has it (an entry of compressed and
decompressed size for each frame, then a footer with the number of frames). A second
skippable frame before it maps records to (frame, offset in the frame): in the order they
were written, and by their identifiers, which stand there sorted. A record is found by its
identifier and read by decompressing its own frame alone.

Bundles are rows (bundle, payload) of a Parquet table: Spark's commit makes a lost or
repeated task leave no half-written bundle, on any store. ``bundle_bytes`` bounds a bundle,
``frame_bytes`` a frame; a record larger than that is a frame, or bundle, of its own.

Nulls: a null payload is empty. A row without an identifier is written too and, having the
least identifier, is a response only if no row with one has its payload. Rows repeated with
the same identifier and payload have the same type.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlog.llm.common import binary, task_count
from matchlog.session import materialize

#: Fixed values of the seekable format: magic numbers of a skippable frame and of the footer.
SKIPPABLE, INDEX, FOOTER = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
LEAST_REVISIT, MOST_FETCHED = 1000, 100_000
#: The pages table tells no time of capture; callers that know one pass it.
DATE = "1970-01-01T00:00:00Z"


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Rows (page_id, url, payload, payload_digest, record_type, refers_to) to be archived.

    The owner of each digest is found on digests alone, with partial aggregation, and only
    digests that repeat are joined back. They go to each of the tasks over which the digest's
    rows are dealt, so a payload that a third of the rows share makes no hot task.
    """
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{body}`").cast("binary"), F.lit(b"").cast("binary")).alias("payload"),
    )
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    large = F.length("payload") >= least
    owners = (
        rows.filter(large)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "owner")
    )
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(task_count(pages))))
    asked = dealt.filter(large).select("payload_digest", "deal").distinct().join(owners, "payload_digest")
    joined = dealt.join(asked, ["payload_digest", "deal"], "left")
    revisit = large & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return joined.select(
        "page_id", "url", "payload", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("owner")).alias("refers_to"),
    )


def _header_value(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None, digest: str) -> uuid.UUID:
    """The identifier of a page's record; rows repeated under one page and payload share it."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}/{digest}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has no content block, but the digest and the length."""
    block = b"" if kind == "revisit" else payload
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{record_id(page_id, digest)}>"),
        ("WARC-Date", date),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
        ("WARC-Target-URI", _header_value(url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:uuid:{record_id(refers_to, digest)}>"),
            ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at an offset."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start, length = end + 4, int(headers["Content-Length"])
    if data[start + length : start + length + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} doesn't end where its length says")
    return headers, data[start : start + length], start + length + 4


class BundleWriter:
    """Gathers records into frames; ``close`` gives the bundle's bytes."""

    def __init__(self, frame_bytes: int, level: int):
        self.frame_bytes, self.compressor = frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.sizes: list[int] = []
        self.places: list[tuple[int, int]] = []
        self.ids: list[bytes] = []
        self.open: list[bytes] = []
        self.filled = self.size = 0

    def add(self, record: bytes, identifier: uuid.UUID) -> None:
        if self.filled and self.filled + len(record) > self.frame_bytes:
            self._end_frame()
        self.places.append((len(self.frames), self.filled))
        self.ids.append(identifier.bytes)
        self.open.append(record)
        self.filled += len(record)

    def _end_frame(self) -> None:
        frame = self.compressor.compress(b"".join(self.open))
        self.frames.append(frame)
        self.sizes.append(self.filled)
        self.size += len(frame)
        self.open, self.filled = [], 0

    def close(self) -> bytes:
        if self.filled:
            self._end_frame()
        ranks = sorted(range(len(self.ids)), key=self.ids.__getitem__)
        index = np.array(self.places, "<u4").tobytes() + np.array(ranks, "<u4").tobytes() + b"".join([self.ids[k] for k in ranks])
        table = b"".join(struct.pack("<II", len(f), n) for f, n in zip(self.frames, self.sizes, strict=True))
        foot = table + struct.pack("<IBI", len(self.frames), 0, FOOTER)
        return b"".join(self.frames) + struct.pack("<II", INDEX, len(index)) + index + struct.pack("<II", SKIPPABLE, len(foot)) + foot


class BundleReader:
    """Reads records of a bundle by identifier or number, a frame at a time."""

    def __init__(self, data: bytes):
        frames, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER or flags:
            raise ValueError("no seek table at the end")
        table = np.frombuffer(data[len(data) - 9 - 8 * frames : len(data) - 9], "<u4").reshape(frames, 2)
        start = len(data) - 9 - 8 * frames - 8
        if struct.unpack("<II", data[start : start + 8]) != (SKIPPABLE, 8 * frames + 9):
            raise ValueError("damaged seek table")
        self.data, self.sizes = data, table[:, 1]
        self.starts = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        magic, length = struct.unpack("<II", data[self.starts[-1] : self.starts[-1] + 8])
        if magic != INDEX:
            raise ValueError("no record index")
        at = int(self.starts[-1]) + 8
        n = length // 28  # two numbers for the place, one for the rank, 16 bytes of identifier
        index = data[at : at + length]
        self.places = np.frombuffer(index[: 8 * n], "<u4").reshape(-1, 2)
        self.ranks, self.ids = np.frombuffer(index[8 * n : 12 * n], "<u4"), index[12 * n :]
        self.decompressor = zstandard.ZstdDecompressor()
        self.held = (-1, b"")

    def __len__(self) -> int:
        return len(self.places)

    def find(self, identifier: uuid.UUID) -> int | None:
        """The number of the first record of that identifier, by binary search."""
        at = bisect.bisect_left(range(len(self)), identifier.bytes, key=lambda k: self.ids[16 * k : 16 * k + 16])
        return int(self.ranks[at]) if at < len(self) and self.ids[16 * at : 16 * at + 16] == identifier.bytes else None

    def read(self, number: int) -> tuple[dict[str, str], bytes]:
        frame, offset = map(int, self.places[number])
        if self.held[0] != frame:
            part = self.data[self.starts[frame] : self.starts[frame + 1]]
            self.held = frame, self.decompressor.decompress(part, max_output_size=int(self.sizes[frame]))
        headers, block, _ = parse_record(self.held[1], offset)
        return headers, block


def write_bundles(rows: DataFrame, bundle_bytes: int = 16 << 20, frame_bytes: int = 256 << 10, level: int = 3, date: str = DATE) -> DataFrame:
    """The rows of ``records`` as a stored table (bundle, n_records, payload)."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ended(writer: BundleWriter) -> pa.RecordBatch:
            data = writer.close()
            return pa.RecordBatch.from_arrays(
                [pa.array([hashlib.sha256(data).hexdigest()]), pa.array([len(writer.places)], pa.int64()), binary([data])],
                ["bundle", "n_records", "payload"],
            )

        writer = BundleWriter(frame_bytes, level)
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row in range(batch.num_rows):
                page_id, url, payload, digest, kind, refers_to = (c[row].as_py() for c in columns)
                writer.add(record_bytes(page_id, url, payload, digest, kind, refers_to, date), record_id(page_id, digest))
                if writer.size >= bundle_bytes:
                    yield ended(writer)
                    writer = BundleWriter(frame_bytes, level)
        if writer.places:
            yield ended(writer)

    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return materialize(rows.select(columns).mapInArrow(bundles, "bundle string, n_records long, payload binary"))


READ = "bundle string, record long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, block binary"


def read_bundles(bundles: DataFrame, blocks: bool = True) -> DataFrame:
    """Every record of the bundles, read through the index and the seek table.

    A response's block is checked against its digest; a mismatch fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda text: int(text) if text else None
        for batch in batches:
            for row in range(batch.num_rows):
                reader, out = BundleReader(batch.column(1)[row].as_py()), []
                name = batch.column(0)[row].as_py()
                for k in range(len(reader)):
                    headers, block = reader.read(k)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind = headers["WARC-Type"]
                    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
                        raise ValueError(f"record {k} of bundle {name} is damaged")
                    out.append((name, k, number(headers["X-Page-ID"]), int(headers["X-Payload-Length"]), digest, kind, number(headers.get("X-Refers-To-Page-ID")), headers["WARC-Target-URI"], block if blocks else None))
                    if len(out) == 500 or k + 1 == len(reader):
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []

    names = [c.split()[0] for c in READ.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in READ.split(", ")]
    return bundles.select("bundle", "payload").mapInArrow(read, READ)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload_digest, url, block) of the records (page_id, payload_digest) that
    ``wanted`` lists, each read through the index: of a bundle only the frames that hold one are
    decompressed. ``wanted`` goes to every bundle, so it is to be a list one task can hold."""
    asked = [(r.page_id, r.payload_digest) for r in wanted.limit(MOST_FETCHED + 1).collect()]
    if len(asked) > MOST_FETCHED:
        raise ValueError(f"more than {MOST_FETCHED} records; join read_bundles instead")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                reader, out = BundleReader(data.as_py()), []
                places = [(reader.find(record_id(*who)), *who) for who in asked]
                for number, page_id, digest in sorted((p for p in places if p[0] is not None), key=lambda p: p[0]):
                    headers, block = reader.read(number)
                    out.append((page_id, digest, headers["WARC-Target-URI"], block))
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "payload_digest", "url", "block"])

    return bundles.select("payload").mapInArrow(read, "page_id long, payload_digest string, url string, block binary")


def archive(pages: DataFrame, **names: str) -> DataFrame:
    """Writes the archives, reads them back and gives a row for each page."""
    read = read_bundles(write_bundles(records(pages, **names)), blocks=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
