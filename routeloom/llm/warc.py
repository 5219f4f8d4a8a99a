"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; a skippable footer frame holds the seek table
(sizes of each frame, in Zstandard's seekable format), and an index maps each record's
identifier to its bundle, frame and offset within the frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import new_path, small_batches, table, written

#: A frame is closed once it holds so many bytes; a longer record has a frame of its own.
FRAME_BYTES = 1 << 18
LEVEL = 3
#: Payloads below this many bytes are never stored as a revisit.
MIN_REVISIT = 100
# Numbers of Zstandard's skippable frames and seekable format, fixed values.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that Arrow knows by its scheme: local, HDFS, S3, GCS."""
    return pafs.FileSystem.from_uri(uri if urlsplit(uri).scheme else "file://" + uri)


class BundleWriter:
    """Writes records to frames; ``add`` returns the record's (frame, offset, length)."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES) -> None:
        self.sink, self.frame_bytes = sink, frame_bytes
        self.codec = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.held, self.size, self.frames = [], 0, []

    def add(self, record: bytes) -> tuple[int, int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self._close_frame()
        place = (len(self.frames), self.size, len(record))
        self.held.append(record)
        self.size += len(record)
        return place

    def _close_frame(self) -> None:
        data = self.codec.compress(b"".join(self.held))
        self.sink.write(data)
        self.frames.append((len(data), self.size))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.size:
            self._close_frame()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class BundleReader:
    """Reads single frames through the seek table, without those before them."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        source.seek(size - FOOTER_BYTES)
        n, flags, magic = struct.unpack("<IBI", source.read(FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC or flags & 0x7C:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        source.seek(size - FOOTER_BYTES - entry * n)
        raw = source.read(entry * n)
        self.starts, at = [], 0
        for k in range(n):
            packed, plain = struct.unpack_from("<II", raw, entry * k)
            self.starts.append((at, packed, plain))
            at += packed
        self.codec = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.starts[k]
        self.source.seek(at)
        return self.codec.decompress(self.source.read(packed), max_output_size=plain)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its digest and length are headers."""
    block = b"" if kind == "revisit" else payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + uri.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}", f"X-Payload-Length: {len(payload)}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    return headers, data[end + 4 : end + 4 + n], end + 8 + n


def _id(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def _page_id(urn: str | None) -> int | None:
    last = urn.strip("<>").rpartition(":")[2] if urn else "none"
    return None if last == "none" else int(last)


INDEX_SCHEMA = "bundle string, frame int, record_ids array<bigint>, offsets array<bigint>, lengths array<bigint>"


def _write(folder: str, frame_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        writer, sink, name, rows = None, None, None, {}
        for b in batches:
            for r in b.to_pylist():
                if writer is None:
                    # A name of its own: of a task that ran twice, the index names one bundle only.
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    store.create_dir(path, recursive=True)
                    sink = store.open_output_stream(f"{path}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                payload = r["payload"]
                refers = None if r["kind"] != "revisit" else _id(r["refers_to"])
                data = record(r["kind"], _id(r["page_id"]), r["url"], payload, r["digest"], refers)
                frame, offset, length = writer.add(data)
                rows.setdefault(frame, []).append((r["page_id"], offset, length))
        if writer is None:
            return
        writer.close()
        sink.close()
        items = list(rows.items())
        for at in range(0, len(items), 1000):
            part = items[at : at + 1000]
            columns = [pa.array([name] * len(part)), pa.array([f for f, _ in part], pa.int32())]
            columns += [pa.array([[x[k] for x in v] for _, v in part], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["bundle", "frame", "record_ids", "offsets", "lengths"])

    return run


READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, bundle string, frame int, frame_offset bigint"


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = file_system(folder)
        opened: tuple[str, BundleReader] | None = None
        for b in batches:
            for r in b.to_pylist():
                if opened is None or opened[0] != r["bundle"]:
                    if opened:
                        opened[1].source.close()
                    info = store.get_file_info(f"{path}/{r['bundle']}")
                    opened = (r["bundle"], BundleReader(store.open_input_file(info.path), info.size))
                data = opened[1].frame(r["frame"])
                out: list[list] = [[] for _ in range(9)]
                for record_id, offset, length in zip(r["record_ids"], r["offsets"], r["lengths"], strict=True):
                    headers, block, end = parse(data, offset)
                    if end != offset + length or _page_id(headers["warc-record-id"]) != record_id:
                        raise ValueError(f"index and bundle differ at {record_id}")
                    kind = headers["warc-type"]
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    size = int(headers["x-payload-length"]) if kind == "revisit" else len(block)
                    if kind != "revisit" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"payload of {record_id} is damaged")
                    refers = _page_id(headers.get("warc-refers-to")) if kind == "revisit" else None
                    for column, v in zip(out, (record_id, size, digest, kind, refers, r["bundle"], r["frame"], offset, block), strict=True):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle", "frame", "frame_offset", "payload"]
                n = 9 if with_payload else 8
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out[:n], kinds[:n], strict=True)], names=names[:n])

    return run


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, kind and refers_to.

    Only digests and ids are grouped; of a group of equal payloads the aggregate keeps the
    smallest id. Records too small to be revisits join on a key of their own, so that they
    do not meet in one partition, and a large group is one key of one join, which the
    adaptive planner splits.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256))
    own = F.concat_ws(":", F.lit("own"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), "url")
    p = p.withColumn("group", F.when(F.octet_length("payload") >= min_bytes, F.col("digest")).otherwise(own))
    first = written(p.where(F.octet_length("payload") >= min_bytes).groupBy("group").agg(F.min("page_id").alias("first")), "warc-first")
    joined = p.join(first, "group", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("kind"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as bundles to ``folder``; returns the index.

    One row per frame: bundle, frame, and the ids, offsets and lengths of its records. The
    index is a written table: it names the bundles of the tasks that counted, and a bundle
    that a lost task left is in none of its rows.
    """
    small_batches(pages.sparkSession)
    return written(with_revisits(pages).mapInArrow(_write(folder, frame_bytes), INDEX_SCHEMA), "warc-index")


def read_bundles(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the index, read from its frame and offset and checked."""
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.repartitionByRange(n, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(_read(folder, with_payload), READ_SCHEMA + (", payload binary" if with_payload else ""))


def lookup(index: DataFrame, folder: str, page_ids: list[int]) -> DataFrame:
    """The records of some ids, reading only the frames that hold them."""
    wanted = index.where(F.arrays_overlap("record_ids", F.array(*[F.lit(i).cast("bigint") for i in page_ids])))
    return read_bundles(wanted, folder, True).where(F.col("page_id").isin(page_ids))


def archive(pages: DataFrame) -> DataFrame:
    """Writes pages to bundles in the shared folder and reads them back.

    Uses page_id, url and html; other columns are ignored. Null html counts as empty; a null
    url leaves out its header. Of records with equal payloads of at least 100 bytes the one
    with the smallest page_id is response; where rows repeat that id, each of them is. Rows
    with a null page_id revisit the smallest id, or are responses if their group has none.
    An empty table gives no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder), folder)


def op4_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``pages`` through WARC bundles and back."""
    return archive(table(spark, sf_dir, "pages"))
