"""TIFF columns: directories, strips and tiles, PackBits, LZW and deflate, predictors."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, table

# Tag and code numbers of TIFF revision 6.0 and its technical notes, fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TYPE_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}

#: How a payload is stored: rows of 64 samples, pages of at most 1024 rows, strips of 256 rows or
#: square tiles. A long payload's last pages differ in coding and layout as their content does.
PAGE_WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 1024, 256
TILE = (64, 64)
#: A page of so many rows at most takes LZW, which needs no table in front; one where so large a
#: share of neighbours are equal takes PackBits; all others deflate with predictor 2, in tiles
#: from two tiles on.
LZW_ROWS, RUN_SHARE = 2, 0.5


CODING_NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", PACKBITS: "packbits", OLD_DEFLATE: "deflate"}


class TiffError(ValueError):
    pass


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: np.ndarray


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and len(out) < size:  # a run over the end is cut
        c = data[i]
        i += 1
        if c < 128:
            out += data[i : i + c + 1]
            i += c + 1
        elif c > 128:
            out += data[i : i + 1] * (257 - c)
            i += 1
    return bytes(out[:size])


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


CLEAR, END, FIRST = 256, 257, 258
#: LZW reaches 1.5 bits for 3838 bytes; deflate and PackBits stay below.
EXPANSION = 4096


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: most significant bit first, codes of 9 to 12 bits that widen one early."""
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    words, out, held, bits, width, last = list(base), bytearray(), 0, 0, 9, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == CLEAR:
            words, width, last = list(base), 9, b""
            continue
        if code == END:
            break
        if not last:
            word = words[code]
        else:
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise TiffError("LZW code out of range")
            words.append(last + word[:1])
        out += word
        last = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
        if len(out) >= size:
            break
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, width = bytearray(), 0, 0, 9

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    base = {bytes((i,)): i for i in range(256)}
    words, word = dict(base), b""
    put(CLEAR)
    for byte in data:
        longer = word + bytes((byte,))
        if longer in words:
            word = longer
            continue
        put(words[word])
        words[longer] = n = len(words) + 2
        if n == 4094:
            put(CLEAR)
            words, width = dict(base), 9
        elif n in (511, 1023, 2047):
            width += 1
        word = longer[-1:]
    if word:
        put(words[word])
        n = len(words) + 2  # the decoder has added one entry more by now
        width = 9 if n < 511 else 10 if n < 1023 else 11 if n < 2047 else 12
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data[:size]
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise TiffError(f"compression {compression}")


def _squeeze(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    return pack_bits(data) if compression == PACKBITS else lzw_encode(data) if compression == LZW else zlib.compress(data, 1)


def _entries(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise TiffError("directory beyond the end")
    (n,) = struct.unpack_from(order + "H", data, at)
    if at + 6 + 12 * n > len(data):
        raise TiffError("directory beyond the end")
    found = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 0) * count
        where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
        if kind in TYPE_CODE and where + size <= len(data):
            found[tag] = list(struct.unpack_from(f"{order}{count}{TYPE_CODE[kind]}", data, where))
    return found, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def pages(data: bytes) -> Iterator[Page]:
    """Every image of the directory chain, in either byte order, as 8- or 16-bit samples.

    Raises TiffError where the header, a directory or a segment is damaged, where the chain
    of directories loops, or for a feature that is not read.
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("directories loop")
        seen.add(at)
        tags, following = _entries(data, order, at)
        try:
            yield _page(data, order, tags, len(seen) - 1)
        except (KeyError, IndexError, ValueError, ArithmeticError, MemoryError, zlib.error, struct.error) as e:
            raise TiffError(f"page {len(seen) - 1}: {e}") from e
        at = following


def _page(data: bytes, order: str, tags: dict[int, list[int]], index: int) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, compression, predictor, planar = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if bits not in (8, 16) or predictor not in (1, 2) or len(set(tags.get(BITS, [bits]))) > 1:
        raise TiffError(f"bits {bits}, predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    w, h = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if min(width, height, samples, w, h) < 1:
        raise TiffError(f"sizes {width} x {height} x {samples}, parts of {w} x {h}")
    across, down = -(-width // w), -(-height // h)
    kind = np.dtype(f"{order}u{bits // 8}")
    # No coding makes more than EXPANSION bytes of one, so what a directory claims beyond that is damage.
    parts, held = planes * across * down, sum(max(0, min(c, len(data) - o)) for o, c in zip(offsets, counts, strict=False))
    if parts > min(len(offsets), len(counts)) or width * height * samples * kind.itemsize > EXPANSION * held:
        raise TiffError(f"{width} x {height} x {samples} samples from {held} bytes in {len(offsets)} parts")
    if tiled and w * h * deep * kind.itemsize > EXPANSION * held:
        raise TiffError(f"tiles of {w} x {h}")
    out = np.empty((height, width, samples), f"u{bits // 8}")
    for k in range(planes * across * down):
        plane, r = divmod(k, across * down)
        y, x = r // across * h, r % across * w
        rows = h if tiled else min(h, height - y)
        size = rows * w * deep * kind.itemsize
        raw = _expand(data[offsets[k] : offsets[k] + counts[k]], compression, size)
        if len(raw) < size:
            raise TiffError(f"segment {k} is short")
        part = np.frombuffer(raw, kind).reshape(rows, w, deep).astype(out.dtype)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=out.dtype)
        n, m = min(rows, height - y), min(w, width - x)
        if planar == 2:
            out[y : y + n, x : x + m, plane] = part[:n, :m, 0]
        else:
            out[y : y + n, x : x + m] = part[:n, :m]
    return Page(index, width, height, samples, bits, compression, predictor, tiled, out)


@dataclass
class Coding:
    """How a page is written: by strips of ``rows``, or by tiles of (width, height)."""

    compression: int = DEFLATE
    predictor: int = 1
    tile: tuple[int, int] | None = None
    rows: int = STRIP_ROWS


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, order: str = "<", tile: tuple[int, int] | None = None, rows: int = STRIP_ROWS, choose: Callable[[np.ndarray], Coding] | None = None) -> bytes:
    """A TIFF with one page per image of shape (height, width, samples), 8 or 16 bits; ``choose``
    gives each page's coding, or all have the one named."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        height, width, samples = image.shape
        coding = choose(image) if choose else Coding(compression, predictor, tile, rows)
        compression, predictor, tile, rows = coding.compression, coding.predictor, coding.tile, coding.rows
        w, h = tile or (width, rows)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = image[y : y + h, x : x + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                data = _squeeze(part.astype(part.dtype.newbyteorder(order)).tobytes(), compression)
                offsets.append(len(out))
                counts.append(len(data))
                out += data
        out += b"\0" * (len(out) % 2)
        bits = 8 * image.dtype.itemsize
        tags = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [bits] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [w]), (TILE_HEIGHT, 4, [h]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [h]), (STRIP_COUNTS, 4, counts)]
        entries = b""
        for tag, kind, values in sorted(tags):
            packed = struct.pack(f"{order}{len(values)}{TYPE_CODE[kind]}", *values)
            if len(packed) > 4:
                at = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


#: Bytes of pixels that leave in one batch of pages, about.
PAGE_BATCH = 4_000_000
PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.string()]
    for b in batches:
        at: list[int] = []
        rows: list[tuple] = []
        held = 0

        def taken() -> pa.RecordBatch:
            columns = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]  # noqa: B023
            return pa.RecordBatch.from_arrays([b.column("media_id").take(pa.array(at)), *columns], names=["media_id", *names])  # noqa: B023

        def found(data: bytes) -> Iterator[tuple]:
            try:
                for p in pages(data):
                    yield p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels.tobytes(), None
            except TiffError as e:
                yield *[None] * 9, str(e)

        for r, data in enumerate(b.column("media").to_pylist()):
            for row in found(data or b""):
                at.append(r), rows.append(row)
                held += len(row[8] or b"")
                if held > PAGE_BATCH:
                    yield taken()
                    at, rows, held = [], [], 0
        if rows:
            yield taken()


def tiff_pages(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """One row per page of each TIFF in ``column``: media_id and PAGE_SCHEMA.

    A damaged or empty file gives, after its readable pages, one row with ``error`` set; it
    never stops the job. Null counts as empty. Repeated files give repeated rows.
    """
    small_batches(media.sparkSession)
    kind = media.schema[id_column].dataType.simpleString()
    return media.select(F.col(id_column).alias("media_id"), F.col(column).alias("media")).mapInArrow(_page_rows, f"media_id {kind}, {PAGE_SCHEMA}")


def _coding(page: np.ndarray) -> Coding:
    """A page's coding by its content."""
    flat = page.reshape(-1)
    if len(page) <= LZW_ROWS:
        return Coding(LZW)
    if (flat[1:] == flat[:-1]).mean() >= RUN_SHARE:
        return Coding(PACKBITS)
    return Coding(DEFLATE, 2, TILE) if len(page) >= 2 * TILE[1] else Coding(DEFLATE, 2)


def store(payload: bytes) -> bytes:
    """A payload, a multiple of 64 bytes, as pages of 64 samples a row, each in the coding and layout
    that its content calls for."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH, 1)
    return write_tiff([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], choose=_coding)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in range(7)]
        for text in b.column("text").cast(pa.binary()).to_pylist():
            text = text or b""
            media = store(text + b"\0" * (-len(text) % 64 or (0 if text else 64)))
            whole, last, n, total, counts = hashlib.sha256(), b"", 0, 0, np.zeros(256, np.int64)
            k, codings = -1, []
            for k, p in enumerate(pages(media)):
                codings.append(f"{CODING_NAMES[p.compression]}{'-tiles' * p.tiled}")
                data = p.pixels.tobytes()
                whole.update(data)
                last = data[-64:]
                n += len(data)
                counts += np.bincount(p.pixels.reshape(-1), minlength=256)
            total = int(counts @ np.arange(256))
            share = counts[counts > 0] / n
            feature = f"pages={k + 1};codings={','.join(sorted(set(codings)))};mean={total / n:.4f};entropy={float(-(share * np.log2(share)).sum()):.4f};high={int(counts[128:].sum())}"
            for column, v in zip(out, (len(text), n, whole.hexdigest(), zlib.crc32(last), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(v, t) for v, t in zip(out, kinds, strict=True)]], names=["doc_id", *names])


def text_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a TIFF and read back page by page: sizes, digests and a feature.

    Uses doc_id and text; other columns are ignored. A null or empty text is a payload of
    64 zero bytes. Rows are independent, so nothing is shuffled; repeated rows repeat, and an empty
    table gives no rows. Very long texts are many pages, read back one at a time.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_digests, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` through TIFF and back."""
    return text_media(table(spark, sf_dir, "documents"))


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = [store((t or b"") + b"\0" * (-len(t or b"") % 64 or (0 if t else 64))) for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


def tiff_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page of the whole of ``documents`` as TIFF: its place, layout and pixels' digest."""
    docs = table(spark, sf_dir, "documents")
    small_batches(spark)
    media = docs.select("doc_id", "text").mapInArrow(_stored, "doc_id bigint, media binary")
    found = tiff_pages(media, "doc_id", "media")
    digest = F.sha2("pixels", 256).alias("pixels_sha256")
    return found.select(F.col("media_id").alias("doc_id"), "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", digest, "error")
