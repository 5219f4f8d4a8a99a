import hashlib
import zlib

import numpy as np
import pyspark.sql.functions as F
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import tiff


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_round_trip(compression, predictor, order, tile):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 7, (33, 21, 3), dtype=np.uint8), rng.integers(0, 60000, (5, 70, 1), dtype=np.uint16), np.zeros((300, 64, 1), np.uint8)]
    got = list(tiff.pages(tiff.write_tiff(images, compression, predictor, order, tile, 8)))
    assert [(p.width, p.height, p.samples, p.tiled) for p in got] == [(21, 33, 3, bool(tile)), (70, 5, 1, bool(tile)), (64, 300, 1, bool(tile))]
    for p, image in zip(got, images, strict=True):
        assert (p.pixels == image).all()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 60))
def test_codecs(data, times):
    data = data * times
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data


def test_lzw_example():
    # The example of the TIFF 6.0 specification, section 13.
    assert tiff.lzw_decode(bytes.fromhex("8001e040807fc0c08040"), 0) == b""
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    packed = int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_encode(data) == packed and tiff.lzw_decode(packed, 9) == data


def check(row, text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
    assert (row.n_bytes, row.payload_bytes, row.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
    assert row.tail_crc32 == zlib.crc32(payload[-64:])
    media = tiff.store(payload)
    assert (row.media_bytes, row.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert b"".join(p.pixels.tobytes() for p in tiff.pages(media)) == payload


def test_whole_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = tiff.op10_tiff(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        check(r, texts[r.doc_id])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 70000), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"feature": F.lit(1), "media": F.lit(2)})
    got = tiff.text_media(docs).collect()
    assert len(got) == 6
    for r in got:
        check(r, "a" if r.doc_id is None else dict(rows)[r.doc_id])
    assert tiff.text_media(docs.limit(0)).collect() == []


def test_pages_column(spark):
    good = tiff.write_tiff([np.ones((4, 64, 1), np.uint8), np.zeros((2, 8, 3), np.uint8)], tiff.LZW, 2, ">")
    loop = bytearray(tiff.write_tiff([np.ones((4, 4, 1), np.uint8)]))
    loop[-4:] = loop[4:8]
    rows = [("a", good), ("b", b"II*\0"), ("c", None), ("d", bytes(loop)), ("e", good[:-40]), ("f", b"")]
    got = tiff.tiff_pages(spark.createDataFrame(rows, "media_id string, blob binary"), "media_id", "blob").collect()
    by = {k: [(r.page, r.error) for r in got if r.media_id == k] for k, _ in rows}
    assert [p for p, _ in by["a"]] == [0, 1] and by["b"][0][1] and by["c"][0][1] and by["f"][0][1]
    assert by["d"][0] == (0, None) and "loop" in by["d"][1][1] and by["e"][-1][1]
    assert next(r for r in got if r.media_id == "a").pixels == bytes([1]) * 256


def test_runs_beyond_the_end_are_cut():
    assert tiff.unpack_bits(bytes([257 - 100, 7]), 40) == b"\7" * 40


@pytest.mark.parametrize(("tag", "value"), [(tiff.ROWS_PER_STRIP, 0), (tiff.WIDTH, 0), (tiff.HEIGHT, 0), (tiff.WIDTH, 1 << 30), (tiff.HEIGHT, 1 << 30), (tiff.SAMPLES, 60000)])
def test_damaged_sizes_are_rows_with_an_error(spark, tag, value):
    good = tiff.write_tiff([np.arange(64 * 8, dtype=np.uint8).reshape(8, 64, 1)])
    bad = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    for k in range(int.from_bytes(good[at : at + 2], "little")):
        entry = at + 2 + 12 * k
        if int.from_bytes(good[entry : entry + 2], "little") == tag:
            bad[entry + 8 : entry + 12] = value.to_bytes(4, "little")
    with pytest.raises(tiff.TiffError):
        list(tiff.pages(bytes(bad)))
    if tag == tiff.WIDTH:
        media = spark.createDataFrame([(1, bytearray(good)), (2, bad), (3, None)], "k int, m binary")
        assert sorted((r.media_id, r.page, r.error is None) for r in tiff.tiff_pages(media, "k", "m").collect() if r.media_id == 1) == [(1, 0, True)]
        assert all(r.error for r in tiff.tiff_pages(media, "k", "m").collect() if r.media_id != 1)


def test_damaged_tiles():
    good = tiff.write_tiff([np.zeros((64, 64, 1), np.uint8)], tiff.PACKBITS, tile=(16, 16))
    at = int.from_bytes(good[4:8], "little")
    for tag in (tiff.TILE_WIDTH, tiff.TILE_HEIGHT):
        for value in (0, 1 << 30):
            bad = bytearray(good)
            for k in range(int.from_bytes(good[at : at + 2], "little")):
                entry = at + 2 + 12 * k
                if int.from_bytes(good[entry : entry + 2], "little") == tag:
                    bad[entry + 8 : entry + 12] = value.to_bytes(4, "little")
            with pytest.raises(tiff.TiffError):
                list(tiff.pages(bytes(bad)))


def test_codings_follow_the_content():
    rng = np.random.default_rng(1)
    text = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    payload = text(64 * 1024) + b"a" * 64 * 1024 + text(64 * 100)
    stored = [(p.compression, p.tiled) for p in tiff.pages(tiff.store(payload))]
    assert stored == [(tiff.DEFLATE, True), (tiff.PACKBITS, False), (tiff.DEFLATE, False)]
    assert [(p.compression, p.tiled) for p in tiff.pages(tiff.store(text(128)))] == [(tiff.LZW, False)]


def test_page_rows(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    want = {}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        for k in range(0, len(payload), 64 * 1024):
            want[i, k // (64 * 1024)] = hashlib.sha256(payload[k : k + 64 * 1024]).hexdigest()
    got = tiff.tiff_page_rows(spark, sf_dir).collect()
    assert {(r.doc_id, r.page): r.pixels_sha256 for r in got} == want and all(r.error is None for r in got)
    assert {r.compression for r in got} >= {tiff.LZW, tiff.DEFLATE} and {r.tiled for r in got} == {True, False}
