import hashlib
import io

import pyspark.sql.functions as F
import zstandard

from routeloom.llm import warc
from routeloom.llm.common import new_path


def brute(rows):
    first = {}
    for i, html in rows:
        p = (html or "").encode()
        if len(p) >= 100 and i is not None:
            first[p] = min(i, first.get(p, i))
    out = []
    for i, html in rows:
        p = (html or "").encode()
        again = p in first and first[p] != i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=str)


COLS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect()]
    got = warc.op4_warc_seekable(spark, sf_dir).select(COLS).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_edges_and_lookup(spark):
    long = "ü" * 300_000
    rows = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 99), (9, "y" * 100), (5, "y" * 100), (5, "y" * 100), (None, "y" * 100), (None, "z" * 200), (7, long), (8, long), (10, "a\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, html string").withColumns({"url": F.when(F.col("page_id") != 3, F.lit("http://a/\r\nb%")), "digest": F.lit(1), "group": F.lit(2), "payload": F.lit(3)})
    folder = new_path(spark, "warc-test")
    index = warc.write_bundles(pages, folder, frame_bytes=4000)
    got = warc.read_bundles(index, folder, True).collect()
    assert sorted((tuple(r[c] for c in COLS) for r in got), key=str) == brute(rows)
    by = {r.page_id: bytes(r.payload).decode() for r in got if r.record_type == "response"}
    assert by[7] == long and by[10] == rows[-1][1] and by[1] == ""
    one = warc.lookup(index, folder, [10, 7]).collect()
    assert sorted(r.page_id for r in one) == [7, 10]
    assert warc.archive(pages.limit(0)).collect() == []


def test_bundle_is_plain_zstandard():
    out = io.BytesIO()
    w = warc.BundleWriter(out, 50)
    records = [bytes([65 + i]) * (7 * i + 1) for i in range(12)]
    places = [w.add(r) for r in records]
    w.close()
    data = out.getvalue()
    reader = warc.BundleReader(io.BytesIO(data), len(data))
    for r, (frame, offset, n) in zip(records, places, strict=True):
        assert reader.frame(frame)[offset : offset + n] == r
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(records)
