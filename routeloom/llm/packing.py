"""Best-fit-decreasing packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, table, text_key, written

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "byte_bpe_50k.json"
#: Pieces of one length are dealt over a bucket for so many of them when they are numbered.
BUCKET_PIECES = 4_000
#: Entries of the cache of encoded words, after which it starts anew.
CACHE = 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The tokenizer file's place on this machine, asked where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The byte-level vocabulary's letter for each byte: itself where it is printable, else
    the next free letter from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes, by the ``tokenizers`` library.

    Texts of ASCII and Latin-1 letters, where the byte-level pre-tokenizer's classes are
    beyond doubt, are cut into its words here, and each distinct word goes through the
    library's BPE model once. All other texts go to the library whole.
    """

    _plain = re.compile(r"[\x20-\x7e\nÀ-ÖØ-öø-ÿ]*")
    _words = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^ \nA-Za-zÀ-ÖØ-öø-ÿ0-9]+|[ \n]+(?![^ \n])|[ \n]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._letters = {b: c for b, c in enumerate(_byte_letters())}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        letters = word.encode().decode("latin-1").translate(self._letters)
        ids = np.array([t.id for t in self._model.tokenize(letters)], dtype="<u4").tobytes()
        if len(word) < 64:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if "<|" in text or not self._plain.fullmatch(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.__getitem__, self._words.findall(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece: full ones, but for the first."""
    n = max(1, -(-length // capacity))
    first = length - (n - 1) * capacity
    return [(0, first)] + [(first + k * capacity, capacity) for k in range(n - 1)]


def _cut(capacity: int, path: str | None, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or tokenizer_path()).encode
        end = np.array([SEPARATOR], "<u4").tobytes()
        for b in batches:
            rows, piece, start, length, crc, ids = [], [], [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                data = encode(text or "") + end
                for k, (s, n) in enumerate(pieces_of(len(data) // 4, capacity)):
                    part = data[4 * s : 4 * (s + n)]
                    rows.append(r), piece.append(k), start.append(s), length.append(n), crc.append(zlib.crc32(part)), ids.append(part)
            at = pa.array(rows, pa.int32())
            columns = [b.column("doc_id").take(at), b.column("th").take(at), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "th", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, th, piece, start, length, ids_crc32 and, if asked, ids."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, th bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text", text_key().alias("th")).mapInArrow(_cut(capacity, path, with_ids), schema)


class OpenBins:
    """Groups of like bins by remaining capacity, under a segment tree.

    The tree's leaves are the capacities 0 to ``capacity``; a node is set if a bin below it
    is open. The tightest bin that holds an item is found in logarithmic time.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.groups: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, remaining: int, value: int) -> None:
        k = self.size + remaining
        self.tree[k] = value
        while k > 1:
            k >>= 1
            value = self.tree[2 * k] | self.tree[2 * k + 1]
            if self.tree[k] == value:
                break
            self.tree[k] = value

    def push(self, remaining: int, group: tuple[int, int, int]) -> None:
        if not self.groups[remaining]:
            self._set(remaining, 1)
        self.groups[remaining].append(group)

    def pop(self, remaining: int) -> tuple[int, int, int]:
        group = self.groups[remaining].pop()
        if not self.groups[remaining]:
            self._set(remaining, 0)
        return group

    def tightest(self, need: int) -> int:
        """The smallest remaining capacity of at least ``need`` with an open bin, or -1."""
        k = self.size + need
        if self.tree[k]:
            return need
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.size:
                    k *= 2
                    if not self.tree[k]:
                        k += 1
                return k - self.size
            k >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on the number of pieces of each length.

    Returns runs (length, first rank, last rank + 1, first bin, pieces per bin, offset):
    a piece of that length and rank r goes to bin first + (r - first rank) // per and to
    offset + length * ((r - first rank) % per). Pieces of one length are alike, so bins
    with the same content are kept as one group and filled together, as piece by piece
    best fit would fill them: the tightest bin stays the tightest until the length no
    longer fits. A length splits at most one group and opens at most two, so groups, runs
    and time depend on the capacity, not on how many documents there are.
    """
    bins, runs, opened = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = total - rank
            remaining = bins.tightest(length)
            if remaining < 0:
                per = capacity // length
                n = left // per or 1
                group, remaining = (opened, n, 0), capacity
                opened += n
            else:
                group = bins.pop(remaining)
            first, n, offset = group
            per = remaining // length
            whole = min(n, left // per)
            if not whole:  # fewer pieces than one bin takes
                whole, per = 1, left
            if whole < n:
                bins.push(remaining, (first + whole, n - whole, offset))
            runs.append((length, rank, rank + whole * per, first, per, offset))
            rank += whole * per
            bins.push(remaining - per * length, (first, whole, offset + per * length))
    return runs


def _assign(runs: list[tuple[int, int, int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = np.array(runs, np.int64).reshape(-1, 6)
        table_ = table_[np.lexsort((table_[:, 1], table_[:, 0]))]
        lengths = np.unique(table_[:, 0])
        of = {int(n): table_[table_[:, 0] == n] for n in lengths}
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                here, t = length == n, of[int(n)]
                k = np.searchsorted(t[:, 1], rank[here], side="right") - 1
                at = rank[here] - t[k, 1]
                sequence[here] = t[k, 3] + at // t[k, 4]
                offset[here] = t[k, 5] + n * (at % t[k, 4])
            keep = [i for i, name in enumerate(b.schema.names) if name != "rank"]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)], names=[b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (of ``pieces``, without ids) with sequence_id and offset.

    Only the count of each length, at most ``capacity`` numbers, reaches the driver. Pieces
    are numbered within their length by two levels, length and bucket of the document, so
    that a length that a third of the pieces have is numbered by many tasks; a rare length has
    one bucket, and there are at most ``capacity`` buckets beside one for BUCKET_PIECES pieces.
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # One row a length: at most ``capacity`` rows, whatever the input.
    buckets = F.broadcast(cut.sparkSession.createDataFrame([(n, -(-k // BUCKET_PIECES)) for n, k in counts.items()], "length bigint, buckets bigint"))
    dealt = cut.join(buckets, "length").select(*cut.columns, F.pmod(F.xxhash64("doc_id", "th", "piece"), "buckets").alias("bucket"))
    per = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = written(per.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-base")
    own = Window.partitionBy("length", "bucket").orderBy(F.col("doc_id").asc_nulls_last(), "th", "piece")
    ranked = dealt.withColumn("row", F.row_number().over(own) - 1).join(base, ["length", "bucket"])
    ranked = ranked.select(*cut.columns, (F.col("base") + F.col("row")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id bigint, offset bigint"
    return ranked.mapInArrow(_assign(plan(counts, capacity)), schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row per piece with its place: doc_id, th, piece, start, length, ids_crc32, sequence_id, offset.

    Uses doc_id and text; other columns are ignored. A null or empty text is one piece of
    the separator alone. Repeated rows and null ids are packed like any other row, each in
    its own place. An empty table gives no rows.
    """
    return pack(written(pieces(docs, capacity, path), "pieces"), capacity)


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """sequence_id and its token ids (little-endian unsigned 32-bit bytes).

    ``with_ids`` is ``pieces(..., with_ids=True)`` of the same documents. A group is one
    sequence, at most ``capacity`` tokens.
    """
    content = with_ids.select("th", "piece", "ids").dropDuplicates(["th", "piece"])
    parts = packed.join(content, ["th", "piece"]).select("sequence_id", F.struct("offset", "ids").alias("p"))
    grouped = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return grouped.select("sequence_id", F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack_documents(table(spark, sf_dir, "documents")).drop("th")


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of ``docs`` and its place in a sequence; see ``pack_documents``."""
    return pack_documents(docs).drop("th")
