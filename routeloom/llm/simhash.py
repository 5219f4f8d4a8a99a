"""SimHash near-duplicates found through Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import if_small, release, small_batches, table, text_key, written
from routeloom.llm.components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 2
#: The 64 bits in three segments (first bit, bits); each fits in a Golay word of 23 bits.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Buckets up to this size are compared in pairs; larger ones are linked through hubs.
PAIR_BUCKET = 24
#: Generator polynomial of the perfect binary Golay code of length 23.
GOLAY = 0xC75
BATCH_SHINGLES = 1 << 16
#: The pipeline's stage links texts whose sets of 5-word shingles have this Jaccard similarity.
STAGE_WORDS = 5
STAGE_SIMILARITY = 0.8
#: Its fingerprints are wider, 24 segments of a Golay word each, over 2-word shingles. Two texts
#: are candidates if, for one of the first KEYS segments, both are near one codeword and EXACT bits
#: of another segment agree.
WIDE_SEGMENTS, WIDE_WORDS, KEYS, EXACT = 24, 2, 16, 16
#: Candidates further apart than this are no match: of pairs at a similarity of 0.8 or more,
#: about 1 in 500 is.
WIDE_BITS = 76
#: Bits of the parities of a shingle set, as longs; as many bits differ as shingles do, or fewer.
PARITY_LONGS = 16
#: Rounds in which texts are compared with one text of a bucket, before all that are left are.
STAR_ROUNDS = 3


def fingerprint(text: bytes | None) -> int:
    """The unsigned SimHash of a text in UTF-8: over 3-word shingles, repeats included.

    A bit is 1 if over half of the shingles' XXH64 values have it. A text of one or two
    words is one shingle; a text without words, or null, has fingerprint zero.
    """
    words = text.lower().split() if text else []  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), max(1, len(words) - SHINGLE_WORDS + 1)
    for at in range(0, n, BATCH_SHINGLES):
        part = words[at : at + BATCH_SHINGLES + SHINGLE_WORDS - 1]
        grams = zip(*(part[k:] for k in range(SHINGLE_WORDS)), strict=False) if len(words) >= SHINGLE_WORDS else [words]
        hashes = np.array([digest(b" ".join(g), SEED) for g in grams], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fp)], names=["doc_id", "th", "fp"])


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each byte at each of three places, and the error of each syndrome."""

    def syndrome(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    of_byte = np.array([[syndrome(b << 8 * k) if b << 8 * k < 1 << 23 else 0 for b in range(256)] for k in range(3)], np.int64)
    error = np.zeros(2048, np.int64)
    for n in range(4):
        for bits in combinations(range(23), n):
            v = sum(1 << i for i in bits)
            error[syndrome(v)] = v
    return of_byte, error


def golay_index(v: np.ndarray) -> np.ndarray:
    """The 12-bit message of the one codeword within three bits of each 23-bit word."""
    of_byte, error = _tables()
    s = of_byte[0][v & 255] ^ of_byte[1][v >> 8 & 255] ^ of_byte[2][v >> 16]
    return (v ^ error[s]) >> 11


def _near_codewords(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codeword indices, each once, of all words within one of so many bits."""
    near = [golay_index(words)] + [golay_index(words ^ (1 << b)) for b in range(bits)]
    index = np.sort(np.stack(near, axis=1), axis=1)
    first = np.ones(index.shape, bool)
    first[:, 1:] = index[:, 1:] != index[:, :-1]
    r, c = np.nonzero(first)
    return r, index[r, c]


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions into ``fp`` and keys. Two words at most two bits apart share a key.

    At most two bits in error leave one of three segments exact (pigeonhole). The segment
    after it has at most two errors: some word lies within one bit of both copies, and as
    each segment is hashed to the codewords of all words within one bit of it, they share
    a codeword. A key holds the exact segment, its number and the codeword's index.
    """
    u = fp.view(np.uint64)
    segments = [((u >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(segments):
        j = (i + 1) % 3
        r, index = _near_codewords(segments[j], SEGMENTS[j][1])
        rows.append(r)
        keys.append((i << 40) | (exact[r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fp):
            rows, keys = fuzzy_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])


def links(prints: DataFrame, max_pairs: int = PAIR_BUCKET) -> DataFrame:
    """Edges ``src``, ``dst`` between distinct ``fp`` values that connect exactly those that
    chains of at most two differing bits connect.

    Buckets of at most ``max_pairs`` are compared in pairs and verified. Larger ones could
    hold thousands of near copies, whose pairs grow with the square; their fingerprints are
    linked through hubs instead: two words differ in at most two bits exactly if one word
    lies within one bit of both, so each is sent to its 65 such words, and the at most 65
    that meet there are linked to their smallest.
    """
    keys = written(prints.mapInArrow(_keys, "key bigint, fp bigint"), "keys")
    # Written, as the adaptive planner splits a hot key only between two plain exchanges.
    many = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded")
    shared = written(keys.join(many, "key"), "buckets")
    few = shared.where(F.col("n") <= max_pairs).select("key", "fp")
    pairs = (
        few.alias("a")
        .join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
        .where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_BITS)
        .select(F.col("b.fp").alias("src"), F.col("a.fp").alias("dst"))
    )
    crowd = shared.where(F.col("n") > max_pairs).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    hubs = crowd.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("hub"))
    stars = (
        hubs.groupBy("hub")
        .agg(F.collect_set("fp").alias("near"))
        .where(F.size("near") > 1)
        .select(F.array_min("near").alias("dst"), F.explode("near").alias("src"))
        .where("src <> dst")
        .select("src", "dst")
    )
    return pairs.unionByName(stars).distinct()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(text: bytes | None, words: int) -> np.ndarray:
    """Hashes of a text's shingles of so many words, repeats included; a shorter text is one
    shingle, and so is a text without words."""
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in text.lower().split()] if text else [], np.uint64)
    size = max(1, min(words, len(h)))
    g = np.full(max(1, len(h) - size + 1), min(size, len(h)), np.uint64)
    for k in range(min(size, len(h))):
        g = _mixed(g * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(g)])
    return g


def shingle_set(text: bytes | None, words: int = STAGE_WORDS) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(_shingles(text, words))


def wide_print(text: bytes | None) -> np.ndarray:
    """A SimHash of 576 bits, as nine words: over 2-word shingles, repeats included."""
    g, lanes = _shingles(text, WIDE_WORDS), -(-WIDE_SEGMENTS * 23 // 64)
    counts = np.zeros(64 * lanes, np.int64)
    salts = (np.arange(1, lanes + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))[None]
    for at in range(0, len(g), 255):  # so many ones fit in a byte
        bits = np.unpackbits(_mixed(g[at : at + 255, None] + salts).view(np.uint8), axis=1, bitorder="little")
        counts += bits.view(np.uint64).sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > len(g), bitorder="little").view(np.int64)


def _wide_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([wide_print(t) for t in b.column("text").cast(pa.binary()).to_pylist()], np.int64)
        lanes = [pa.array(c) for c in prints.reshape(-1, -(-WIDE_SEGMENTS * 23 // 64)).T]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *lanes], names=["doc_id", "th", *LANES])


LANES = [f"f{k}" for k in range(-(-WIDE_SEGMENTS * 23 // 64))]


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions into ``prints`` (rows of nine words) and keys: for each of KEYS
    segments, the indices of the codewords of all words within one bit of it, each with the first
    bits of a segment further on."""
    bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")[:, : WIDE_SEGMENTS * 23]
    segments = bits.reshape(-1, WIDE_SEGMENTS, 23).astype(np.int64) @ (1 << np.arange(23))
    rows, keys = [], []
    for i in range(KEYS):
        word, exact = segments[:, i], segments[:, (i + WIDE_SEGMENTS // 3) % WIDE_SEGMENTS] & (1 << EXACT) - 1
        r, index = _near_codewords(word, 23)
        rows.append(r)
        keys.append((i << 12 + EXACT) | (exact[r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        th = b.column("th").to_numpy(zero_copy_only=False)
        prints = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in LANES], axis=1).astype(np.int64)
        for at in range(0, len(th), 2000):
            rows, keys = wide_keys(np.ascontiguousarray(prints[at : at + 2000]))
            order = np.argsort(rows, kind="stable")  # a text's keys lie together
            yield pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(th[at + rows[order]])], names=["key", "th"])


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY_LONGS classes of hashes, whether the set has an odd number of them.

    Every shingle in one of two sets only flips one bit, so two sets differ in at least as many
    shingles as their parities differ in bits."""
    odd = np.bincount(shingles % (64 * PARITY_LONGS), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


PARITIES = [f"p{k}" for k in range(PARITY_LONGS)]
SETS = "th bigint, shingles binary, size bigint, " + ", ".join(f"{c} bigint" for c in PARITIES)


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [np.unique(shingle_set(t) >> np.uint64(32)).astype(np.uint32) for t in b.column("text").cast(pa.binary()).to_pylist()]
        odd = np.array([parities(s) for s in sets], np.int64).reshape(-1, PARITY_LONGS)
        columns = [b.column("th"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, odd.T)], names=["th", "shingles", "size", *PARITIES])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("a_set").to_pylist(), b.column("b_set").to_pylist(), strict=True):
            p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(both / (len(p) + len(q) - both) >= STAGE_SIMILARITY)
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], names=["src", "dst"])


def _apart(x: str, y: str, columns: list[str] = LANES) -> Column:
    """Differing bits of two wide fingerprints, or of other columns."""
    return reduce(lambda a, b: a + b, [F.bit_count(F.col(x + c).bitwiseXOR(F.col(y + c))) for c in columns])


def _candidates(x: str, y: str) -> Column:
    """False for texts whose fingerprints are too far apart, or whose parities alone show that
    their shingle sets are less similar than STAGE_SIMILARITY."""
    # At this similarity sets differ in at most so many of their shingles; a little more covers rounding.
    most = (1 - STAGE_SIMILARITY) * (F.col(x + "size") + F.col(y + "size")) + 1e-3
    return (_apart(x, y) <= WIDE_BITS) & ((1 + STAGE_SIMILARITY) * _apart(x, y, PARITIES) <= most)


def similar_links(once: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges ``src``, ``dst`` that connect all texts of a similarity of STAGE_SIMILARITY that share
    a key; ``once`` has th and the wide fingerprint of each distinct text, ``sets`` gives the
    columns SETS of texts by th.

    A bucket of many near copies isn't squared: in each of a few rounds its texts are compared
    with one of them, and of all such pairs each text has the nearest verified on whole
    shingle sets. Then, in buckets that still hold texts of different components, texts are compared
    across components, and those near enough verified, none left out. Every round
    leaves fewer such buckets, as it merges what is similar. What a pair is compared by lies in the
    rows of its bucket, so that only those become a row whose sets may be similar (``_candidates``):
    a crowd around one text that isn't similar among itself makes none.
    """
    keys = written(once.mapInArrow(_wide_keys, "key bigint, th bigint"), "keys")
    many = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "crowded")
    met = written(keys.join(many, "key"), "met")
    have = written(sets(written(met.select("th").distinct(), "asked")), "shingles")
    looks = [*LANES, "size", *PARITIES]
    sides = written(have.drop("shingles").join(once.select("th", *LANES), "th"), "sides")
    shared = written(met.join(sides, "th").select("key", "th", *looks), "buckets")
    side = lambda df, x: df.select("key", *[F.col(c).alias(x + c) for c in ("th", "label", *looks)])
    edges = tested = None

    def labelled() -> DataFrame:
        if edges is None:
            return shared.withColumn("label", F.col("th"))
        labels = connected_components(edges).select(F.col("node").alias("th"), "label")
        return shared.join(labels, "th", "left").withColumn("label", F.coalesce("label", "th"))

    def verified(pairs: DataFrame) -> bool:
        """Adds the pairs that are similar to the edges; false if there was none to look at."""
        nonlocal edges, tested
        pairs = written(pairs.select("a", "b"), "pairs")
        if edges is not None and pairs.isEmpty():
            return False
        one = lambda x: have.select(F.col("th").alias(x), F.col("shingles").alias(x + "_set"))
        found = written(pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(_verified, "src bigint, dst bigint"), "similar")
        edges = found if edges is None else edges.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
        release(once.sparkSession)
        return True

    def untested(pairs: DataFrame) -> DataFrame:
        if tested is None:
            return pairs
        both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(both, ["a", "b"], "left_anti")

    for r in range(STAR_ROUNDS):
        buckets = written(labelled(), "labelled")
        hub = F.min(F.struct(F.xxhash64("th", F.lit(r)).alias("o"), "th", "label", *looks)).alias("hub")
        hubs = written(buckets.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), hub).where("lo < hi").select("key", "hub.*"), "hubs")
        near = side(buckets, "a").join(side(hubs, "b"), "key").where((F.col("alabel") != F.col("blabel")) & _candidates("a", "b"))
        near = untested(near.select(F.col("ath").alias("a"), F.col("bth").alias("b"), _apart("a", "b").alias("d")).distinct())
        if not verified(near.groupBy("a").agg(F.min_by("b", F.struct("d", "b")).alias("b"))):
            break
    buckets = written(labelled(), "labelled")
    mixed = written(buckets.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"), "mixed")
    left = written(buckets.join(mixed, "key", "left_semi"), "left")
    rest = side(left, "a").join(side(left, "b"), "key").where((F.col("alabel") < F.col("blabel")) & _candidates("a", "b"))
    verified(untested(rest.select(F.col("ath").alias("a"), F.col("bth").alias("b")).distinct()))
    return edges


def similar_texts(docs: DataFrame) -> DataFrame:
    """doc_id, th, rep_id and rep_th as in ``near_duplicates``, where texts are linked at a Jaccard
    similarity of STAGE_SIMILARITY of their sets of 5-word shingles, verified on whole sets.

    Candidates come from Golay keys of wide fingerprints; of pairs at 0.8 or more the keys find
    about 98 in 100 (README), and chains of links find more. Texts without words are alike; null
    counts as empty; equal texts are always linked; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    release(docs.sparkSession)
    kind = "doc_id bigint, th bigint, " + ", ".join(f"{c} bigint" for c in LANES)
    rows = written(docs.select("doc_id", "text", text_key().alias("th")).mapInArrow(_wide_prints, kind), "prints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("th"))).alias("lead")
    once = written(rows.groupBy("th").agg(lead, *[F.first(c).alias(c) for c in LANES]), "distinct")

    def sets(wanted: DataFrame) -> DataFrame:
        # Copies of one text may be many: one of each is read, by its lowest id.
        asked = written(once.join(wanted, "th").select("th", F.col("lead.doc_id").alias("lead_id")), "asked-ids")
        here = docs.select("doc_id", "text", text_key().alias("dh"))
        texts = here.join(if_small(asked), (F.col("dh") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("lead_id")))
        return texts.select("th", "text").mapInArrow(_shingle_sets, SETS).dropDuplicates(["th"])

    labels = connected_components(similar_links(once.select("th", *LANES), sets)).select(F.col("node").alias("th"), "label")
    grouped = written(once.select("th", "lead").join(labels, "th"), "grouped")
    leads = written(grouped.groupBy("label").agg(F.min("lead").alias("group_lead")), "leads")
    release(docs.sparkSession)
    merged = grouped.join(leads, "label").select("th", "group_lead")
    owner = written(once.select("th", "lead").join(merged, "th", "left").select("th", F.coalesce("group_lead", "lead").alias("lead")), "owners")
    return rows.select("doc_id", "th").join(owner, "th").select("doc_id", "th", F.col("lead.doc_id").alias("rep_id"), F.col("lead.th").alias("rep_th"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), fp, rep_id, rep_th.

    ``rep_id`` and ``rep_th`` name the group's representative: the row with the smallest
    doc_id (null last, ties by the text's hash) among all that chains of linked
    fingerprints reach. Uses columns doc_id and text; others are ignored. Null and empty
    texts have fingerprint zero and are linked like any other. Rows repeated with one id
    and text share a representative. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    # Everything after this table works on three numbers a row.
    rows = written(docs.select("doc_id", "text", text_key().alias("th")).mapInArrow(_fingerprints, "doc_id bigint, th bigint, fp bigint"), "prints")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("th"))).alias("lead")
    prints = written(rows.groupBy("fp").agg(lead), "distinct")
    labels = connected_components(links(prints.select("fp"))).select(F.col("node").alias("fp"), "label")
    grouped = written(prints.join(labels, "fp").select("fp", "label", "lead"), "grouped")
    leads = written(grouped.groupBy("label").agg(F.min("lead").alias("group_lead")), "leads")
    merged = grouped.join(leads, "label").select("fp", "group_lead")
    owner = written(
        prints.join(merged, "fp", "left").select("fp", F.coalesce("group_lead", "lead").alias("lead")),
        "owners",
    )
    return rows.join(owner, "fp").select("doc_id", "th", "fp", F.col("lead.doc_id").alias("rep_id"), F.col("lead.th").alias("rep_th"))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, over the whole of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep_id").alias("component_id"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates (``similar_texts``): the row with the
    smallest doc_id, null last; of several such rows, the first in the order of all columns.

    Uses doc_id and text; whatever else docs holds passes through. Null and empty texts, and those
    without words, are one group. An empty table gives no rows.
    """
    found = similar_texts(docs)
    kept = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th"))
    marked = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"), F.first(kept).alias("kept"))
    # Most rows stay as they are; what is joined are the others.
    marked = written(marked.where("NOT kept OR n > 1"), "marked")
    # Rows travel as structs, so that no name of a column can clash with these.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), text_key().alias("h"))
    both = rows.join(if_small(marked), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")), "left").select("row", "id", "h", "kept")
    several = both.where("kept").groupBy("id", "h").agg(F.min("row").alias("row")).select("row")
    return both.where("kept IS NULL").select("row").unionByName(several).select("row.*")
