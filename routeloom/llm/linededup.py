"""Line dedup by winnowing: later repeats of runs of lines go, wherever they stand.

Everything is DataFrame functions. A run of lines is a repeat if it has MIN_WORDS words and
occurs before, in the order of document and line, at a place that it doesn't overlap: where
copies overlap, the first stays whole. Windows are the shortest runs with that many words,
onwards from each line and backwards from each. A window's smallest line hash, at its first
place, is its fingerprint. Equal runs hold equal windows, hence equal fingerprints, so that only
windows around a fingerprint that stands at two places are looked at as a whole.

Only whole lines count. A passage that is repeated in the middle of longer lines isn't found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import NOT_WS, if_small, let, table, text_key, text_or_empty, written

#: A run of lines is a repeat from this many words on.
MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """The lines that have a word, as structs of i (number in the text), h (hash), n (words)."""
    numbered = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(NOT_WS + "+")).alias("n")),
    )
    return F.filter(numbered, lambda x: x["n"] > 0)


def _span(lines: Column) -> Column:
    """How many of the first lines have MIN_WORDS words together; 0 if all have fewer."""
    start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("k"))
    step = lambda a, x: F.when(a["w"] >= MIN_WORDS, a).otherwise(F.struct((a["w"] + x["n"]).alias("w"), (a["k"] + 1).alias("k")))
    return F.aggregate(lines, start, step, lambda a: F.when(a["w"] >= MIN_WORDS, a["k"]).otherwise(0))


def _windows(lines: Column) -> Column:
    """Structs s, e (places among the lines): the shortest runs with enough words from each
    line onwards, and from each line backwards. A line has a word, so MIN_WORDS lines do."""

    def build(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(a) - 1)
        on = F.transform(places, lambda s: F.struct(s.alias("s"), (s + F.when(a[s]["n"] >= MIN_WORDS, 1).otherwise(_span(F.slice(a, s + 1, MIN_WORDS))) - 1).alias("e")))
        first = lambda e: F.greatest(F.lit(0), e - MIN_WORDS + 1)
        back = F.transform(
            places,
            lambda e: F.struct((e - F.when(a[e]["n"] >= MIN_WORDS, 1).otherwise(_span(F.reverse(F.slice(a, first(e) + 1, e - first(e) + 1)))) + 1).alias("s"), e.alias("e")),
        )
        # A line with enough words is its own window either way; it is listed once.
        return F.filter(F.concat(on, F.filter(back, lambda w: a[w["e"]]["n"] < MIN_WORDS)), lambda w: w["e"] >= w["s"])

    return F.when(F.size(lines) > 0, let(lines, build)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _place(start: str) -> Column:
    """What runs are ordered by; documents without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id"), F.col("th"), F.col(start).alias("at"))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th and ``gone``, the places (among the lines with a word, from 0) of lines to
    delete, for documents that have any. Rows alike in id and text are one document.

    1. Each window is winnowed to its smallest line hash and the place of that.
    2. Fingerprints are joined on their hash: those that stand at one place only drop out, and
       with them their windows, unread.
    3. The windows left are hashed over all their lines, and each is joined with the first place of
       its kind, so that the n copies of a hot passage make n rows and no pairs.
    4. Matches are extended both ways: a longer repeated run is covered by windows, those onwards
       from each line up to its left end, those backwards up to its right end, each matched with
       the first place of its own kind. A match that begins inside that place is skipped.
    """
    worded = docs.select("doc_id", text_key().alias("th"), _lines(text_or_empty()).alias("lines"))

    def winnowed(lines: Column, w: Column) -> Column:
        least = F.array_min(F.transform(F.slice(lines, w["s"] + 1, w["e"] - w["s"] + 1), lambda x, k: F.struct(x["h"].alias("h"), (w["s"] + k).alias("at"))))
        return F.struct(w["s"].alias("s"), w["e"].alias("e"), least["h"].alias("print"), least["at"].alias("at"))

    prints = let(F.col("lines"), lambda a: F.transform(_windows(a), lambda w: winnowed(a, w)))
    hashes = F.transform("lines", lambda x: x["h"])
    scanned = written(worded.select("doc_id", "th", hashes.alias("hashes"), prints.alias("windows")).where(F.size("windows") > 0), "windows")
    windows = scanned.select("doc_id", "th", F.explode("windows").alias("w")).select("doc_id", "th", "w.*")
    shared = windows.groupBy("print").agg(F.min(_place("at")).alias("lo"), F.max(_place("at")).alias("hi")).where("lo < hi").select("print")
    around = windows.join(written(shared, "prints"), "print", "left_semi")
    around = written(around.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("near")), "around")
    around = around.select(F.col("doc_id").alias("id"), F.col("th").alias("key"), "near")
    read = scanned.select("doc_id", "th", "hashes").join(around, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("th") == F.col("key")))
    run = lambda w: F.struct(w["s"].alias("s"), w["e"].alias("e"), F.xxhash64(F.slice("hashes", w["s"] + 1, w["e"] - w["s"] + 1)).alias("run"))
    runs = written(read.select("doc_id", "th", F.explode(F.transform("near", run)).alias("w")).select("doc_id", "th", "w.*"), "runs")
    lead = F.min(F.struct(_place("s").alias("at"), "e"))
    first = written(runs.groupBy("run").agg(lead.alias("first"), F.max(_place("s")).alias("last")).where("first.at < last").select("run", "first"), "first-runs")
    same = F.col("doc_id").eqNullSafe(F.col("first.at.doc_id")) & (F.col("th") == F.col("first.at.th"))
    later = runs.join(first, "run").where((_place("s") > F.col("first.at")) & ~(same & (F.col("s") <= F.col("first.e"))))
    gone = later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e")).alias("later"))
    places = F.sort_array(F.array_distinct(F.flatten(F.transform("later", lambda w: F.sequence(w["s"], w["e"])))))
    return written(gone.select("doc_id", "th", places.alias("gone")), "gone")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns), text, n_lines (with a word) and n_deleted.

    Uses doc_id and text; whatever else docs holds is carried in ``row``, so that no name can
    clash. A null text stays null and an empty one empty; a text that only repeats becomes empty.
    Lines without a word are never deleted. Ids may be null (they come last in the order) or
    repeat: rows alike in id and text are one document and keep the same lines. Very long texts
    are read whole; an empty table gives no rows.
    """
    found = repeated_lines(docs)
    found = found.select(F.col("doc_id").alias("id"), F.col("th").alias("key"), "gone")
    # Most documents lose nothing, and only the others' lines are joined, if these are few.
    found = if_small(found, F.size("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("of"), text_key().alias("h"))
    both = rows.join(found, F.col("of").eqNullSafe(F.col("id")) & (F.col("h") == F.col("key")), "left")
    text = F.col("row.text")

    def rest(lines: Column) -> Column:
        numbers = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(NOT_WS), i)), lambda i: i.isNotNull())
        drop = let(numbers, lambda n: F.transform(F.col("gone"), lambda k: n[k]))
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: lines[i]), "\n")

    kept = F.when(F.col("gone").isNotNull(), let(F.split(text, "\n", -1), rest)).otherwise(text)
    n_lines = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOT_WS + r"[^\n]*+")).cast("bigint")
    return both.select("row", kept.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_deleted"))


def op7_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of ``documents`` without later repeats of runs of lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "n_lines", "n_deleted")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with repeated lines deleted and n_chars counted anew; see ``dedup_lines``."""
    out = dedup_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("text").cast("bigint")).otherwise(F.col("row").getField("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, i, a[i] AS line, len(list_filter(regexp_split_to_array(a[i], '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n
  FROM t, LATERAL (SELECT unnest(range(1, len(a) + 1)) AS i)),
w AS (SELECT *, row_number() OVER o AS p, sum(n) OVER o AS upto FROM l WHERE n > 0 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT s.doc_id, s.p AS s, min(e.p) AS e FROM w s JOIN w e ON s.doc_id = e.doc_id AND e.p BETWEEN s.p AND s.p + {MIN_WORDS - 1} AND e.upto - s.upto + s.n >= {MIN_WORDS} GROUP BY ALL
  UNION SELECT e.doc_id, max(s.p), e.p FROM w s JOIN w e ON s.doc_id = e.doc_id AND s.p BETWEEN e.p - {MIN_WORDS - 1} AND e.p AND e.upto - s.upto + s.n >= {MIN_WORDS} GROUP BY e.doc_id, e.p),
x AS (SELECT r.doc_id, r.s, r.e, string_agg(w.line, chr(10) ORDER BY w.p) AS body FROM r JOIN w ON w.doc_id = r.doc_id AND w.p BETWEEN r.s AND r.e GROUP BY ALL),
o AS (SELECT body, arg_min(doc_id, (doc_id, s)) AS doc_id, arg_min(s, (doc_id, s)) AS s, arg_min(e, (doc_id, s)) AS e FROM x GROUP BY body),
f AS (SELECT x.* FROM x JOIN o USING (body) WHERE (x.doc_id, x.s) > (o.doc_id, o.s) AND NOT (x.doc_id = o.doc_id AND x.s <= o.e)),
g AS (SELECT DISTINCT w.doc_id, w.i FROM f JOIN w ON w.doc_id = f.doc_id AND w.p BETWEEN f.s AND f.e),
d AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: NOT list_contains(gone, i)), lambda i: a[i]), chr(10)), '') END AS text,
  (SELECT count(*) FROM w WHERE w.doc_id = t.doc_id) AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_deleted FROM t LEFT JOIN d USING (doc_id)
"""
