"""Quality rules as a bitmask ledger: every rule once, policies and ablations on the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import NOT_WS, WS, let, table, text_or_empty

WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter_words", "n_letters")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``fails``, SQL over the measures, is true."""

    bit: int
    name: str
    fails: str


#: Bits are never reused; a changed threshold is a new rule with a new bit.
RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * word_chars"),
    Rule(3, "stutter", "100 * n_stutter_words > 30 * n_words"),
    Rule(4, "no_letters", "n_letters = 0"),
    Rule(5, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule(6, "long_words", "word_chars > 40 * n_words"),
)
BASE = (0, 1)
#: Versioned policies: the bits that reject a document.
POLICIES = {"v1": BASE, "v2": (*BASE, 2, 3, 4), "v3": (*BASE, 2, 3, 4, 5, 6)}
DEFAULT_POLICY = "v2"


def mask(bits: tuple[int, ...]) -> int:
    return sum(1 << b for b in bits)


def _covered(windows: Column) -> Column:
    """Words covered by the windows whose hash occurs twice or more.

    Hashes are sorted with their positions, so equal ones are neighbours; the positions
    that have an equal neighbour are sorted again and their windows' union is summed.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same = lambda x, k: (k > 0) & (s[k - 1]["h"] == x["h"]) | (k < F.size(s) - 1) & (s[k + 1]["h"] == x["h"])
        return F.transform(F.filter(s, same), lambda x: x["i"])

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
    return F.aggregate(F.sort_array(let(pairs, repeated)), start, step, lambda a: a["n"])


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures, each computed once, in one pass without a shuffle.

    Words are runs of characters other than the six ASCII white-space characters. Windows
    of eight words are compared by a 64-bit hash of their words' 64-bit hashes.
    """
    words = F.filter(F.split(F.col("_t"), WS + "+", -1), lambda w: w != "")
    lines = F.filter(F.split(F.col("_t"), "\n", -1), lambda line: line.rlike(NOT_WS))
    return (
        docs.select("doc_id", text_or_empty().alias("_t"))
        .select("doc_id", "_t", words.alias("_w"), lines.alias("_l"))
        .select("*", F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"))
        .select(
            "*",
            let(
                F.col("_h"),
                lambda h: F.when(
                    F.size(h) >= WINDOW,
                    F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
                ).otherwise(F.array().cast("array<bigint>")),
            ).alias("_g"),
            let(F.col("_h"), lambda h: F.size(F.filter(h, lambda x, i: (i > 0) & (h[i - 1] == x)))).alias("_s"),
        )
        .select(
            "doc_id",
            F.size("_w").cast("bigint").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
            (F.size(F.split("_t", "[#*$%&|<>]", -1)) - 1).cast("bigint").alias("n_symbols"),
            F.size("_l").cast("bigint").alias("n_lines"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
            F.when(F.size(F.array_distinct("_g")) == F.size("_g"), F.lit(0)).otherwise(_covered(F.col("_g"))).cast("bigint").alias("n_repeat_words"),
            F.col("_s").cast("bigint").alias("n_stutter_words"),
            F.length(F.regexp_replace("_t", r"[^\p{L}]+", "")).cast("bigint").alias("n_letters"),
        )
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measures and ``fail_bits``: bit b is set where the rule with that bit fails.

    Uses doc_id and text; other columns, whatever their names, are ignored. A null text
    counts as empty: all measures 0, and few_words and no_letters fail. Repeated rows give
    repeated rows; an empty table gives none. Null ids are kept as null.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint") for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measures(docs).select("*", total.alias("fail_bits"))


def apply_policy(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """Adds ``policy`` and ``kept``: no bit of the policy's mask is set. No rule runs again."""
    m = F.lit(mask(POLICIES[version])).cast("bigint")
    return entries.withColumns({"policy": F.lit(version), "kept": F.col("fail_bits").bitwiseAND(m) == 0})


def ablation(entries: DataFrame, version: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: documents it fails, and those that only it rejects.

    The ledger is first counted by ``fail_bits``, so what is shuffled is at most one row
    for each set of bits and task, however many documents there are.
    """
    m = mask(POLICIES[version])
    counts = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit")) for r in RULES if r.bit in POLICIES[version]])
    each = counts.select("fail_bits", "n", F.explode(rules).alias("r"))
    hit = F.col("fail_bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")) == F.col("r.bit")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum("n").alias("documents"),
    )


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the whole of ``documents`` under the default policy."""
    entries = apply_policy(ledger(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(BASE)).cast("bigint")) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "n_stutter_words", "n_letters", "fail_bits"
    )


_BITS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
ORACLE = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT *, list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS g FROM w),
x AS (SELECT r, unnest(g) AS gram, unnest(range(1, len(g) + 1)) AS i FROM g),
d AS (SELECT r, i FROM x QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
c AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM d, range({WINDOW}) AS s(k) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutter_words,
  length(regexp_replace(t, '[^\p{{L}}]', '', 'g'))::BIGINT AS n_letters
  FROM g LEFT JOIN c USING (r)),
b AS (SELECT *, ({_BITS})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(BASE)}) <> 0 AS base_failed,
  (fail_bits & {mask(POLICIES[DEFAULT_POLICY])}) = 0 AS kept, n_lines, n_stutter_words, n_letters, fail_bits FROM b
"""
