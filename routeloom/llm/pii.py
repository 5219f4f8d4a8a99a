"""Personal data: base patterns, and bootstrapped contexts that find further identifiers.

Everything is DataFrame functions. Seeds are the base patterns' matches and, for secrets such as
keys and tokens, quoted digests. The words around a seed make lexical patterns; patterns and the
identifiers they surround form a bipartite graph that is scored in rounds; confident patterns
then mark what the seeds miss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import let, table, text_key, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; those beyond KINDS have seeds but no base pattern.
ALL_KINDS = (*KINDS, "secret")
# Possessive quantifiers and look-behinds change no match of the plain patterns, as each
# class excludes what must follow it; they keep long runs linear and the stack flat. A
# search that begins inside a run (\G, after a match) is still allowed.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_W, _NW = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: A seed of a secret: a digest of the usual lengths in hexadecimal digits, by itself in quotes.
SECRET = r"^[\"'](?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})[\"']$"
#: What may be an identifier: phone- or card-like groups, else a word with a digit or @, else the
#: word after a key and = or :.
CANDIDATE = rf"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])[0-9](?:[\x20-]?[0-9]){{11,}}+|(?<!{_NW})[^\x20\x09-\x0D0-9@]*+[0-9@]{_NW}*+|(?<=[:=][\x20\x09]?)(?<!{_NW})(?![=:]){_NW}++"
_BYTE = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)|0++)"
VALID_IP = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"

ROUNDS = 3
#: A pattern needs this many distinct known identifiers, and this confidence.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.6
CHUNK = 256
#: Stands for a neighbouring candidate in a context.
HOLDER = "<id>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(VALID_IP),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _placed(items: Column) -> Column:
    """Items (g: gap before, l: length, ...) to structs of start, end and the item.

    Running sums are kept in chunks, so that the lists copied stay short.
    """

    def walk(chunk: Column, base: Column) -> Column:
        zero = F.struct(base.alias("at"), F.filter(F.transform(chunk, lambda x: F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), x.alias("x"))), lambda x: F.lit(False)).alias("out"))
        step = lambda a, x: F.struct(
            (a["at"] + x["g"] + x["l"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + x["l"]).alias("e"), x.alias("x")))).alias("out"),
        )
        return F.aggregate(chunk, zero, step, lambda a: a["out"])

    def chunked(a: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int")), lambda c: F.slice(a, c * CHUNK + 1, CHUNK))

        def bases(cs: Column) -> Column:
            totals = F.transform(cs, lambda ch: F.aggregate(ch, F.lit(0), lambda n, x: n + x["g"] + x["l"]))
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            step = lambda z, n: F.struct((z["at"] + n).alias("at"), F.concat(z["out"], F.array(z["at"])).alias("out"))
            return let(F.aggregate(totals, zero, step, lambda z: z["out"]), lambda b: F.flatten(F.transform(cs, lambda ch, i: walk(ch, b[i]))))

        return let(chunks, bases)

    return let(items, lambda a: F.when(F.size(a) > 0, chunked(a)))


def _base(text: Column, kind: str) -> Column:
    """The kind's valid matches as structs of s, e (code points, end exclusive)."""
    pattern = PATTERNS[kind]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    items = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), lambda x: F.struct(F.length(x["p"]).alias("g"), F.length(x["m"]).alias("l"), x["m"].alias("m")))
    ok = F.transform(F.filter(_placed(items), lambda x: VALID[kind](x["x"]["m"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    cheap = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0}.get(kind, F.lit(True))
    return F.when(cheap & text.rlike(pattern), ok).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _candidates(text: Column) -> Column:
    """Possible identifiers: s, e, id (lower case), seed (its kind, or null) and contexts.

    Contexts are of the words around, in lower case and without punctuation at their ends; a word
    of punctuation alone, such as =, stays. Neighbouring candidates are words like any other,
    all the same, so that lists of identifiers have contexts too.
    """
    pieces, found = F.split(text, CANDIDATE, -1), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def around(p: Column, m: Column, x: Column, i: Column) -> Column:
        n = F.size(m)
        before, after = F.concat(F.when(i > 0, HOLDER).otherwise(""), p[i]), F.concat(p[i + 1], F.when(i + 1 < n, HOLDER).otherwise(""))
        two = F.regexp_extract_all(before, F.lit(rf"(?<!{_NW}){_NW}++(?={_W}*+(?:{_NW}++{_W}*+)?+$)"), F.lit(0))
        return F.struct(F.length(p[i]).alias("g"), F.length(x).alias("l"), x.alias("m"), two.alias("p"), F.regexp_extract(after, rf"^{_W}*+({_NW}++)", 1).alias("q"))

    zipped = let(pieces, lambda p: let(found, lambda m: F.transform(m, lambda x, i: around(p, m, x, i))))

    def word(c: Column) -> Column:
        plain = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]++|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]++$", "")
        return F.when(F.instr(c, HOLDER) > 0, HOLDER).when(plain != "", plain).otherwise(c)

    def one(x: Column) -> Column:
        m, p, q = x["x"]["m"], x["x"]["p"], x["x"]["q"]
        lead = F.length(F.regexp_extract(m, "^[^A-Za-z0-9+]*+", 0))
        core = F.regexp_replace(m, "^[^A-Za-z0-9+]++|(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
        two, left, right = F.when(F.size(p) > 1, word(p[F.size(p) - 2])), F.when(F.size(p) > 0, word(p[F.size(p) - 1])), F.when(q != "", word(q))
        contexts = F.filter(
            F.array(F.concat(F.lit("before "), two, F.lit(" "), left), F.concat(F.lit("around "), left, F.lit(" "), right)),
            lambda c: c.isNotNull() & c.rlike(r"^\w+ .*\p{L}") & ~c.isin(f"before {HOLDER} {HOLDER}", f"around {HOLDER} {HOLDER}"),
        )
        seed = F.when(m.rlike(EMAIL.replace(r"\G|", "")), "email").when(core.rlike("^" + IP + "$") & VALID["ip"](core), "ip")
        seed = seed.when(core.rlike("^" + CARD + "$") & VALID["card"](core), "card").when(core.rlike("^" + PHONE + "$") & VALID["phone"](core), "phone").when(m.rlike(SECRET), "secret")
        return F.struct((x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), F.lower(core).alias("id"), seed.alias("seed"), contexts.alias("contexts"))

    useful = lambda c: ((F.size(c["contexts"]) > 0) | c["seed"].isNotNull()) & c["id"].rlike(r"[\p{L}\p{N}]")
    return F.when(text.rlike("[0-9@:=]"), F.filter(F.transform(_placed(zipped), one), useful))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts: doc_id, th, base spans (s, k, e) and candidates."""
    out = docs.select("doc_id", text_key().alias("th"), text_or_empty().alias("_t"))
    out = out.select("doc_id", "th", *[_base(F.col("_t"), k).alias(k) for k in KINDS], _candidates(F.col("_t")).alias("candidates"))

    def of_kind(i: int) -> Column:
        return F.transform(KINDS[i], lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e")))

    spans = [of_kind(i) for i in range(len(KINDS))]
    return out.select("doc_id", "th", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sort_array(F.concat(*spans)).alias("base"), "candidates")


def bootstrap(scanned: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Scores of patterns (pattern, kind, confidence) and of identifiers (id, kind, score).

    The graph has an edge for each pattern and distinct identifier, so a passage that is
    copied a thousand times counts once. A pattern's confidence for a kind is its
    identifiers' summed score over their number plus one; an identifier's score is the
    noisy-or of its confident patterns. Seeds keep score 1.
    """
    c = scanned.select(F.explode("candidates").alias("c")).select(F.explode("c.contexts").alias("pattern"), "c.id", "c.seed")
    edges = written(c.groupBy("pattern", "id").agg(F.max("seed").alias("seed")), "pii-edges")
    sizes = written(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count("seed").alias("seeds")), "pii-sizes")
    seeds = edges.where("seed IS NOT NULL").groupBy("id").agg(F.max("seed").alias("kind")).select("id", "kind", F.lit(1.0).alias("score"))
    scores = written(seeds, "pii-ids")
    known = scores
    patterns = None
    for _ in range(rounds):
        held = edges.select("pattern", "id").join(scores, "id").groupBy("pattern", "kind").agg(F.sum("score").alias("held"), F.count(F.lit(1)).alias("support"))
        confident = held.where(F.col("support") >= min_support).join(sizes, "pattern").where(F.col("seeds") > 0)
        patterns = written(confident.select("pattern", "kind", (F.col("held") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= min_confidence), "pii-patterns")
        unseen = edges.where("seed IS NULL").select("pattern", "id").join(patterns, "pattern")
        new = unseen.groupBy("id", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        scores = written(known.unionByName(new), "pii-ids")
    return patterns, scores


def discoveries(scanned: DataFrame, patterns: DataFrame, scores: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """doc_id, th and the unseen identifiers' spans (s, k, e) that confident patterns mark."""
    order = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(ALL_KINDS)) + " END")
    at = scanned.select("doc_id", "th", F.explode("candidates").alias("c")).where(F.col("c.seed").isNull())
    at = at.select("doc_id", "th", "c.s", "c.e", "c.id", F.explode("c.contexts").alias("pattern"))
    hits = at.join(patterns, "pattern").join(scores.where(F.col("score") >= min_confidence), ["id", "kind"])
    best = hits.groupBy("doc_id", "th", "s", "e").agg(F.max(F.struct("score", (-order).alias("o"))).alias("b"))
    return best.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("b.o")).alias("k"), "e"))).alias("more"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, and arrays of structs s, k, e: ``base``, ``seeds`` (of kinds without
    a base pattern), ``more`` (discovered by contexts) and ``found``, all of them.

    ``s`` and ``e`` are code points, end exclusive; ``k`` indexes ALL_KINDS. Seeds and discoveries
    that overlap a base span are left out. Uses doc_id and text; other columns are ignored. Null
    and empty texts have no spans. Repeated rows give repeated rows with the same spans, null ids
    included; an empty table gives none.
    """
    scanned = written(scan(docs), "pii-scan")
    patterns, scores = bootstrap(scanned)
    more = discoveries(scanned, patterns, scores).select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "more")
    spans = "array<struct<s:int,k:int,e:int>>"
    secret = F.transform(F.filter("candidates", lambda c: c["seed"] == "secret"), lambda c: F.struct(c["s"].alias("s"), F.lit(len(KINDS)).alias("k"), c["e"].alias("e")))
    marked = scanned.select("doc_id", "th", *[f"n_{k}" for k in KINDS], "base", F.coalesce(secret, F.array().cast(spans)).alias("seeds"))
    both = marked.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "left")
    free = lambda c: F.filter(F.coalesce(c, F.array().cast(spans)), lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    out = both.select("doc_id", *[f"n_{k}" for k in KINDS], "base", free("seeds").alias("seeds"), free("more").alias("more"))
    return out.withColumn("found", F.sort_array(F.concat("base", "seeds", "more")))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"], x["e"])), ",")


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole of ``documents``."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(c).cast("bigint").alias(n) for c, n in (("more", "n_discovered"), (F.filter("found", lambda x: x["k"] == len(KINDS)), "n_secret"), ("found", "n_spans"))]
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("found").alias("spans"), *counts)
