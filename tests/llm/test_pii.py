import hashlib
import re
from collections import defaultdict

import pyspark.sql.functions as F

import regex

from routeloom.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_whole_table(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = pii.op1_pii_bootstrap(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in want) for i in range(4)]
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) or not want


def brute_candidates(text):
    """start, end, id, seed and contexts of what may be an identifier, word by word."""
    matches = list(regex.finditer(pii.CANDIDATE, text))
    out = []
    strip = lambda w: regex.sub(r"^[^\p{L}\p{N}]+|(?<=[\p{L}\p{N}])[^\p{L}\p{N}]+$", "", w.lower()) or w
    ends = [0] + [m.end() for m in matches]
    for i, m in enumerate(matches):
        before = (pii.HOLDER if i else "") + text[ends[i] : m.start()]
        after = text[m.end() : matches[i + 1].start()] + pii.HOLDER if i + 1 < len(matches) else text[m.end() :]
        words = [x for x in regex.split(r"[\x20\x09-\x0D]+", before) if x][-2:]
        right = [x for x in regex.split(r"[\x20\x09-\x0D]+", after) if x][:1]
        name = lambda w: pii.HOLDER if pii.HOLDER in w else strip(w)
        words, right = [name(w) for w in words], [name(w) for w in right]
        contexts = []
        if len(words) == 2:
            contexts.append("before " + " ".join(words))
        if words and right:
            contexts.append(f"around {words[-1]} {right[0]}")
        contexts = [c for c in contexts if regex.search(r"^\w+ .*\p{L}", c) and c.split(" ", 1)[1] != f"{pii.HOLDER} {pii.HOLDER}"]
        raw = m.group()
        lead = len(regex.match(r"[^A-Za-z0-9+]*", raw).group())
        core = regex.sub(r"^[^A-Za-z0-9+]+|(?<=[A-Za-z0-9])[^A-Za-z0-9]+$", "", raw)
        whole = [k for s, k, e in brute(core) if (s, e) == (0, len(core))]
        seed = "email" if re.search(PLAIN["email"], raw) else next((pii.KINDS[k] for k in (1, 2, 3) if k in whole), None)
        seed = seed or ("secret" if re.search(pii.SECRET, raw) else None)
        if (contexts or seed) and regex.search(r"[\p{L}\p{N}]", core.lower()):
            out.append((m.start() + lead, m.start() + lead + len(core), core.lower(), seed, contexts))
    return out


def brute_more(texts):
    """Discovered spans by document: the graph held in dictionaries, all scores in each round."""
    found = {i: brute_candidates(t or "") for i, t in texts.items()}
    edges, seeds = defaultdict(set), {}
    for c in found.values():
        for _, _, name, seed, contexts in c:
            for p in contexts:
                edges[p].add(name)
                if seed:
                    seeds[p, name] = max(seed, seeds.get((p, name), ""))
    known = {}
    for (_, name), seed in seeds.items():
        known[name] = max(seed, known.get(name, ""))
    scores, good = {(n, k): 1.0 for n, k in known.items()}, {}
    for _ in range(pii.ROUNDS):
        good = {}
        for p, names in edges.items():
            for kind in pii.ALL_KINDS:
                held = [scores[n, kind] for n in names if (n, kind) in scores]
                confidence = sum(held) / (len(names) + 1)
                if len(held) >= pii.MIN_SUPPORT and confidence >= pii.MIN_CONFIDENCE and any((p, n) in seeds for n in names):
                    good[p, kind] = confidence
        miss = defaultdict(lambda: 1.0)
        for (p, kind), c in good.items():
            for n in edges[p]:
                if (p, n) not in seeds:
                    miss[n, kind] *= 1 - c
        scores = {(n, k): 1.0 for n, k in known.items()} | {x: 1 - m for x, m in miss.items() if x not in {(n, k) for n, k in known.items()}}
    out = {}
    for i, c in found.items():
        spans = []
        for s, e, name, seed, contexts in c:
            kinds = {k for p in contexts for k in pii.ALL_KINDS if (p, k) in good and scores.get((name, k), 0) >= pii.MIN_CONFIDENCE}
            if seed is None and kinds:
                spans.append((s, pii.ALL_KINDS.index(max(kinds, key=lambda k: (scores[name, k], -pii.ALL_KINDS.index(k)))), e))
        out[i] = sorted(x for x in set(spans) if not any(b[0] < x[2] and x[0] < b[2] for b in brute(texts[i])))
    return out


def test_bootstrap_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    # Forms that the seeds miss, in contexts that they share.
    texts |= {10**6 + i: f"say token = sk_live_{i}x{'!' * i} or mail bob{i}@host{i}.net, then mary{i}[at]host" for i in range(3)}
    got = pii.personal_data(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()
    want = brute_more(texts)
    assert {r.doc_id: [tuple(x) for x in r.more] for r in got} == want
    assert all(want[10**6 + i] for i in range(3))


def test_planted_secrets(spark, sf_dir):
    """Recall and precision on the table's planted tokens, whatever surrounds them."""
    sf = sf_dir.replace("sf0.001", "sf0.1")
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    planted = {i: {(m.start(1), m.end(1)) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.IGNORECASE)} for i, t in texts.items()}
    got = {r.doc_id: r for r in pii.personal_data(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    spans = {i: {(x.s, x.e) for x in [*r.seeds, *r.more]} for i, r in got.items()}
    hits = sum(len(planted[i] & spans[i]) for i in planted)
    assert hits == sum(map(len, planted.values())) > 50
    assert hits >= 0.99 * sum(map(len, spans.values()))
    assert sum(len(r.more) for r in got.values()) > 0


TRICKY = [
    "a@b.c_d@e.f x@y@z.w ..a@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4 99999999999999999999.1.1.1", "\U0001f600é 4111 1111-1111 1111 4111111111111112",
    "+1 (269) 555-3296 +12 +1((((( +1234567890123456 +1-2-3-4-5-6-7-8-9", "a@b.c" * 700 + " 10.0.0.1" * 600, "7" * 5000 + "a." * 3000, "", None, "x@" + "a." * 4000 + "b",
]


def test_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)) + [(None, "z@z.zz"), (None, "z@z.zz")], "doc_id bigint, text string").withColumns({"th": F.lit("c"), "base": F.lit(1), "more": F.lit(2)})
    got = pii.personal_data(docs).collect()
    assert len(got) == len(TRICKY) + 2
    for r in got:
        want = brute("z@z.zz" if r.doc_id is None else TRICKY[r.doc_id])
        assert [tuple(x) for x in r.base] == want, r.doc_id
    assert pii.personal_data(docs.limit(0)).collect() == []


def test_contexts_find_unseen(spark):
    seen = [f"Please write to my address user{i}@mail{i}.org today" for i in range(12)] + [f"the server lives at 10.0.{i}.7 for now" for i in range(12)]
    unseen = ["Please write to my address bob77(at)mail today", "nothing of the kind in version 12345 here", "Please write to my address mary88[at]post today"]
    rows = list(enumerate(seen + unseen)) + [(90 + i, f"in chapter number {10000 + i} of it") for i in range(9)]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [tuple(x) for x in got[24].found] == [(27, 0, 40)] and len(got[26].found) == 1
    assert not got[25].found and all(not got[90 + i].found for i in range(9)) and all(len(got[i].found) == 1 for i in range(24))
