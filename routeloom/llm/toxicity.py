"""Toxic spans by a linear-chain conditional random field.

Two states, toxic (1) and other (0), over a text's words. Tokens of a bounded sample are
labelled from their documents' labels, the field is fitted to them, and every text is then
tagged whole by forward-backward marginals.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, table
from routeloom.llm.labelled import fold, sample_ids, texts_of

#: Documents of each class that the field is fitted to, at most, and their characters together.
PER_CLASS, CHARS = 4000, 4_000_000
#: A word or prefix marks toxic tokens if so many toxic documents have it, in number and as a
#: share, and at most MAX_SHARE of that share of the others.
MIN_DOCS, MIN_SHARE = 8, 0.01
MAX_SHARE = 0.02
PREFIXES = (4, 5, 6)
HASH_BITS = 18
CONTEXT = 5
#: Long chains are worked on in pieces of this many places.
PIECE = 256
WORD = re.compile(r"[^ \t\n\v\f\r]+")
CACHE = 300_000
#: Documents of each class that the scores are calibrated on, at most.
CALIBRATE = 500


def features(word: str) -> list[str]:
    """A word's own features: itself and its prefixes, in lower case, without punctuation around."""
    w = word.lower().strip(".,;:!?\"'()[]{}*#-_")
    return ["w=" + w] + [f"p{k}={w[:k]}" for k in PREFIXES if len(w) >= k] + [f"s4={w[-4:]}"]


def _slot(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) & (1 << HASH_BITS) - 1


def markers(sample: list[tuple[str, int]]) -> set[str]:
    """Words and prefixes by which tokens are labelled: frequent in toxic documents, next to
    absent from others. A suffix is no marker, as it says too little by itself."""
    n = Counter(y for _, y in sample)
    if not n[0] or not n[1]:
        return set()
    having = lambda text: {f for w in set(WORD.findall(text)) for f in features(w) if f[0] != "s"}
    df: Counter[str] = Counter()
    for text, y in sample:
        if y:
            df.update(having(text))
    often = {f: k for f, k in df.items() if k >= max(MIN_DOCS, MIN_SHARE * n[1])}
    del df  # most words are rare, and only the frequent ones are counted in the other class
    others: Counter[str] = Counter()
    for text, y in sample:
        if not y:
            others.update(often.keys() & having(text))
    return {f for f, k in often.items() if others[f] / n[0] <= MAX_SHARE * k / n[1]}


@dataclass
class Field:
    """Weights of the state 'toxic' for a word's features at its place and beside it; transitions."""

    own: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: float
    trans: np.ndarray  # log-potentials [from, to]
    #: A document's score is the logistic of scale * logit(chance that a word is toxic) + shift.
    scale: float = 1.0
    shift: float = 0.0


def marginals(emit: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior probability of state 1 at every place of many chains laid end to end, exactly.

    ``emit`` is the log-potential of state 1 against 0, ``first`` and ``last`` mark the ends of
    chains. Work is linear in the places, however strong the transitions.
    """
    if not len(emit):
        return emit
    a, e = np.exp(trans), np.exp(np.clip(emit, -60, 60))
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    forward = _messages(e, starts, ends - starts + 1, a)
    backward = _messages(e[::-1], (len(e) - 1 - ends)[::-1], (ends - starts + 1)[::-1], a.T)[::-1]
    odds = forward * backward / e
    return odds / (1 + odds)


def _messages(e: np.ndarray, starts: np.ndarray, lengths: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Forward messages, as ratios of state 1 to state 0, of all chains at once.

    Chains are cut into pieces of PIECE places. Where a chain has several, each piece's effect on
    whatever enters it, a 2 x 2 matrix, is found first, then what enters, piece by piece; then
    every piece is walked, the k-th places of all pieces in one step.
    """
    pieces = -(-lengths // PIECE)
    total = int(pieces.sum())
    chain = np.repeat(np.arange(len(starts)), pieces)
    rank = np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at, size = starts[chain] + rank * PIECE, np.minimum(PIECE, lengths[chain] - rank * PIECE)
    enters = np.full(total, np.nan)  # ratios; the first pieces have none
    inner = np.flatnonzero((rank + 1 < pieces[chain]) & (rank > 0))  # all of them PIECE long
    effect = np.tile(np.eye(2), (len(inner), 1, 1))
    for k in range(PIECE if len(inner) else 0):
        effect = effect @ a
        effect[:, :, 1] *= e[at[inner] + k][:, None]
        effect /= effect.sum(axis=(1, 2), keepdims=True)
    where = np.full(total, -1)
    where[inner] = np.arange(len(inner))

    def walk(r: np.ndarray, which: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Ratios at the pieces' ends; ``which`` goes from long pieces to short ones."""
        r = r.copy()
        counts = np.searchsorted(-size[which], -np.arange(int(size[which].max(initial=0))), side="left")
        for k, n in enumerate(counts):
            places = at[which[:n]] + k
            step, x = r[:n], e[places]
            new = x * (a[0, 1] + step * a[1, 1]) / (a[0, 0] + step * a[1, 0])
            r[:n] = np.where(np.isnan(step), x, new) if k == 0 else new
            if out is not None:
                out[places] = r[:n]
        return r

    heads = np.flatnonzero((rank == 0) & (pieces[chain] > 1))
    flow = walk(enters[heads], heads, None)  # all PIECE long, in any order
    for k in range(1, int(pieces.max())):
        go = pieces[chain[heads]] > k
        heads, flow = heads[go], flow[go]
        enters[heads + k] = flow
        m = effect[where[heads + k]] if len(inner) else np.zeros((len(heads), 2, 2))
        m0, m1 = m[:, 0, 0] + flow * m[:, 1, 0], m[:, 0, 1] + flow * m[:, 1, 1]
        flow = np.divide(m1, m0, out=np.ones_like(m1), where=m0 > 0)
    order = np.argsort(-size, kind="stable")
    out = np.empty(len(e))
    walk(enters[order], order, out)
    return out


def fit(sample: list[tuple[str, int]], steps: int = 120, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum conditional likelihood of labelled token sequences, by Adam.

    Sequences are the tokens around each marked one of every toxic document, and as many stretches
    of the others, spread evenly over their whole texts; expected counts come from ``marginals``.
    """
    marks = markers(sample)
    size = 1 << HASH_BITS
    sequences: list[tuple[list[str], list[int]]] = []
    known: dict[str, int] = {}
    for text in (text for text, y in sample if y):
        words = WORD.findall(text)
        tags = [known[w] if w in known else known.setdefault(w, int(not marks.isdisjoint(features(w)))) for w in words]
        at = 0
        while at < len(words):
            if tags[at]:
                a, b = max(0, at - CONTEXT), min(len(words), at + CONTEXT + 1)
                sequences.append((words[a:b], tags[a:b]))
                at = b
            at += 1
    clean = sum(not y and bool(WORD.search(text)) for text, y in sample)
    each = max(2, round(len(sequences) / max(1, clean)))
    for text in (text for text, y in sample if not y):
        words = WORD.findall(text)
        for at in sorted({int((k + 0.5) * len(words) / each) for k in range(each)}) if words else ():
            part = words[max(0, at - CONTEXT) : at + CONTEXT + 1]
            sequences.append((part, [0] * len(part)))
    if not sequences:
        z = np.zeros(size)
        return Field(z, z, z, -20.0, np.zeros((2, 2)))
    y = np.array([t for _, tags in sequences for t in tags], float)
    first, last = np.zeros(len(y), bool), np.zeros(len(y), bool)
    ends = np.cumsum([len(t) for _, t in sequences])
    last[ends - 1] = True
    first[np.concatenate([[0], ends[:-1]])] = True
    slots: dict[str, list[int]] = {}
    rows, cols, kinds = array("i"), array("i"), array("b")  # small beside lists of numbers
    t = 0
    for words, _ in sequences:
        own = [slots.setdefault(w, [_slot(f) for f in features(w)]) for w in words]
        for k in range(len(words)):
            for c in own[k]:
                rows.append(t), cols.append(c), kinds.append(0)
            if k:
                rows.append(t), cols.append(own[k - 1][0]), kinds.append(1)
            if k + 1 < len(words):
                rows.append(t), cols.append(own[k + 1][0]), kinds.append(2)
            t += 1
    rows_ = np.frombuffer(rows, np.int32)
    flat = np.frombuffer(cols, np.int32) + size * np.frombuffer(kinds, np.int8).astype(np.int32)
    del cols, kinds, slots, known
    used = np.flatnonzero(np.bincount(flat, minlength=3 * size))
    place = np.zeros(3 * size, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    w, trans, bias = np.zeros(len(used)), np.zeros((2, 2)), 0.0
    inner = np.flatnonzero(~first)  # places with one before
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (y[inner - 1].astype(int), y[inner].astype(int)), 1)
    theta = np.zeros(len(used) + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, bias, trans = theta[:-5], theta[-5], theta[-4:].reshape(2, 2)
        emit = np.bincount(rows_, w[flat], len(y)) + bias
        p = marginals(emit, first, last, trans)
        pair = _pairs(emit, first, last, trans)[inner]
        g = np.concatenate([np.bincount(flat, (y - p)[rows_], len(used)), [(y - p).sum()], (seen_pairs - pair.sum(axis=0)).ravel()])
        g = g / len(sequences) - decay * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(3 * size)
    weights[used] = theta[:-5]
    return Field(weights[:size], weights[size : 2 * size], weights[2 * size :], float(theta[-5]), theta[-4:].reshape(2, 2))


def _pairs(emit: np.ndarray, first: np.ndarray, last: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Posterior of the states (before, here) at every place; for short training chains."""
    out = np.zeros((len(emit), 2, 2))
    starts, stops = np.flatnonzero(first), np.flatnonzero(last)
    longest = int((stops - starts).max()) + 1
    a = np.exp(trans)
    psi = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -60, 60))], axis=1)
    alpha, beta = np.zeros((len(emit), 2)), np.ones((len(emit), 2))
    alpha[starts] = psi[starts]
    for k in range(1, longest):
        at = starts + k
        at = at[at <= stops]
        alpha[at] = (alpha[at - 1] @ a) * psi[at]
        alpha[at] /= alpha[at].sum(axis=1, keepdims=True)
    for k in range(1, longest):
        at = stops - k
        at = at[at >= starts]
        beta[at] = (psi[at + 1] * beta[at + 1]) @ a.T
        beta[at] /= beta[at].sum(axis=1, keepdims=True)
    at = np.flatnonzero(~first)
    joint = alpha[at - 1][:, :, None] * a[None] * (psi[at] * beta[at])[:, None, :]
    out[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
    return out


class Tagger(dict):
    """Words as UTF-8 to rows of their weights, computed once for each distinct word."""

    def __init__(self, field: Field) -> None:
        super().__init__()
        # Plain lists and growing arrays: single numbers are read and added there many times
        # faster than in numpy's, and a batch sees the arrays' memory without a copy.
        self.field, self.rows = field, array("d")
        self.own, self.left, self.right = field.own.tolist(), field.left.tolist(), field.right.tolist()

    def __missing__(self, word: bytes) -> int:
        slots = [_slot(f) for f in features(word.decode("utf-8", "replace"))]
        own = self.own
        n = len(self.rows) // 3
        self.rows.extend((sum([own[s] for s in slots]), self.left[slots[0]], self.right[slots[0]]))
        self[word] = n
        return n

    def tag(self, texts: list[bytes]) -> list[np.ndarray]:
        """The marginals of each text's words."""
        if len(self) > CACHE:
            self.clear()
            self.rows = array("d")
        split = [t.split() for t in texts]  # bytes: at ASCII white space only
        index = np.array([self[w] for words in split for w in words], np.int64)
        lengths = np.array([len(w) for w in split])
        if not len(index):
            return [np.zeros(0) for _ in texts]
        own, left, right = np.frombuffer(self.rows, float).reshape(-1, 3).copy().T
        ends = np.cumsum(lengths)
        first, last = np.zeros(len(index), bool), np.zeros(len(index), bool)
        last[ends[lengths > 0] - 1] = True
        first[(ends - lengths)[lengths > 0]] = True
        emit = own[index] + self.field.bias
        emit[1:] += np.where(first[1:], 0.0, left[index[:-1]])
        emit[:-1] += np.where(last[:-1], 0.0, right[index[1:]])
        return np.split(marginals(emit, first, last, self.field.trans), ends[:-1])

    def tag_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """The marginals of many texts, some MB at a time."""
        found, at, held = [], 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held > 4_000_000 or k == len(texts) - 1:
                found += self.tag(texts[at : k + 1])
                at, held = k + 1, 0
        return found


def chance(p: np.ndarray) -> float:
    """The chance that some word is toxic, each word counting with the square of its marginal: one
    sure word decides, a long text's many small marginals don't add up."""
    return float(-np.expm1(np.log1p(-np.minimum(p * p, 1 - 1e-12)).sum()))


def _logit(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 1e-9, 1 - 1e-9)
    return np.log(x / (1 - x))


def score(field: Field, chances: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(field.scale * _logit(chances) + field.shift, -30, 30)))


def calibrate(field: Field, sample: list[tuple[str, int]]) -> Field:
    """Scale and shift by logistic regression on at most CALIBRATE documents of each class, with
    targets a little off 0 and 1 (Platt), so that classes that lie apart get a middle threshold."""
    chosen = []
    for y in (0, 1):
        of = [t for t, label in sample if label == y]
        chosen += [(t, y) for t in of[:: max(1, len(of) // CALIBRATE)]]
    y = np.array([label for _, label in chosen], float)
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    if not n0 or not n1:
        return field
    tagger = Tagger(field)
    z = _logit(np.array([chance(p) for at in range(0, len(chosen), 100) for p in tagger.tag([t.encode() for t, _ in chosen[at : at + 100]])]))
    want = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (q - want) * z).sum() + 1e-4 * a, (weight * (q - want)).sum()])
        h = weight * q * (1 - q)
        hess = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
    if a > 0:
        field.scale, field.shift = float(a), float(b)
    return field


def spans(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code-point offsets of the runs of words with a marginal of at least a half."""
    out: list[list[int]] = []
    before = -2
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] >= 0.5:
            if before == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            before = k
    return [tuple(x) for x in out]


OUT = "doc_id bigint, score double, n_words bigint, spans array<struct<start:bigint,end:bigint>>"


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = broadcast.value
        tagger = Tagger(field)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            found = tagger.tag_all(texts)
            scores = score(field, np.array([chance(p) for p in found]))
            marked = [[{"start": s, "end": e} for s, e in spans(t.decode(), p)] if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, found, strict=True)]
            rest = [b.column(i) for i, n in enumerate(b.schema.names) if n != "text"]
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(scores, pa.float64()), pa.array([len(p) for p in found], pa.int64()), pa.array(marked, kind)], names=[*names, "score", "n_words", "spans"])

    return run


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, per_class: int = PER_CLASS) -> Field:
    """A field fitted to at most ``per_class`` documents and CHARS characters of each class, from
    the folds 1 to 4."""
    learn = fold(modulus) != 0
    sample = texts_of(docs, sample_ids(labels, "toxic", learn, per_class), CHARS)
    return calibrate(fit(sample), sample)


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score, n_words and toxic spans of each text, tagged whole, without a shuffle.

    Uses doc_id and text; other columns are ignored. Null and empty texts, and those without a
    word, have no spans and the least score, what calibration makes of a chance of 0. Repeated rows and null ids are scored like any other; an empty table gives
    none. With no labels of one class, nothing is toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # The field has a fixed size: three tables of 2^18 weights.
    shared = spark.sparkContext.broadcast(field)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), OUT)


def op6_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = tag(docs, train(docs, table(spark, sf_dir, "labels")))
    offsets = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), offsets.alias("spans"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without those that the field finds toxic, trained on the same docs and ``labels``.

    Uses doc_id and text; whatever else docs holds passes through, in a struct, so that no name can
    clash. Null and empty texts stay, repeated rows stay or go alike, and an empty table gives no
    rows.
    """
    field = train(docs, table(spark, sf_dir, "labels"))
    small_batches(spark)
    shared = spark.sparkContext.broadcast(field)
    return docs.select(F.struct(*docs.columns).alias("row")).mapInArrow(_keep(shared), docs.schema)


def _keep(broadcast):
    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = broadcast.value
        tagger = Tagger(field)
        for b in batches:
            rows = pa.RecordBatch.from_struct_array(b.column("row"))
            found = tagger.tag_all([t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()])
            yield rows.filter(pa.array(score(field, np.array([chance(p) for p in found])) < 0.5))

    return filtered
