"""Quality by positive-unlabelled learning with the non-negative unbiased risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import small_batches, table, written
from routeloom.llm.labelled import bounded, fold

#: Trusted positives and unlabelled documents that the classifier is fitted to, at most.
POSITIVES, UNLABELLED = 6000, 12000
HIDDEN, STEPS, RATE, DECAY = 16, 500, 0.02, 1e-4
BINS = 400
_ALONE = b".,!?#*$%&|<>=_\"'()-/:;@+"


def describe(text: bytes) -> list[float]:
    """Measures of a whole text in UTF-8: shares of characters, word shapes and repetition."""
    n, words = len(text), text.split()
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    k = max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs, triples = set(zip(words, words[1:], strict=False)), set(zip(words, words[1:], words[2:], strict=False))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    shares = [counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum(), counts[128:].sum(), counts[10], counts[32], counts[[35, 42, 36, 37, 38, 124, 60, 62]].sum()]
    shares += [counts[c] for c in _ALONE]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)),
        np.log1p(n),
        *(np.sqrt(s / max(1, n)) for s in shares),
        np.log1p(lengths.mean()) if len(words) else 0.0,
        np.sqrt((lengths > 20).mean()) if len(words) else 0.0,
        np.log1p(lengths.std()) if len(words) else 0.0,
        len(set(words)) / k,
        len(pairs) / max(1, len(words) - 1),
        len(triples) / max(1, len(words) - 2),
        np.sqrt(same / k),
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(k / max(1, len(lines))),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [describe(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()]
        flat = np.array(rows, np.float32).reshape(len(rows), -1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * flat.shape[1], pa.int32()), pa.array(flat.reshape(-1))) if len(rows) else pa.array([], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists], names=["doc_id", "f"])


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``f``, the measures of each whole text; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_features, "doc_id bigint, f array<float>")


@dataclass
class Net:
    """A network with one hidden layer over standardised measures."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Net:
    """Minimises the non-negative PU risk, pi*R+(P) + max(0, R-(U) - pi*R-(P)), logistic loss.

    Where the bracket turns negative, the step goes against its gradient instead, as
    in the published algorithm. With ``prior`` None it is plain positives against
    unlabelled, whose ranking the prior is estimated from.
    """
    rng = np.random.default_rng(7)
    x = np.concatenate([positive, unlabelled]).astype(float)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    z = np.clip((x - mean) / scale, -8, 8)
    is_p = np.arange(len(x)) < len(positive)
    n_p, n_u = max(1, len(positive)), max(1, len(unlabelled))
    params = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        w1, b1, w2, b2 = params
        h = np.tanh(z @ w1 + b1)
        g = np.clip(h @ w2 + b2, -40, 40)
        s = 1 / (1 + np.exp(-g))
        # Derivatives of the losses of "positive" and of "negative" by the logit: s - 1 and s.
        if prior is None:
            d = np.where(is_p, (s - 1) / n_p, s / n_u)
        else:
            negative = np.logaddexp(0, g)
            bracket = negative[~is_p].mean() - prior * negative[is_p].mean()
            if bracket >= 0:
                d = np.where(is_p, prior * (s - 1) / n_p - prior * s / n_p, s / n_u)
            else:
                d = np.where(is_p, prior * s / n_p, -s / n_u)
        back = np.outer(d, w2) * (1 - h * h)
        grads = [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ d + DECAY * w2, np.array([d.sum()])]
        for k, gr in enumerate(grads):
            m1[k] = 0.9 * m1[k] + 0.1 * gr
            m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
            params[k] = params[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Net(mean, scale, *params[:3], float(params[3][0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from their scores' histograms.

    Above a threshold lie a share q_p of the positives and q_u of the unlabelled; the prior
    is at most q_u / q_p. The smallest ratio, each share with its confidence margin, is the
    estimate (best bin).
    """
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    q_p, q_u = np.cumsum(positive[::-1]) / n_p, np.cumsum(unlabelled[::-1]) / n_u
    margin = np.sqrt(np.log(4 / 0.1) / (2 * n_u)) + np.sqrt(np.log(4 / 0.1) / (2 * n_p))
    use = q_p > 0.05
    bound = (q_u + margin)[use] / q_p[use]
    k = int(np.argmin(bound)) if use.any() else 0
    ratio = (q_u[use] / q_p[use])[k] if use.any() else 1.0
    return float(np.clip(ratio, 0.05, 0.98))


def _score(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = broadcast.value
        for b in batches:
            if len(b):
                flat = b.column("f")
                x = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), float).reshape(len(b), -1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(net.score(x))], names=["doc_id", "score"])

    return run


def scored(measured: DataFrame, net: Net) -> DataFrame:
    shared = measured.sparkSession.sparkContext.broadcast(net)  # some kB, whatever the input
    return measured.mapInArrow(_score(shared), "doc_id bigint, score double")


def train(measured: DataFrame, labels: DataFrame, modulus: int = 3) -> tuple[Net, float] | None:
    """The classifier and its class prior, or None without positives.

    Trusted positives are rows with quality 1 in the folds 0 and 2. Unlabelled are any
    documents, labels unseen. Both samples are bounded and taken in the order of a hash;
    the histogram from which the prior is estimated covers every document.
    """
    good = labels.where((fold(modulus) != 1) & (F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = bounded(good, POSITIVES, "positives")
    # Of rows with one id the least counts, so that no more than the sample reaches the driver.
    rows = measured.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("f").alias("f")).orderBy("doc_id").collect()
    if not rows:
        return None
    p = np.array([r["f"] for r in rows], float)
    u_rows = bounded(measured, UNLABELLED, "unlabelled").collect()
    u = np.array([r["f"] for r in u_rows], float)
    half = max(1, len(p) // 2)
    first = fit(p[:half], u, None)
    edges = np.linspace(0, 1, BINS + 1)
    counts = {r["bin"]: r["n"] for r in scored(measured, first).groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()}
    h_u = np.array([counts.get(k, 0) for k in range(BINS)])
    h_p = np.histogram(first.score(p[half:] if len(p) > half else p), edges)[0]
    prior = estimate_prior(h_p, h_u)
    return fit(p, u, prior), prior


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every whole text.

    Uses doc_id and text; other columns are ignored. Null and empty texts have the measures
    of an empty text and a score like any other. Repeated rows and null ids are scored one
    by one; an empty table gives no rows. Without a trusted positive every score is 0.5.
    """
    measured = written(features(docs), "quality-features")
    found = train(measured, labels)
    if found is None:
        return measured.select("doc_id", F.lit(0.5).alias("score"))
    return scored(measured, found[0])


def op3_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of the whole of ``documents``."""
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
