"""A quality classifier by positive-unlabelled learning.

A linear logistic model minimises the non-negative unbiased risk
    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)])
from trusted positives P (label 1) and unlabelled texts U; labels 0 are never used. The class prior
pi is estimated first: a positive-against-unlabelled model, fitted on one half, ranks the other, and
the least ratio of the unlabelled to the positive share above a threshold, with its confidence
bound, is the prior (best-bin estimation), kept within PRIORS. The weight decay is the one of DECAYS
with the least non-negative zero-one risk on a fifth of the sample that the compared models don't see;
that risk needs no labels 0 either.

Features come from the whole text's bytes: shares of byte classes, lengths, repeated lines and
hashed byte pairs, words that follow themselves. Fitting takes a bounded sample, POSITIVES and UNLABELLED rows of lowest hash; it
is the only thing the driver collects. Scoring is one pass without a shuffle.

Null texts are empty and have a score as well. Null doc_ids are never held out, nor sampled.
Repeated rows get equal scores; a doc_id labelled twice is positive if any label is. Extra columns
change nothing; without any positives or any rows the scores are all 0.5. Ties at 0.5 count as 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trawl.llm.shared import chunks, extended, mix, pick, table

#: Most rows of the fitting sample: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 6000, 12_000
HASHED, DENSE = 256, 20
EPOCHS, BATCH, RATE = 40, 512, 0.02
DECAYS, PRIORS = (5e-3, 1e-2, 2e-2, 4e-2), (0.05, 0.98)
_BUCKET = (mix(np.arange(65536, dtype=np.uint64)) % np.uint64(HASHED)).astype(np.int64)
_CLASS = np.zeros(256, np.int64)  # 0: other punctuation
for _k, _bytes in enumerate((b" ", b"\t\r\v\f", b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".,;:!?'\"-()", b"#*$%&|<>", bytes(range(128, 256))), 1):
    _CLASS[list(_bytes)] = _k


def features(texts: list[str | None]) -> np.ndarray:
    """A float32 row of DENSE + HASHED values for each text."""
    raw = [(t or "").encode() for t in texts]
    n, size = len(raw), np.array([len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    row = np.repeat(np.arange(n), size)
    out = np.zeros((n, DENSE + HASHED), np.float32)
    share = 1 / np.maximum(size, 1)[:, None]
    out[:, :10] = np.bincount(row * 10 + _CLASS[data], minlength=n * 10).reshape(n, 10) * share
    out[:, 10] = np.log1p(size) / 10
    spaces = out[:, 1] + out[:, 3]
    out[:, 11] = np.log1p(size / (spaces * size + 1)) / 5  # bytes a word
    for k, t in enumerate(texts):
        lines = t.split("\n") if t else []
        out[k, 12] = 1 - len(set(lines)) / len(lines) if lines else 0
        out[k, 13] = np.log1p(len(lines)) / 10
        words = t.split() if t else []
        if words:
            out[k, 14] = len(set(words)) / len(words)
            out[k, 16] = np.sqrt(sum(map(eq, words, words[1:])) / len(words))
            out[k, 17] = np.sqrt(words.count("|") / len(words))
            out[k, 18] = np.log1p(len(words)) * (1 - out[k, 14]) / 10
    out[:, 15] = size == 0
    out[:, 19] = np.sqrt(out[:, 8])  # of rare marks the first ones tell most
    if len(data) > 1:
        pair, inside = _BUCKET[data[:-1] * 256 + data[1:]], row[:-1] == row[1:]
        out[:, DENSE:] = np.sqrt(np.bincount((row[:-1] * HASHED + pair)[inside], minlength=n * HASHED).reshape(n, HASHED) * share)
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(grad, width: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, steps + 1):
        g = grad(w, t)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def nn_pu(p: np.ndarray, u: np.ndarray, prior: float, decay: float, seed: int = 7) -> np.ndarray:
    """Weights of the linear model with the least non-negative unbiased risk; the last column of p and u is 1."""
    rng, steps = np.random.default_rng(seed), EPOCHS * max(1, len(u) // BATCH)

    def grad(w: np.ndarray, _: int) -> np.ndarray:
        a, b = p[rng.integers(len(p), size=BATCH)], u[rng.integers(len(u), size=BATCH)]
        ga, gb = a @ w, b @ w
        negative = np.logaddexp(0, gb).mean() - prior * np.logaddexp(0, ga).mean()
        of_negative = b.T @ _sigmoid(gb) / len(b) - prior * (a.T @ _sigmoid(ga)) / len(a)
        if negative < 0:  # the negative part can't be below 0: go back up
            return -of_negative
        return -prior * (a.T @ _sigmoid(-ga)) / len(a) + of_negative + decay * w

    return _adam(grad, p.shape[1], steps, RATE)


def class_prior(p: np.ndarray, u: np.ndarray, seed: int = 7) -> float:
    """The share of positives among the unlabelled, by best-bin estimation on held-out halves."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    hp, hu = len(p) // 2, len(u) // 2
    if not hp or not hu:
        return 0.5

    def grad(w: np.ndarray, _: int) -> np.ndarray:
        a, b = p[rng.integers(hp, size=BATCH)], u[rng.integers(hu, size=BATCH)]
        return (b.T @ _sigmoid(b @ w) - a.T @ _sigmoid(-(a @ w))) / BATCH + DECAYS[-1] * w

    w = _adam(grad, p.shape[1], EPOCHS * max(1, hu // BATCH), RATE)
    sp, su = np.sort(p[hp:] @ w), np.sort(u[hu:] @ w)
    top_p = 1 - np.searchsorted(sp, sp) / len(sp)
    top_u = 1 - np.searchsorted(su, sp) / len(su)
    bound = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    best = np.argmin((top_u + bound) / np.maximum(top_p, 1e-9))
    return float(np.clip(top_u[best] / max(top_p[best], 1e-9), *PRIORS))


def zero_one_risk(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray) -> float:
    """The non-negative unbiased estimate of how often the model is wrong."""
    right = (p @ w >= 0).mean()
    return float(prior * (1 - right) + max(0.0, (u @ w >= 0).mean() - prior * right))


def best_decay(p: np.ndarray, u: np.ndarray, prior: float, seed: int = 7) -> float:
    """Of equal risks the greater decay."""
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    hp, hu = len(p) // 5, len(u) // 5
    if not hp or not hu:
        return DECAYS[-1]
    return min(reversed(DECAYS), key=lambda d: zero_one_risk(p[:hp], u[:hu], prior, nn_pu(p[hp:], u[hu:], prior, d)))


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray):
        self.weights = None
        if len(p) and len(u):
            every = np.concatenate([p, u])
            self.mean, self.std = every.mean(0), every.std(0) + 0.02
            ready = lambda x: np.concatenate([(x - self.mean) / self.std, np.ones((len(x), 1))], 1)
            self.prior = class_prior(ready(p), ready(u))
            self.decay = best_decay(ready(p), ready(u), self.prior)
            self.weights = nn_pu(ready(p), ready(u), self.prior, self.decay)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return _sigmoid((x - self.mean) / self.std @ self.weights[:-1] + self.weights[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Rows that are held out take no part."""
    ids = pick(docs, "doc_id").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    lowest = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    trusted = pick(labels, "doc_id", "quality").where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    chosen = lowest(trusted, positives).withColumn("trusted", F.lit(True)).union(lowest(ids.distinct(), unlabelled).withColumn("trusted", F.lit(False)))
    # of positives + unlabelled ids; a doc_id may repeat in docs, and gives the text of least hash
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    texts = pick(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("trusted", "doc_id").agg(least).select("trusted", F.col("least.text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("trusted"), pa.array([x.astype(np.float16).tobytes() for x in features(b.column("text").to_pylist())], pa.binary())], names=["trusted", "x"])

    rows = sorted((r.trusted, bytes(r.x)) for r in texts.mapInArrow(run, "trusted boolean, x binary").collect())
    every = np.frombuffer(b"".join(x for _, x in rows), np.float16).astype(np.float64).reshape(len(rows), DENSE + HASHED)
    mine = np.array([t for t, _ in rows], bool)
    return Model(every[mine], every[~mine])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    rows = pick(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(features(b.column("text").to_pylist())))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, extended(rows.select("doc_id").schema, "score double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
