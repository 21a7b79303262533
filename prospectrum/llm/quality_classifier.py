"""Quality classifier by positive-unlabelled learning.

Trusted positives are texts labelled 1; the unlabelled are web texts without
regard to labels. A small network over text statistics minimises the
non-negative unbiased risk: with class prior q, positive risk P, the
unlabelled's negative risk U and the positives' negative risk N, it is
q P + max(0, U - q N); where the bracket is negative, its gradient is climbed
instead.

The prior is estimated from positives and unlabelled texts alone, no other
label is looked at: a first network, trained on half of both, scores the other
halves. Above any threshold, the share of the unlabelled over the share of the
positives is no less than the prior, but for chance; the least such ratio, with
a margin for chance, is the estimate, held within ``PRIOR_BOUNDS``.

Fitting takes bounded samples (``positives`` and ``unlabelled`` texts, by the
order of a hash); only their statistics, some 80 numbers a text, reach the
driver. Scoring takes every whole text.

Defined results: null and empty texts are scored like any other, from
statistics that are zero; repeated rows get equal scores; without a positive
every score is 0.5; an empty table gives an empty result; only the key
and the text are read for a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.textblock import TextBlock, blocks

POSITIVES, UNLABELLED, HIDDEN, EPOCHS = 6000, 12000, 24, 60
PRIOR_BOUNDS = (0.05, 0.95)

#: Byte classes: space, newline, lower, upper, digit, full stop or comma, other ASCII, beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 2, 3, 4
_CLASS[[0x2E, 0x2C]] = 5
_CLASS[0x80:] = 7
N_FEATURES = 64 + 9


def statistics(b: TextBlock) -> np.ndarray:
    """A row of numbers for each text: shares of byte-class pairs, repetition,
    lengths. All are ratios or logarithms, so long texts are no outliers."""
    of = np.repeat(np.arange(b.n_docs), np.diff(b.offsets))
    kind = _CLASS[b.data].astype(np.int64)
    pair = of[1:] * 64 + kind[:-1] * 8 + kind[1:]
    pairs = np.bincount(pair[of[1:] == of[:-1]], minlength=64 * b.n_docs).reshape(-1, 64)
    n_bytes = np.maximum(np.diff(b.offsets), 1)[:, None]
    words, n = b.word_hashes, np.maximum(b.n_words, 1)
    same = (words[1:] == words[:-1]) & (b.word_docs[1:] == b.word_docs[:-1])
    length = b.word_ends - b.word_starts
    mean = np.bincount(b.word_docs, length, b.n_docs) / n
    spread = np.sqrt(np.maximum(np.bincount(b.word_docs, length**2, b.n_docs) / n - mean**2, 0))
    lines = np.maximum(b.n_lines, 1)
    rest = [np.bincount(b.word_docs[1:][same], minlength=b.n_docs) / n, b.n_repeat_words / n, b.n_dup_lines / lines, b.word_chars / n / 10,
            mean / 10, spread / 10, np.log1p(b.n_words) / 10, np.log1p(b.n_words / lines) / 5, lines / n]
    return np.hstack([np.sqrt(pairs / n_bytes), np.stack(rest, 1)]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """A network of one hidden layer; no layers mean a constant score."""

    prior: float
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        w1, b1, w2, b2 = self.layers
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(x @ w1 + b1) @ w2 + b2[0]

    def score(self, b: TextBlock) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(statistics(b)), -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk_gradient(z_positive: np.ndarray, z_unlabelled: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the non-negative risk under the logistic loss, by logit."""
    p, u = _sigmoid(z_positive), _sigmoid(z_unlabelled)
    n_p, n_u = max(len(p), 1), max(len(u), 1)
    negative = np.mean(np.logaddexp(0, z_unlabelled)) - prior * np.mean(np.logaddexp(0, z_positive))
    if negative >= 0:
        return prior * (p - 1) / n_p - prior * p / n_p, u / n_u
    return prior * p / n_p, -u / n_u  # climb until the estimate is a risk again


def least_ratio(positive: np.ndarray, unlabelled: np.ndarray, margin: float = 1.0) -> float:
    """The estimate of the class prior from scores of held positives and
    unlabelled texts: the least ratio of their shares above a threshold, where
    the margin of chance (DKW bound at 10 %) is least against the share."""
    n, m = len(positive), len(unlabelled)
    cuts = np.sort(positive)[::-1]  # above the k-th, k positives
    p = np.arange(1, n + 1) / n
    u = (m - np.searchsorted(np.sort(unlabelled), cuts, "left")) / m
    chance = margin * (np.sqrt(np.log(20) / (2 * n)) + np.sqrt(np.log(20) / (2 * m)))
    best = int(np.argmin((u + chance) / p))
    return float(u[best] / p[best])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 11) -> float:
    """The share of positives among the unlabelled; 0.5 from fewer than 8 of either."""
    if min(len(positive), len(unlabelled)) < 8:
        return 0.5
    first = train(positive[::2], unlabelled[::2], 0.5, epochs=EPOCHS // 4, seed=seed)
    return float(np.clip(least_ratio(first.logits(positive[1::2]), first.logits(unlabelled[1::2])), *PRIOR_BOUNDS))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = 11) -> QualityModel:
    """prior: the class prior; estimated where it is not given."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(0.5, np.zeros(N_FEATURES), np.ones(N_FEATURES), ())
    prior = float(np.clip(estimated_prior(positive, unlabelled, seed) if prior is None else prior, 0.01, 0.99))
    rng = np.random.default_rng(seed)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    xs = [np.clip((x - centre) / scale, -8, 8) for x in (positive, unlabelled)]
    layers = [rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    first, second, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    steps = max(8, len(unlabelled) // 256)
    for epoch in range(epochs):
        order = [np.array_split(rng.permutation(len(x)), steps) for x in xs]
        rate = 5e-3 * (1 - epoch / epochs) + 2e-4
        for parts in zip(*order, strict=True):
            parts = [p if len(p) else rng.integers(0, len(x), 1) for p, x in zip(parts, xs, strict=True)]
            x = np.vstack([xs[i][p] for i, p in enumerate(parts)])
            h = np.tanh(x @ layers[0] + layers[1])
            z = h @ layers[2] + layers[3][0]
            g = np.concatenate(risk_gradient(z[: len(parts[0])], z[len(parts[0]) :], prior))
            back = np.outer(g, layers[2]) * (1 - h * h)
            t += 1
            for i, d in enumerate((x.T @ back, back.sum(0), h.T @ g, np.array([g.sum()]))):
                d = d + 1e-4 * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(prior, centre, scale, tuple(layers))


def _measured(texts: DataFrame) -> np.ndarray:
    """Statistics of a bounded number of texts, as an array."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b in blocks(batch.column(0)):
                yield pa.RecordBatch.from_pydict({"x": pa.array([row.tobytes() for row in statistics(b)], pa.binary())})

    rows = texts.select("text").mapInArrow(of, "x binary").toPandas().x
    return np.frombuffer(b"".join(sorted(map(bytes, rows))), np.float32).reshape(-1, N_FEATURES)


def _first(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n keys by the order of a hash. The count of keys tells below which hash
    they lie (four times as many are let through), so few rows are sorted."""
    keys = rows.where(F.col(key).isNotNull()).select(key, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)).alias("__h"))
    n_keys = keys.agg(F.approx_count_distinct(key)).first()[0]  # of keys, not rows, whatever repeats
    near = keys.where(F.col("__h") * float(n_keys) <= float(4 * n + 100) * (1 << 40)).distinct()
    return near.orderBy("__h", key).limit(n).select(key)


def fit(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> QualityModel:
    """training: which rows, of labels and of web texts, may be learned from.
    Of rows that repeat a key the least text counts."""
    trusted = _first(labels.where(training & (F.col(label) == 1)), key, positives)
    web = _first(docs.where(training), key, unlabelled)
    texts = docs.where(training).select(key, "text")
    chosen = [texts.join(F.broadcast(keys), key).groupBy(key).agg(F.min("text").alias("text")) for keys in (trusted, web)]
    return train(*map(_measured, chosen))


def score(docs: DataFrame, model: QualityModel, key: str = "doc_id") -> DataFrame:
    """(key, score): the higher, the likelier is label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(key).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(shared.value.score(b), pa.float64())], names=schema.names)

    return docs.select(key, "text").mapInArrow(scored, schema)
