"""Toxicity by a small convolutional text classifier, trained in numpy.

A word's embedding is the sum of hashed embeddings of the word and of its
first four and five bytes, so that inflected forms share what they learn.
Filters of widths 1, 2 and 3 run over the words, each is max-pooled over the
whole text, and a logistic layer gives the probability. Filters and
embeddings fold into one table, so a filter's value is a sum of table rows.

Thresholds are calibrated by language, on outputs for texts that the network
has not seen: two more networks learn from one half of the sample each (by a
hash of the key) and score the other. A logistic fit over these outputs gives a
slope and an offset for each language, drawn to the common one where a language
has few texts, and is moved from the sample's share of label 1 to that of all
labels. So a text's score is its probability of label 1, and ``score >= 0.7``,
say, is another threshold on the network's output for each language. The
language of a text is told from
the text itself, by n-gram filters fitted on the same training texts.

Fitting takes a bounded sample (``sample_docs`` texts of each label, by the
order of a hash, as far as ``sample_words`` words go); their words reach the
driver as hash numbers. Scoring takes every whole text.

Defined results: null and empty texts have no words and get the score of
pooled zeros; repeated rows get equal scores; without labels of both kinds
every score is the share of label 1; an empty table gives an empty result;
only the key and the text are read for a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.llm import language_id
from prospectrum.llm.common import written
from prospectrum.llm.textblock import TextBlock, blocks

SAMPLE_WORDS = 3_000_000
SAMPLE_DOCS, BUCKETS, SIZE, FILTERS, WIDTHS, EPOCHS = 3000, 1 << 15, 12, 6, (1, 2, 3), 4
_PREFIXES = (4, 5)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()")] = True
#: Filter columns: for each width its offsets, each with FILTERS columns.
_OFFSETS = [(w, j) for w in WIDTHS for j in range(w)]


def word_ids(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """Hash numbers of each word and its prefixes, as rows, and words by text."""
    low = TextBlock(_LOWER[b.data], b.offsets)
    starts, ends = low.word_starts.copy(), low.word_ends.copy()
    for _ in range(3):  # punctuation at the word's end
        ends -= (ends - starts > 1) & _EDGE[low.data[np.maximum(ends - 1, 0)]] if len(ends) else 0
    spans = [low.hashes(starts, ends)] + [low.hashes(starts, np.minimum(starts + p, ends)) for p in _PREFIXES]
    ids = np.stack([(h % np.uint64(BUCKETS)).astype(np.int32) + i * BUCKETS for i, h in enumerate(spans)], 1)
    return ids, low.n_words


def _pool(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Greatest filter values over each text's words; at least zero."""
    out = np.zeros((len(n_words), values.shape[1]), np.float32)
    some = n_words > 0
    if some.any():
        first = np.cumsum(n_words) - n_words
        out[some] = np.maximum(np.maximum.reduceat(values, first[some], 0), 0)
    return out


def _filtered(parts: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Values of all filters at each word: parts holds, by word, what it adds
    at each offset. A window past the end of its text is cut short."""
    n, of = len(parts), np.repeat(np.arange(len(n_words)), n_words)
    out, column = [], 0
    for width in WIDTHS:
        value = parts[:, column : column + FILTERS].copy()
        for j in range(1, width):
            column += FILTERS
            if n > j:
                inside = (of[j:] == of[:-j])[:, None]
                value[:-j] += parts[j:, column : column + FILTERS] * inside
        column += FILTERS
        out.append(value)
    return np.hstack(out)


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray | None  # what each hash number adds at each offset
    bias: np.ndarray
    weights: np.ndarray
    base: float
    shifts: dict[str, float]
    languages: language_id.LanguageFilters | None

    def logits(self, ids: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(n_words), self.base)
        parts = self.table[ids[:, 0]] + self.table[ids[:, 1]]
        parts += self.table[ids[:, 2]]
        return _pool(_filtered(parts, n_words) + self.bias, n_words) @ self.weights + self.base

    def score(self, b: TextBlock, present: np.ndarray) -> np.ndarray:
        z = self.logits(*word_ids(b))
        if self.languages is not None:
            names, _ = self.languages.predict(b, present)
            z = z + np.array([self.shifts.get(name, self.shifts[""]) for name in names])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def greatest(values: np.ndarray, pooled: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text and filter, the first word with the greatest value (any
    word where pooling gave zero); and the end of each text's words."""
    end = np.cumsum(n_words)
    top, of = np.zeros((len(n_words), values.shape[1]), np.int64), np.repeat(np.arange(len(n_words)), n_words)
    column, at = np.nonzero((values == pooled[of]).T)
    key = column * len(n_words) + of[at]
    _, first = np.unique(key, return_index=True)
    top[of[at[first]], column[first]] = at[first]
    return top, end


def gradients(layers: tuple, ids: np.ndarray, n_words: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple:
    """Gradients of the weighted logistic loss by the output weights, filters,
    bias and base, and by the embeddings that have any: (rows, gradients). They
    flow through the pooled maxima, for all texts of a batch at once."""
    words, kernel, bias, out, base = layers
    e = words[ids].sum(1)
    value = _filtered(e @ kernel, n_words) + bias
    pooled = _pool(value, n_words)
    p = 1 / (1 + np.exp(-np.clip(pooled @ out + base, -30, 30)))
    g = (p - y) * weight
    to_value = np.outer(g, out) * (pooled > 0)
    top, end = greatest(value, pooled, n_words)
    g_kernel, rows, grads, column = np.zeros_like(kernel), [np.zeros((0, ids.shape[1]), ids.dtype)], [np.zeros((0, words.shape[1]), words.dtype)], 0
    for f, w in enumerate(WIDTHS):
        own = slice(f * FILTERS, (f + 1) * FILTERS)
        for j in range(w):
            at = top[:, own] + j
            here = np.where(at < end[:, None], to_value[:, own], 0).astype(words.dtype)
            text, filter_ = np.nonzero(here)  # none where a text has no words
            at, part = at[text, filter_], here[text, filter_][:, None]
            np.add.at(g_kernel.T, column + filter_, e[at] * part)
            rows.append(ids[at])
            grads.append(part * kernel.T[column + filter_])
            column += FILTERS
    every = np.repeat(np.concatenate(grads), ids.shape[1], 0)
    found, place = np.unique(np.concatenate(rows).ravel(), return_inverse=True)
    total = np.zeros((len(found), words.shape[1]), words.dtype)
    np.add.at(total, place.ravel(), every)
    return pooled.T @ g, g_kernel, to_value.sum(0), g.sum(), found, total


def _train(texts: list[tuple[np.ndarray, int]], labels: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Adagrad on the logistic loss; gradients flow through the pooled maxima."""
    rng, width = np.random.default_rng(seed), len(_OFFSETS) * FILTERS
    words = rng.normal(0, 0.02, (3 * BUCKETS, SIZE)).astype(np.float32)
    kernel = rng.normal(0, 0.5, (SIZE, width)).astype(np.float32)
    bias, out, base = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.abs(rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32), float(np.log(labels.mean() / (1 - labels.mean())))
    seen = [np.full_like(x, 1e-6) for x in (words, kernel, bias, out)] + [1e-6]
    balance = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))

    def step(x: np.ndarray, past: np.ndarray, g: np.ndarray, rate: float) -> None:
        past += g * g
        x -= rate * g / np.sqrt(past)

    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for batch in np.array_split(order, max(1, len(order) // 32)):
            n_words = np.array([texts[i][1] for i in batch])
            ids = np.concatenate([texts[i][0] for i in batch])
            g_out, g_kernel, g_bias, g_base, found, g_words = gradients((words, kernel, bias, out, base), ids, n_words, labels[batch], balance[batch] / len(batch))
            rate = 0.1 * (1 - 0.7 * epoch / epochs)
            step(out, seen[3], g_out + 1e-4 * out, 0.3 * rate)
            step(kernel, seen[1], g_kernel + 1e-4 * kernel, 0.3 * rate)
            step(bias, seen[2], g_bias, 0.3 * rate)
            seen[4] += g_base**2
            base -= 0.3 * rate * g_base / np.sqrt(seen[4])
            seen[0][found] += g_words * g_words
            words[found] -= rate * g_words / np.sqrt(seen[0][found])
    # never touched: no part in a decision
    words[(seen[0] < 2e-6).all(1)] = 0
    return words @ kernel, bias, out, base


def calibration(z: np.ndarray, y: np.ndarray, languages: np.ndarray) -> tuple[float, dict[str, float]]:
    """Slope, and offset by language ("" for any other), of a logistic fit of
    the labels to the outputs z; Newton's method with
    shorter steps where a whole one overshoots, ridge on what a language adds."""
    names = np.unique(languages)
    x = np.hstack([z[:, None], np.ones((len(z), 1)), languages[:, None] == names])
    ridge, w = np.array([1e-2, 1e-3, *np.ones(len(names))]), np.zeros(2 + len(names))
    loss = lambda w: np.sum(np.logaddexp(0, np.where(y == 1, -1, 1) * (x @ w))) + 0.5 * np.sum(ridge * w * w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        change, part = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (p - y) + ridge * w), 1.0
        while part > 1e-6 and loss(w - part * change) > loss(w):
            part /= 2
        w = w - part * change
        if np.abs(change).max() < 1e-9:
            break
    slope = max(w[0], 1e-3)  # never against the network
    return float(slope), {"": float(w[1])} | {str(n): float(w[1] + v) for n, v in zip(names, w[2:], strict=True)}


def train(texts: list[tuple[np.ndarray, int]], labels: np.ndarray, languages: np.ndarray, filters: language_id.LanguageFilters | None, halves: np.ndarray | None = None, share: float | None = None, epochs: int = EPOCHS, seed: int = 5) -> ToxicityModel:
    """texts: hash numbers and number of words; languages: as told from the
    texts; halves: the half (0 or 1) of each text; share: label 1's share of all
    labels. Where a half lacks a label, outputs for the seen texts calibrate."""
    width = len(WIDTHS) * FILTERS
    if len(np.unique(labels)) < 2:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return ToxicityModel(None, np.zeros(width), np.zeros(width), float(np.log(share / (1 - share))), {"": 0.0}, None)

    def network(own: np.ndarray) -> ToxicityModel:
        table, bias, weights, base = _train([texts[i] for i in np.flatnonzero(own)], labels[own], epochs, seed)
        return ToxicityModel(table.astype(np.float32), bias, weights, base, {"": 0.0}, filters)

    model, seen = network(np.ones(len(labels), bool)), np.zeros(len(labels))
    split = halves is not None and all(len(np.unique(labels[halves == h])) == 2 for h in (0, 1))
    for h in (0, 1) if split else (None,):
        scorer, asked = (network(halves != h), halves == h) if split else (model, np.ones(len(labels), bool))
        for i in np.flatnonzero(asked):
            seen[i] = scorer.logits(texts[i][0], np.array([texts[i][1]]))[0]
    slope, shifts = calibration(seen, labels, languages)
    mean = labels.mean()
    share = float(np.clip(mean if share is None else share, 0.001, 0.999))
    moved = np.log(share / (1 - share)) - np.log(mean / (1 - mean))
    return ToxicityModel(model.table, model.bias, model.weights * slope, model.base * slope, {k: v + float(moved) for k, v in shifts.items()}, filters)


def fit(docs: DataFrame, labels: DataFrame, training: Column, key: str = "doc_id", label: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS, **params) -> ToxicityModel:
    """training: which rows of labels and documents may be learned from. Of
    rows that repeat a key the least text counts."""
    known = labels.where(training & F.col(label).isin(0, 1)).select(key, label).distinct()
    share = known.agg(F.avg(F.col(label).cast("double"))).first()[0]
    chosen = language_id.sampled(known, key, label, sample_docs)  # two labels of sample_docs keys
    texts = docs.where(training).select(key, "text").join(F.broadcast(chosen), key).groupBy(key, label).agg(F.min("text").alias("text"))
    filters = language_id.fit(docs.where(training), F.lit(True), key, sample_docs=300)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = np.asarray(batch.column(1).is_valid())
            for row, end, b in blocks(batch.column(1)):
                ids, n = word_ids(b)
                first = np.cumsum(n) - n
                own = [ids[s : s + k].tobytes() for s, k in zip(first, n, strict=True)]
                names, _ = filters.predict(b, present[row:end])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in (0, 2)), pa.array(names, pa.string()), pa.array(own, pa.binary())], names=["k", "y", "l", "ids"])

    def within(rows: DataFrame) -> DataFrame:
        """As many of each label's texts, in hash order, as the words allow;
        one that alone has over a twentieth of the words is no example."""
        order = Window.partitionBy("y").orderBy("o", "k").rowsBetween(Window.unboundedPreceding, 0)
        sizes = rows.select("k", "y", F.octet_length("ids").alias("n"), F.xxhash64("k").alias("o")).where(F.col("n") <= 12 * (sample_words // 20))
        first = sizes.withColumn("n", F.sum("n").over(order)).where(F.col("n") <= 12 * (sample_words // 2))  # ids stay where they are
        return rows.join(first.select("k", "y"), ["k", "y"]).select(rows.columns)

    rows = texts.select(F.col(key).cast("string").alias("k"), "text", F.col(label).cast("int").alias("y")).mapInArrow(hashed, "k string, y int, l string, ids binary")
    rows = within(written(rows, "toxic-texts")).toPandas()
    rows = rows.sort_values("k", kind="stable")
    ids = [np.frombuffer(x, np.int32).reshape(-1, 3) for x in rows.ids]
    halves = np.array([zlib.crc32(b"half " + k.encode()) % 2 for k in rows.k], np.int64)
    return train([(x, len(x)) for x in ids], rows.y.to_numpy(np.int64), rows.l.to_numpy(object), filters, halves, share, **params)


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id") -> DataFrame:
    """(key, score): the higher, the likelier is label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(key).schema.add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = np.asarray(batch.column(1).is_valid())
            for row, end, b in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(shared.value.score(b, present[row:end]), pa.float64())], names=schema.names)

    return docs.select(key, "text").mapInArrow(scored, schema)
