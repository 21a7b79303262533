"""Resampling of documents towards a target distribution of hashed n-grams.

1. Words (runs of ASCII letters and digits and of all other characters beyond
   ASCII, A-Z lower-cased) and runs of up to ``max_n`` of them are features; a
   feature's bucket is its CRC-32 modulo ``buckets``. Counts by bucket, over
   all raw and over all target texts, are combined in each task before they
   move; a bucket's gain is the floored log-ratio of its two smoothed shares.
2. The gains are one array (a number for each bucket, whatever the input), and
   a text's weight is the floored mean of the array at its features' buckets.
   Its score adds Gumbel noise from a hash of its key, so that the highest
   scores are a weighted draw without replacement.
3. The k-th highest key (score falling, then key rising) is found exactly by
   radix selection: digit by digit of the composite key, rows that share the
   digits so far are counted by the next one; a table of 65,536 counts at most
   reaches the driver each time. Only rows up to the k-th key are sorted by
   ranges and ranked; no row is ordered that is not drawn.

Defined results: a null or empty text has no features and weight 0; it is never
drawn where ``min_words`` is above 0; ties of score go to the smaller key,
null keys last; rows that repeat a key have the same noise, and those equal in
score, too, are ordered by their number of features (rows equal in that as well
are told apart by place, which no result shows); empty raw or target tables
count as zero everywhere; other columns are not read. The key must be an integer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written
from prospectrum.llm.textblock import TextBlock, blocks

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bits of a digit of the radix selection.
DIGIT_BITS = 16
#: Words of more bytes are hashed one by one.
LONG_WORD = 48

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1)).astype(np.uint32)


def _crc_on(crc: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """The inverted checksums after one more byte each."""
    return _CRC[(crc ^ byte) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of byte spans, each carried on from a checksum in ``before``."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    first, falling = starts[order], lengths[order]
    crc = np.zeros(len(starts), np.uint32) if before is None else before[order]
    n_long = int(np.searchsorted(-falling, -LONG_WORD))
    for i in range(n_long):
        crc[i] = zlib.crc32(data[first[i] : first[i] + falling[i]].tobytes(), int(crc[i]))
    crc, tail, size = ~crc, first[n_long:], falling[n_long:]
    for at in range(int(size[0]) if len(size) else 0):
        n = n_long + int(np.searchsorted(-size, -at))  # those longer than at
        crc[n_long:n] = _crc_on(crc[n_long:n], data[tail[: n - n_long] + at])
    out = np.empty_like(crc)
    out[order] = ~crc
    return out


class FeatureBlock(TextBlock):
    """Some texts with their words and hashed features."""

    @cached_property
    def in_word(self) -> np.ndarray:
        return _IN_WORD[self.data]

    def features(self, max_n: int) -> tuple[np.ndarray, np.ndarray]:
        """Checksum and text of every run of 1 to max_n words."""
        starts, ends, of = self.word_starts, self.word_ends, self.word_docs
        crc = crc32_spans(self.data, starts, ends)
        found = [(crc, of)]
        for n in range(2, max_n + 1):
            if len(starts) < n:
                break
            spaced = ~_crc_on(~crc[: len(starts) - n + 1], np.uint32(0x20))
            crc = crc32_spans(self.data, starts[n - 1 :], ends[n - 1 :], spaced)
            whole = of[n - 1 :] == of[: len(starts) - n + 1]
            found.append((crc[whole], of[n - 1 :][whole]))
        return np.concatenate([c for c, _ in found]), np.concatenate([o for _, o in found])


def _feature_blocks(column: pa.Array) -> Iterator[tuple[int, int, FeatureBlock]]:
    for row, end, b in blocks(column):
        yield row, end, FeatureBlock(_LOWER[b.data], b.offsets)


def bucket_counts(texts: DataFrame, text: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, b in _feature_blocks(batch.column(0)):
                total += np.bincount(b.features(max_n)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])

    found = np.zeros(buckets, np.int64)
    for row in texts.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        found[row["bucket"]] = row["n"]
    return found


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1,000 times the log-ratio of each bucket's smoothed shares, floored."""
    buckets = len(raw)
    all_raw, all_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, key: str = "doc_id", text: str = "text", max_n: int = 1) -> DataFrame:
    """(key, n_words, n_features, weight) of every whole text."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(gains), len(gains)
    schema = docs.select(key).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for row, end, b in _feature_blocks(batch.column(1)):
                crc, of = b.features(max_n)
                n, sums = np.bincount(of, minlength=b.n_docs), np.zeros(b.n_docs, np.int64)
                np.add.at(sums, of, table[crc % np.uint32(buckets)])
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(b.n_words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight)], names=schema.names)

    return docs.select(key, text).mapInArrow(scored, schema)


def gumbel(key: str, seed: int = SEED) -> Column:
    """1,000 times Gumbel noise from a hash of the key, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _digits(name: str, low: int, high: int, falling: bool = False) -> list[Column]:
    """The digits of a column's distance from its low (or, falling, its high)
    end, the highest first; only those that the span of the column has."""
    span = high - low
    if span < 1 << 63:
        value = F.lit(high) - F.col(name) if falling else F.col(name) - F.lit(low)
    else:  # the distance is no long: order the bits themselves
        span, value = (1 << 64) - 1, F.col(name).bitwiseXOR(F.lit((1 << 63) - 1 if falling else -(1 << 63)))
    n = -(-span.bit_length() // DIGIT_BITS)
    return [F.shiftrightunsigned(value, i * DIGIT_BITS).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for i in reversed(range(n))]


def kth_key(rows: DataFrame, k: int) -> tuple[int, int | None] | None:
    """(score, id) of the k-th row by falling score and rising id, nulls last;
    None if there is no such row. rows: (score long, id long).

    Each digit of the composite key takes one count of the rows that share all
    digits before it; at most 65,536 counts come to the driver.
    """
    ends = rows.agg(F.count("*").alias("n"), F.max("score").alias("top"), F.min("score").alias("low"), F.min("id").alias("first"), F.max("id").alias("last")).first()
    if not 0 < k <= ends["n"]:
        return None
    digits = _digits("score", ends["low"], ends["top"], falling=True)
    digits.append(F.col("id").isNull().cast("long"))
    digits += [] if ends["first"] is None else [F.coalesce(d, F.lit(0)) for d in _digits("id", ends["first"], ends["last"])]
    left = rows
    for digit in digits:
        counts = sorted((r["digit"], r["n"]) for r in left.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect())
        for value, n in counts:
            if k <= n:
                left = left.where(digit == value)
                break
            k -= n
    found = left.select("score", "id").first()  # all that are left have one key
    return found["score"], found["id"]


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with their rank (1, 2, ...) by order, which must tell all rows apart.

    Ranges of the order are sorted each in its own task; the counts of the
    ranges (one number for each task) give where a range's ranks start.
    """
    place = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()), "ranges")
    part, inside = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r["part"], r["n"]) for r in place.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    base = rows.sparkSession.createDataFrame(starts, "__part long, __base long")
    joined = place.join(F.broadcast(base), part == base["__part"])
    return joined.withColumn("rank", F.col("__base") + inside + 1).drop("__place", "__part", "__base")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row; rank is null where
    a row is not among the drawn ``percent`` of those with ``min_words`` words."""
    gains = bucket_gains(bucket_counts(docs, text, max_n, buckets), bucket_counts(target, text, max_n, buckets))
    scored = weights(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), gains, "id", "text", max_n)
    scored = scored.withColumn("score", F.col("weight") + gumbel("id", seed)).withColumn("fit", F.col("n_words") >= min_words).drop("n_words")
    scored = written(scored, "scored")
    fit = scored.where("fit")
    k = fit.count() * percent // 100
    last = kth_key(fit.select("score", F.col("id").cast("long").alias("id")), k)
    if last is None:
        out = scored.withColumn("rank", F.lit(None).cast("long"))
    else:
        score, at = last
        id_fits = F.lit(True) if at is None else F.coalesce(F.col("id") <= F.lit(at), F.lit(False))
        near = F.col("fit") & ((F.col("score") > score) | ((F.col("score") == score) & id_fits))
        order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("__row")]
        drawn = ranked(scored.where(near).withColumn("__row", F.monotonically_increasing_id()), order).drop("__row")
        # rows that equal the k-th in score and key may be more than k
        drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
        out = scored.where(~near).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn)
    return out.select(F.col("id").alias(key), "n_features", "weight", "score", "rank")
