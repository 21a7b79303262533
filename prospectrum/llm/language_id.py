"""Language identification with bit-sliced n-gram filters.

Each language has a Bloom filter of its frequent byte 4-grams. The filters
are stored across each other: a position of the table holds a bitmask with
one bit for each language, so that ANDing the masks at an n-gram's positions
returns all languages that contain it. A text's n-grams are counted by
language (popcounts of the mask's bits), the expected false positives of each
language's filter are taken off, and the largest share decides.

Learning takes a sample of ``sample_docs`` labelled texts of each language, by
the order of a hash, whatever the number of languages; scoring takes every
whole text. N-grams are counted, chosen and put into the filters by Spark; the
driver gets the names of the languages and the finished filters (32 KB for
each language at 2**18 positions), which are the model.

Defined results: ``und`` with score 0 for a null text or one without a
letter; the most frequent language with score 0 where letters are there but
no n-gram is known; rows with a null language are not learned from; a key with
several languages counts for each of them, with its least text of that language;
repeated rows are judged one by one; an empty table gives an empty result, and without
any labelled row every text is ``und``; columns but the named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written
from prospectrum.llm.textblock import TextBlock, blocks

SAMPLE_DOCS, TABLE_BITS, MIN_SHARE, MASK_BITS = 1000, 18, 0.01, 64
#: Parts into which a label's rows are dealt when they meet their count.
SALTS = 64
#: Up to so many sampled keys are broadcast (some 50 bytes each), so that texts stay where they are.
BROADCAST_KEYS = 200_000
UNKNOWN = "und"
#: Multipliers of the filters' hash functions.
HASHES = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[0x61:0x7B] = _ASCII_LETTER[0x41:0x5B] = True


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; other ASCII becomes a space."""
    low = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][upper] += 0x20
    return low


def grams(data: np.ndarray) -> np.ndarray:
    """The 4 bytes from each position, as a number."""
    low = folded(data).astype(np.uint32)
    if len(low) < 4:
        return np.zeros(0, np.uint32)
    return low[:-3] | (low[1:-2] << np.uint32(8)) | (low[2:-1] << np.uint32(16)) | (low[3:] << np.uint32(24))


def _spans(b: TextBlock) -> tuple[np.ndarray, np.ndarray]:
    """First gram and end of the grams of each text."""
    return b.offsets[:-1], np.maximum(b.offsets[:-1], b.offsets[1:] - 3)


@dataclass(frozen=True)
class LanguageFilters:
    """The filters of all languages, the most frequent language first.

    A table's mask holds up to 64 of them; more languages take more tables.
    """

    languages: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    bits: int

    @classmethod
    def of(cls, languages: list[str], tables: list[np.ndarray], bits: int) -> LanguageFilters:
        """Tables of 64-bit masks, in the least width that their languages need."""
        widths = [min(MASK_BITS, len(languages) - first) for first in range(0, len(languages), MASK_BITS)]
        kinds = [next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if n <= np.iinfo(k).bits) for n in widths]
        return cls(tuple(languages), tuple(t.astype(k) for t, k in zip(tables, kinds, strict=True)), bits)

    @classmethod
    def build(cls, languages: list[str], of: np.ndarray, gram: np.ndarray, bits: int = TABLE_BITS) -> LanguageFilters:
        """Filters of n-grams that are at hand: gram[j] is one of languages[of[j]]."""
        tables = [np.zeros(1 << bits, np.uint64) for _ in range(0, len(languages), MASK_BITS)]
        for i in range(len(languages)):
            for h in HASHES:
                tables[i // MASK_BITS][(gram[of == i] * h) >> np.uint32(32 - bits)] |= np.uint64(1 << i % MASK_BITS)
        return cls.of(languages, tables, bits)

    def masks(self, data: np.ndarray) -> list[np.ndarray]:
        """By table, the languages that hold the n-gram at each position."""
        codes, shift = grams(data), np.uint32(32 - self.bits)
        one, two = ((codes * h) >> shift for h in HASHES)
        return [table[one] & table[two] for table in self.tables]

    def shares(self, b: TextBlock) -> np.ndarray:
        """Share of each text's n-grams in each language, less false positives."""
        (first, end), out = _spans(b), np.zeros((b.n_docs, len(self.languages)))
        for t, (table, masks) in enumerate(zip(self.tables, self.masks(b.data), strict=True)):
            kind, s, e = table.dtype.type, np.minimum(first, len(masks)), np.minimum(end, len(masks))
            n, total = np.maximum(e - s, 1), np.zeros(len(masks) + 1, np.int64)
            for i in range(min(MASK_BITS, len(self.languages) - t * MASK_BITS)):
                np.cumsum((masks >> kind(i)) & kind(1), out=total[1:])
                false = np.mean((table >> kind(i)) & kind(1)) ** len(HASHES)
                out[:, t * MASK_BITS + i] = ((total[e] - total[s]) / n - false) / max(1 - false, 1e-9)
        return np.maximum(out, 0)

    def predict(self, b: TextBlock, present: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; present: the texts that aren't null."""
        if not self.languages:
            return [UNKNOWN] * b.n_docs, np.zeros(b.n_docs)
        shares = self.shares(b)
        total, best = shares.sum(1), shares.argmax(1)
        score = np.where(total > 0, shares.max(1) / np.maximum(total, 1e-12), 0.0)
        letters = has_letter(b) & present
        names = [self.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
        return names, np.where(letters, score, 0.0)


def has_letter(b: TextBlock) -> np.ndarray:
    found = b.count_bytes(_ASCII_LETTER) > 0
    for i in np.flatnonzero(~found):  # other scripts: look at the characters
        found[i] = any(c.isalpha() for c in b.data[b.offsets[i] : b.offsets[i + 1]].tobytes().decode("utf-8"))
    return found


def sampled(rows: DataFrame, key: str, label: str, each: int) -> DataFrame:
    """The ``each`` rows of every label that come first by a hash of the key.

    A label's count tells below which hash they lie (four times as many as
    wanted are let through), so a label's list is bounded, however frequent it is;
    its rows meet the count in ``SALTS`` parts.
    """
    known = rows.select(key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull()).withColumn("__h", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)))
    counts = known.groupBy(label).agg(F.count("*").alias("__n"))
    salted = counts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("__salt", F.col("__salt").cast("long"))
    near = known.withColumn("__salt", F.col("__h") % SALTS).join(salted, [label, "__salt"]).where(F.col("__h") * F.col("__n") <= float(4 * each + 100) * (1 << 40)).select(key, label, "__h").distinct()
    first = F.slice(F.sort_array(F.collect_set(F.struct("__h", F.col(key).alias("key")))), 1, each)
    return near.groupBy(label).agg(first.alias("l")).select(F.explode("l").alias("x"), label).select(F.col("x.key").alias(key), label)


def _product(x: Column, h: int) -> Column:
    """x * h modulo 2**32, of numbers below that, without a 64-bit overflow."""
    high = (F.shiftrightunsigned(x, 16) * h).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (x.bitwiseAND(F.lit(0xFFFF)) * h + high).bitwiseAND(F.lit(0xFFFFFFFF))


def fit(docs: DataFrame, training: Column, key: str = "doc_id", label: str = "lang", sample_docs: int = SAMPLE_DOCS, min_share: float = MIN_SHARE, bits: int = TABLE_BITS) -> LanguageFilters:
    """Filters of the n-grams that at least ``min_share`` of a language's
    sampled texts hold. training: which rows may be learned from."""
    rows = docs.where(training & F.col("text").isNotNull()).select(F.col(key).alias("key"), F.col(label).alias("label"), "text")
    chosen = written(sampled(rows, "key", "label", sample_docs), "language-keys")  # sample_docs keys of each language
    few = chosen.count() <= BROADCAST_KEYS
    texts = written(rows.join(F.broadcast(chosen) if few else chosen, ["key", "label"]).groupBy("key", "label").agg(F.min("text").alias("text")), "language-texts")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist(), object)
            for row, end, b in blocks(batch.column(1)):
                codes, (first, last) = grams(b.data), _spans(b)
                own = labels[row:end]
                for language in np.unique(own):
                    each = [np.unique(codes[s:e]) for s, e in zip(first[own == language], last[own == language], strict=True)]
                    gram, n = np.unique(np.concatenate(each), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(gram)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "gram", "n"])

    sizes = sorted(((r["label"], r["n"]) for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    index = docs.sparkSession.createDataFrame([(name, i, max(1.0, n * min_share)) for i, (name, n) in enumerate(sizes)], "label string, i int, least double")
    sums = texts.select("label", "text").mapInArrow(counted, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    kept = sums.where(F.col("gram") != 0x20202020).join(index, "label").where("n >= least")
    at = F.array(*[F.shiftrightunsigned(_product(F.col("gram"), int(h)), 32 - bits) for h in HASHES])
    bit = F.expr(f"shiftleft(1L, i % {MASK_BITS})")
    masks = kept.select(F.floor(F.col("i") / MASK_BITS).cast("int").alias("part"), F.explode(at).alias("at"), bit.alias("mask")).groupBy("part", "at").agg(F.bit_or("mask").alias("mask"))

    def table(rows: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(1 << bits, np.int64)  # of a table there are no more rows than positions
        full[rows["at"]] = rows["mask"]
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "table": [full.tobytes()]})

    found = {r["part"]: r["table"] for r in masks.groupBy("part").applyInPandas(table, "part int, table binary").collect()}
    return LanguageFilters.of([name for name, _ in sizes], [np.frombuffer(found[i], np.uint64) if i in found else np.zeros(1 << bits, np.uint64) for i in range(-(-len(sizes) // MASK_BITS))], bits)


def identify(docs: DataFrame, filters: LanguageFilters, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    schema = docs.select(key).schema.add("lang_pred", "string").add("score", "double")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            present = np.asarray(batch.column(1).is_valid())
            for row, end, b in blocks(batch.column(1)):
                names, score = model.predict(b, present[row:end])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(key, "text").mapInArrow(scored, schema)
