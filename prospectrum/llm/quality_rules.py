"""Quality rules as a short-circuit cascade.

A document is kept if no rule rejects it. The rules are cheap to dear byte,
word and line tests; a sample gives each rule's cost (seconds a text) and
selectivity (share of texts it rejects), and the cascade runs the rules in
falling order of rejection per cost. A rule only sees the texts that all
rules before it have passed. The order changes the work, never the verdict.

Defined results: a null text counts as empty; an empty text and one without
words fail the base rules and are not kept; repeated rows are judged one by
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prospectrum.llm.textblock import TextBlock, blocks

MIN_WORDS = 50
#: Rows of the sample that orders the rules (about; a bound on work, not on input).
SAMPLE_ROWS = 2000


def _bytes(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode("ascii"))] = True
    return table


SYMBOLS = _bytes("#*$%&|<>")
UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _bytes("abcdefghijklmnopqrstuvwxyz")
EXCLAMATION = _bytes("!")


@dataclass(frozen=True)
class Rule:
    """A test that marks the texts of a block that it rejects."""

    name: str
    rejects: Callable[[TextBlock], np.ndarray]


def _too_short(b: TextBlock) -> np.ndarray:
    return b.n_words < MIN_WORDS


def _too_repetitive(b: TextBlock) -> np.ndarray:
    return 100 * b.n_repeat_words > 50 * b.n_words


def _symbols(b: TextBlock) -> np.ndarray:
    return 10 * b.count_bytes(SYMBOLS) > b.n_words


def _shouting(b: TextBlock) -> np.ndarray:
    upper = b.count_bytes(UPPER)
    return upper > b.count_bytes(LOWER)


def _exclamations(b: TextBlock) -> np.ndarray:
    return 10 * b.count_bytes(EXCLAMATION) > 3 * b.n_words


def _word_length(b: TextBlock) -> np.ndarray:
    return (10 * b.word_chars < 25 * b.n_words) | (b.word_chars > 12 * b.n_words)


def _stutter(b: TextBlock) -> np.ndarray:
    words, of = b.word_hashes, b.word_docs
    same = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    return 5 * np.bincount(of[1:][same], minlength=b.n_docs) > b.n_words


def _duplicate_lines(b: TextBlock) -> np.ndarray:
    return 2 * b.n_dup_lines > b.n_lines


BASE = (Rule("short", _too_short), Rule("repetitive", _too_repetitive))
RULES = (
    Rule("symbols", _symbols),
    Rule("shouting", _shouting),
    Rule("exclamations", _exclamations),
    Rule("word_length", _word_length),
    Rule("stutter", _stutter),
    Rule("duplicate_lines", _duplicate_lines),
)


def measured(docs: DataFrame, rules: Sequence[Rule] = (*BASE, *RULES), sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """Each rule's cost and selectivity on a sample of about sample_rows.

    The texts of the sample stay on the executors; the driver gets one sum
    for each rule.
    """
    n = docs.count()
    sample = docs.select("text")
    if n > sample_rows:
        sample = sample.sample(False, sample_rows / n, seed)

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, rejected, rows = np.zeros(len(rules)), np.zeros(len(rules), np.int64), 0
        for batch in batches:
            for _, _, b in blocks(batch.column(0)):
                rows += b.n_docs
                for i, rule in enumerate(rules):
                    fresh, began = TextBlock(b.data, b.offsets), time.perf_counter()
                    rejected[i] += rule.rejects(fresh).sum()
                    cost[i] += time.perf_counter() - began
        yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "cost": cost, "rejected": rejected, "rows": [rows] * len(rules)})

    sums = sample.mapInArrow(tried, "rule string, cost double, rejected long, rows long").groupBy("rule").sum("cost", "rejected", "rows")
    return [{"rule": r[0], "cost": r[1] / max(r[3], 1), "rejects": r[2] / max(r[3], 1)} for r in sums.collect()]


def ordered(figures: list[dict], rules: Sequence[Rule] = (*BASE, *RULES)) -> list[Rule]:
    """Rules by falling rejection per cost; those never tried keep their place at the end."""
    by = {x["rule"]: x["rejects"] / max(x["cost"], 1e-9) for x in figures}
    return sorted(rules, key=lambda r: -by.get(r.name, 0.0))


def cascade(b: TextBlock, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts all rules pass. Each rule sees the survivors only."""
    alive, kept = np.arange(b.n_docs), np.zeros(b.n_docs, bool)
    for rule in rules:
        passed = ~rule.rejects(b)
        if not passed.all():
            alive = alive[passed]
            if not len(alive):
                return kept
            b = b.take(passed)
    kept[alive] = True
    return kept


def judge(docs: DataFrame, key: str = "doc_id", statistics: bool = False, rules: Sequence[Rule] | None = None) -> DataFrame:
    """(key, kept), with the base statistics of each text if asked for.

    Base statistics need every text; the cascade then only has the rules left
    that the statistics do not settle, and only the texts that the base passes.
    """
    order = list(rules) if rules is not None else ordered(measured(docs))
    base = {r.name for r in BASE}
    schema = docs.select(key).schema.add("kept", "boolean")
    if statistics:
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            schema = schema.add(name, "long")
        schema = schema.add("base_failed", "boolean")

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b in blocks(batch.column(1)):
                out = [batch.column(0).slice(row, end - row)]
                if statistics:
                    failed = _too_short(b) | _too_repetitive(b)
                    kept = np.zeros(b.n_docs, bool)
                    if not failed.all():
                        left = b.take(~failed) if failed.any() else b
                        kept[~failed] = cascade(left, [r for r in order if r.name not in base])
                    sums = (b.n_words, b.word_chars, b.count_bytes(SYMBOLS), b.n_dup_lines, b.n_repeat_words)
                    out += [pa.array(kept), *(pa.array(x.astype(np.int64)) for x in sums), pa.array(failed)]
                else:
                    out += [pa.array(cascade(b, order))]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.select(key, "text").mapInArrow(judged, schema)


def kept(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The documents that all rules pass, with all their columns.

    Texts and their columns stay in their partition: nothing is shuffled.
    """
    order = list(rules) if rules is not None else ordered(measured(docs))
    at = docs.columns.index("text")

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [cascade(b, order) for _, _, b in blocks(batch.column(at))]
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(passed, docs.schema)
