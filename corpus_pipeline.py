"""A training corpus from raw documents, in stages that each write a table.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
documents.

Defined results: a null or empty text fails the rules of the first stage; rows
with a null key pass the two dedup stages unmatched; rows that repeat a key are
told apart by their text, and equal rows stay or go together in every stage
(the first of a repeated passage or of near copies stays, with all rows equal to
it); extra columns pass through to the last stage; an empty table passes
through every stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import line_dedup, mixing, near_copies, packing, quality_rules, simhash
from prospectrum.llm.common import table, written


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, Python gets batches of so many whole texts at most, which
    bounds what a worker and its executor hold beside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that all quality rules pass (operator 9)."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that an earlier document has (operator
    2); n_chars follows the text."""
    cut = line_dedup.dedup(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents whose five-word shingles have similarity
    0.8 or more. The classes of operator 4, over five-word shingles, give the
    first candidates; the pairs that 64 bits don't reach share buckets of
    min-hashes. Before a document goes, whole sets of shingles are compared."""
    with batches_of(spark, 1000):
        groups = written(simhash.classes(docs, shingle_words=5), "classes")
        return near_copies.keep_one(docs, groups=groups)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of all words, sources mixed towards 95 % of the largest
    entropy, no document twice (operator 1)."""
    return mixing.take(docs, budget=0.9, entropy=0.95)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place (operator 5)."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture),
    ("best_fit_packing", packed),
]

#: SQL has no tokenizer, and no XXH64 for the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
