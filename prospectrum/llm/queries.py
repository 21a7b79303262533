"""The registered queries: each operator over its whole intended table.

A row with a null doc_id is not held out, and nothing is learned from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectrum.llm import centroids, language_id, line_dedup, mixing, oracles, packing, quality_classifier, quality_rules, resampling, simhash, substring_dedup, topk_search, toxicity, warc
from prospectrum.llm.common import crc_mod, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all words, drawn at 95 % of the largest entropy, at most 4 epochs."""
    return mixing.schedule(table(spark, sf_dir, "documents"), budget=0.5, entropy=0.95, max_repeats=4.0)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text after line dedup, with what went."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, report=True)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    held_out, predicted = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)), (F.col("score") >= 0.5).cast("int")
    return quality_classifier.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language_id.fit(docs, crc_mod("doc_id", 5) != 0)
    return language_id.identify(docs, filters).select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated passages, with the spans of the
    original text that went: start-end:key that keeps it+offset there."""
    found = substring_dedup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    part = lambda s, f: s[f].cast("string")
    span = lambda s: F.concat(part(s, "start"), F.lit("-"), part(s, "end"), F.lit(":"), part(s, "kept_key"), F.lit("+"), part(s, "kept_start"))
    return found.withColumn("removed_spans", F.coalesce(F.array_join(F.transform("removed_spans", span), " "), F.lit("")))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbours of every vector whose id is divisible by 20."""
    codes = topk_search.sign_codes(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(codes, codes.where("id % 20 = 0"), 10)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), statistics=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, crc_mod("doc_id", 3) != 1)
    held_out, predicted = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)), (F.col("score") >= 0.7).cast("int")
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words, drawn towards the benchmark's words."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, as read back from the archives written of them."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_packing": op5_packing,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_topk_search": op8_topk_search,
    "op9_quality_rules": op9_quality_rules,
    "op10_toxicity": op10_toxicity,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_warc": op12_warc,
    "op13_centroid_clustering": op13_centroid_clustering,
}

ORACLES: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op2_line_dedup": oracles.LINE_DEDUP,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_topk_search": oracles.TOP_K,
    "op9_quality_rules": oracles.QUALITY_RULES,
    "op11_importance_resampling": oracles.RESAMPLING,
    "op12_warc": oracles.WARC,
    "op13_centroid_clustering": oracles.CENTROIDS,
}
