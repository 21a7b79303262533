"""The corpus pipeline, stage by stage, each against a plain version."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest
from cases import DOCUMENTS, passes_rules, table_of, words
from conftest import assert_same
from pyspark.sql import functions as F

from prospectrum.llm import line_dedup, oracles


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append((docs.cache(), stage(spark, docs, sf_dir).cache()))
        docs = out[-1][1]
    return out


def pairs(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for before, after in stages[:-1]:
        assert after.columns == before.columns
        assert 0 < after.count() <= before.count()


def test_quality_stage(stages):
    before, after = stages[0]
    assert pairs(after) == {k: t for k, t in pairs(before).items() if passes_rules(t)}


def test_line_stage(stages, spark, sf_dir, tmp_path):
    before, after = stages[1]
    before.toPandas().to_parquet(tmp_path / "documents.parquet")
    want = f"SELECT doc_id, text, length(text) AS n_chars FROM ({oracles.LINE_DEDUP})"
    assert_same(after.select("doc_id", "text", "n_chars"), want, str(tmp_path))
    assert pairs(line_dedup.dedup(before)) != pairs(before)


def shingle_set(text: str) -> frozenset[str]:
    found = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return frozenset(" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def test_near_duplicate_stage(stages):
    """Against all pairs: what goes has a similar smaller one, and no two that stay are similar."""
    before, after = stages[2]
    texts, left = pairs(before), pairs(after)
    sets = {k: shingle_set(t or "") for k, t in texts.items()}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9
    assert left.items() <= texts.items() and len(left) < len(texts)
    for k in texts:
        if k in left:
            assert not any(j < k and near(j, k) for j in left)
        else:
            assert any(j < k and near(j, k) for j in texts)


def test_mixing_stage(stages):
    before, after = stages[3]
    old, new = pairs(before), pairs(after)
    assert new.items() <= old.items()
    n = lambda texts: sum(len((t or "").split()) for t in texts.values())
    assert n(new) <= 0.9 * n(old)


def test_packing_stage_has_all_documents(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after.collect()} == set(pairs(before))
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_run_is_the_stages_in_turn(spark, sf_dir, stages):
    got, want = corpus_pipeline.run(spark, sf_dir), stages[-1][1]
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_an_empty_table_passes_through(spark, sf_dir):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_null_and_repeated_rows_pass_through(spark, sf_dir):
    text = lambda seed, n: " ".join(f"word{seed}x{i}s" for i in range(n))
    filler = [(100 + i, text(i, 60), "en", "st"[i % 2], 1) for i in range(60)]
    odd = [(1, text(900, 80), "en", "s", 1), (1, text(900, 80), "en", "s", 1), (1, text(901, 80), None, "t", 1), (None, text(902, 80), None, None, None), (None, text(902, 80), None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0)]
    docs = table_of(spark, filler + odd)
    have = Counter((r[0], r[1], r[3]) for r in filler + odd if r[1])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        got = Counter((r.doc_id, r.text, r.source) for r in docs.collect())
        if name == "mixing":  # equal rows are taken together
            assert got and all(n == have[x] for x, n in got.items())
            assert sum(len(x[1].split()) * n for x, n in got.items()) <= 0.9 * sum(len(x[1].split()) * n for x, n in have.items())
        else:
            assert got == have
    packed = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in packed) == Counter(x[0] for x in got.elements())
