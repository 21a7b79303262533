"""Inputs on which operators once did less than the whole job."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from cases import DOCUMENTS, table_of, words
from pyspark.sql import functions as F
from test_packing_mixing_search import check_packing
from tokenizers import Tokenizer

from prospectrum.llm import near_copies, packing, quality_classifier, simhash


@pytest.mark.parametrize(("unlabelled", "size"), [(2000, 401), (50, 50)])
def test_a_repeated_key_is_one_text_of_the_quality_sample(spark, monkeypatch, unlabelled, size):
    """One doc_id has a third of the rows; each other key has one."""
    docs = spark.createDataFrame([(i, f"text {i} of many", None, None, None) for i in range(400)] + [(1000, f"copy {i}", None, None, None) for i in range(200)], DOCUMENTS)
    labels = spark.createDataFrame([(i, 1) for i in [*range(30), *[1000] * 50]], "doc_id long, quality int")
    sizes = []
    monkeypatch.setattr(quality_classifier, "train", lambda p, u: sizes.append((p.shape, u.shape)))
    quality_classifier.fit(docs, labels, F.lit(True), positives=20, unlabelled=unlabelled)
    assert sizes == [((20, quality_classifier.N_FEATURES), (size, quality_classifier.N_FEATURES))]


def test_the_quality_sample_is_full_where_all_keys_repeat(spark):
    rows = spark.range(300).crossJoin(spark.range(20).toDF("copy"))
    assert quality_classifier._first(rows, "id", 200).distinct().count() == 200


def test_packing_has_the_added_token_of_the_vocabulary(spark):
    texts = ["<|endoftext|>", "see <|endoftext|> here", "<|endoftext|>" * 3, "a<|endoftext|>b\n<|endoftext|>\n", "<|endoftext| >", "<|<|endoftext|>|>"]
    texts += ["words <|endoftext|> " * 900]
    packed = packing.pack(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCUMENTS)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(packed, dict(enumerate(texts)), tokenizer, 1024)
    assert packing.encoding(packing.vocabulary_path()).encode("see <|endoftext|> here", allowed_special="all") == [3826, 220, 50256, 994]


def planted_copies(n: int) -> list[tuple]:
    """Texts, each with a copy of which a few words are others, and the far copies of one text."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for at in rng.sample(range(200), 1 + i % 4):
            copy[at] = f"other{at}"
        rows += [(i, " ".join(words), None, None, None), (10_000 + i, " ".join(copy).upper().replace("W", "w"), None, None, None)]
    return rows


def similarity(a: str, b: str) -> float:
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(a.lower()), words(b.lower())))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("few", [16, 1])
def test_the_near_duplicate_stage_reaches_similarity_0_8(spark, sf_dir, monkeypatch, few):
    monkeypatch.setattr(near_copies.keep_one, "__defaults__", ("doc_id", "text", 0.8, few, None))
    rows = planted_copies(60)
    base = rows[0][1].split()
    rows += [(20_000, " ".join(base[:60] + ["x"] + base[70:]), None, None, None), (20_001, " ".join(base[:150]), None, None, None)]
    rows += [(30_000, "", None, None, None), (30_001, None, None, None, None), (None, rows[0][1], None, None, None), (0, rows[0][1], None, None, None)]
    docs = table_of(spark, rows)
    left = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert left.columns == docs.columns
    texts = {r[0]: r[1] for r in rows}
    want = {k for k, t in texts.items() if k is not None and t and not any(j is not None and j < k and u and similarity(u, t) >= 0.8 for j, u in texts.items())} | {30_000}
    assert 20_001 in want and 20_000 not in want
    found = sorted((r.doc_id for r in left.collect()), key=lambda k: (k is None, k or 0))
    assert found == sorted([*want, 0]) + [None]
    assert left.where("h <> 'own h'").isEmpty()


def test_classes_of_fingerprints_alone_find_close_copies(spark, monkeypatch):
    """Without min-hash buckets, the classes of operator 4 still catch what is
    within their reach; a class's far member stays."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = [(5, " ".join(base), None, None, None), (6, " ".join(base) + " tail", None, None, None), (7, " ".join(base[:399]), None, None, None), (3, " ".join(rng.sample(base, 400)), None, None, None), (None, " ".join(base), None, None, None)]
    docs = table_of(spark, rows)
    h = F.xxhash64("text")
    groups = docs.where("doc_id is not null").select(F.col("doc_id").alias("key"), h.alias("h"), F.lit(3).cast("long").alias("component_id"))
    keyed = near_copies.sketches(docs, "doc_id", "text").where("key is not null")
    assert near_copies.class_pairs(keyed, groups).count() == 3  # all with the first document, which is like none
    monkeypatch.setattr(near_copies, "bucket_keys", lambda hashes, bounds: np.zeros((int((np.diff(bounds) > 0).sum()), 0), np.uint64))
    found = simhash.classes(docs, shingle_words=5)
    left = near_copies.keep_one(docs, groups=found)
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [3, 5]


def test_unlike_nodes_of_one_bucket_are_not_compared_pair_by_pair(spark, monkeypatch):
    """Sixty far copies of one text in one bucket, and near copies of some of them."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]

    def changed(text: list[str], n: int, mark: str) -> list[str]:
        return [f"{mark}{i}" if i in chosen else x for chosen in [set(rng.sample(range(300), n))] for i, x in enumerate(text)]

    far = [changed(base, 14, f"far{k}-") for k in range(60)]
    rows = [(k, " ".join(t), None, None, None) for k, t in enumerate(far)]
    rows += [(100 + 10 * k + j, " ".join(changed(far[k], 2, f"near{k}-{j}-")), None, None, None) for k in range(0, 60, 12) for j in range(3)]
    sizes, written = {}, near_copies.written

    def counted(df, name):
        sizes[name] = sizes.get(name, 0) + df.count()
        return written(df, name)

    monkeypatch.setattr(near_copies, "written", counted)
    monkeypatch.setattr(near_copies, "bucket_keys", lambda hashes, bounds: np.ones((int((np.diff(bounds) > 0).sum()), 1), np.uint64))
    left = near_copies.keep_one(table_of(spark, rows), few=4)
    assert sorted(r.doc_id for r in left.collect()) == list(range(60))
    assert sizes["pairs"] < 75 * 4  # of 75 nodes; all pairs are 2,775
