"""Packing, mixing and search: round trips, bounds and brute force."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import CLASHING, DOCUMENTS, edge_rows, table_of
from conftest import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospectrum.llm import mixing, oracles, packing, topk_search


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows: list, texts: list[str | None], tokenizer, capacity: int) -> int:
    """Every id is there once, in order, and sequences have no gaps."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc.pop(doc), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) == len(ids) and all(r.length == capacity for r in own[1:])
        assert len(own) == max(1, -(-len(ids) // capacity))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    assert not by_doc
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0, *[r.length for r in own]])[:-1])
        assert sum(r.length for r in own) <= capacity
    return len(by_sequence)


@pytest.mark.parametrize(("capacity", "block_pieces"), [(1024, 4096), (64, 3)])
def test_packing_round_trip(spark, tokenizer, capacity, block_pieces):
    rows = list({r[0]: r for r in edge_rows() if r[0] is not None}.values())
    packed = packing.pack(table_of(spark, rows), capacity=capacity, block_pieces=block_pieces).collect()
    n = check_packing(packed, {r[0]: r[1] for r in rows}, tokenizer, capacity)
    total = sum(r.length for r in packed)
    assert n == max(math.ceil(total / capacity), sum(r.length * 2 > capacity for r in packed)) or n <= math.ceil(total / capacity) * 1.02 + 1


def test_packing_of_the_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.pack(docs).collect()
    n = check_packing(packed, {r.doc_id: r.text for r in docs.collect()}, tokenizer, 1024)
    assert n <= math.ceil(sum(r.length for r in packed) / 1024) + 1


def test_packing_of_repeated_rows_and_null_keys(spark):
    rows = edge_rows()
    packed = packing.pack(table_of(spark, rows)).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    places = [(r.sequence_id, r.offset) for r in packed]
    assert len(set(places)) == len(places)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
@settings(max_examples=150, deadline=None)
def test_bin_slack_packs_all_and_fills_the_fullest_bin(histogram):
    for slacks in (packing.SLACKS, (0,)):
        patterns = packing.minimum_bin_slack(histogram, 40, slacks)
        used = defaultdict(int)
        for bin_, times in patterns:
            assert sum(n * k for n, k in bin_.items()) <= 40 and times > 0
            for length, k in bin_.items():
                used[length] += k * times
        assert dict(used) == histogram
    if histogram:  # without slack, the first bin is the fullest that holds the largest length
        top, sums = max(histogram), {0}
        for length, count in histogram.items():
            sums = {s + length * k for s in sums for k in range(count - (length == top) + 1) if s + length * k <= 40 - top}
        assert sum(n * k for n, k in patterns[0][0].items()) == top + max(sums)


@pytest.fixture(scope="module")
def mixed_dir(spark, tmp_path_factory):
    rows = [(i, "w " * (1 + i % 7), "en", "abc"[0 if i % 10 < 7 else 1 if i % 10 < 9 else 2] if i % 13 else None, 0) for i in range(400)]
    rows += [(1000, None, None, "empty", 0), (1001, "", None, "empty", 0), (1002, "x " * 500, None, "abc"[2], 0)]
    folder = tmp_path_factory.mktemp("mixed")
    table_of(spark, rows, clashing=False).toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


def test_mixing_matches_the_sql(spark, mixed_dir):
    docs = spark.read.parquet(f"{mixed_dir}/documents.parquet").withColumns({c: F.lit(1) for c in CLASHING})
    assert assert_same(mixing.schedule(docs, budget=0.5, entropy=0.95, max_repeats=4.0), oracles.MIXING, mixed_dir) > 0


@pytest.mark.parametrize(("entropy", "repeats", "block_docs"), [(0.95, 4.0, 1024), (1.0, 1.5, 16), (0.0, 1.0, 5)])
def test_weights_meet_the_targets(spark, mixed_dir, entropy, repeats, block_docs):
    docs = spark.read.parquet(f"{mixed_dir}/documents.parquet")
    rows = mixing.schedule(docs, budget=0.5, entropy=entropy, max_repeats=repeats, block_docs=block_docs).collect()
    texts = {r.doc_id: r for r in docs.collect()}
    tokens, taken, weight = defaultdict(int), defaultdict(int), {}
    for r in texts.values():
        tokens[r.source] += len((r.text or "").split())
    for r in rows:
        assert r.n_tokens == len((texts[r.doc_id].text or "").split())
        taken[r.source] += r.n_tokens
        weight[r.source] = r.weight
    budget = math.floor(sum(tokens.values()) * 0.5)
    assert abs(sum(weight.values()) - 1) < 1e-6 and "empty" not in weight
    spread = -sum(w * math.log(w) for w in weight.values())
    tight = max(w * budget / tokens[s] for s, w in weight.items()) >= repeats * 0.999
    assert tight or spread >= math.log(4) * entropy - 1e-6
    for s, w in weight.items():
        assert taken[s] <= round(w * budget) < taken[s] + 500 + 1  # short of the quota by less than a document
        assert w * budget / tokens[s] <= repeats * 1.001
    starts = sorted((r.source or "", r.start, r.n_tokens) for r in rows)
    for a, b in zip(starts, starts[1:], strict=False):
        assert a[0] != b[0] or a[1] + a[2] == b[1]  # streams without gaps
    if repeats == 1.0:
        assert len({r.doc_id for r in rows}) == len(rows)


def test_take_repeats_nothing_and_keeps_columns(spark):
    docs = table_of(spark, edge_rows())
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    have, got = (Counter((r.doc_id, r.source, r.text) for r in x.collect()) for x in (docs, taken))
    assert got and all(n == have[x] for x, n in got.items())


def test_take_holds_its_budget_where_keys_repeat(spark):
    """Most rows share a key and a source, some of them in other sources."""
    rows = [(1, f"one two three {i % 40}", None, "a", 0) for i in range(300)] + [(1, f"w{i} x y z", None, "b", 0) for i in range(100)]
    rows += [(i, "alone in here now", None, "abc"[i % 3], 0) for i in range(2, 200)] + [(None, f"no key {i} here", None, "c", 0) for i in range(50)]
    docs = table_of(spark, rows)
    for budget in (0.3, 0.9):
        have, got = (Counter((r.doc_id, r.source, r.text) for r in x.collect()) for x in (docs, mixing.take(docs, budget=budget, block_docs=16)))
        assert all(n == have[x] for x, n in got.items())
        assert 0.6 * budget * len(rows) < got.total() <= budget * len(rows)


def test_schedule_counts_repeated_rows_one_by_one(spark):
    rows = [(7, "a b c", None, "s", 0)] * 2500 + [(i, "a b c", None, "s", 0) for i in range(8, 30)] + [(7, "a b", None, "t", 0)] * 3
    got = mixing.schedule(table_of(spark, rows), budget=0.5, entropy=0.0).collect()
    starts = sorted(r.start for r in got if r.source == "s")
    assert starts == list(range(0, 3 * len(starts), 3)) and len(starts) == 3 * 2522 // 6
    assert max(Counter((r.doc_id, r.source) for r in got).values()) <= 2500


def brute(codes: dict[int, int], queries: list[int], k: int) -> set[tuple]:
    out = set()
    for q in queries:
        near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:k]
        out |= {(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)}
    return out


@pytest.mark.parametrize(("n", "k", "cell_rows"), [(400, 10, 8192), (1500, 3, 64), (7, 10, 8192), (300, 5, 8)])
def test_search_matches_brute_force(spark, n, k, cell_rows):
    rng = np.random.default_rng(n)
    codes = {int(i): int(c) for i, c in enumerate(rng.integers(0, 2**64, n, np.uint64, endpoint=False))}
    for i in range(0, n // 3):  # copies and near copies
        codes[i] = codes[i % 5] ^ (1 << int(rng.integers(0, 64)) if i % 3 else 0)
    index = spark.createDataFrame([(i, c - 2**64 if c >= 2**63 else c) for i, c in codes.items()], "id long, code long")
    found = topk_search.top_k(index, index.where("id % 20 = 0"), k, cell_rows)
    assert {tuple(r) for r in found.collect()} == brute(codes, [i for i in codes if i % 20 == 0], k)


def test_sign_codes_of_awkward_vectors(spark):
    rows = [(1, [1.0, -1.0, 0.0, float("nan")] + [0.0] * 60), (2, None), (None, [1.0] * 64), (3, [1.0] * 64), (4, [None, 2.0]), (5, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in CLASHING if c != "id"})
    codes = {r.id: r.code % 2**64 for r in topk_search.sign_codes(table).collect()}
    assert codes == {1: 1, 3: 2**64 - 1, 4: 2, 5: 0}
    found = topk_search.top_k(topk_search.sign_codes(table), topk_search.sign_codes(table), 2)
    assert found.count() == 8
    wide = spark.createDataFrame([(1, [1.0] * 65)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="more than 64 components"):
        topk_search.sign_codes(wide).collect()


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for operator in (packing.pack, mixing.schedule, mixing.take):
        assert operator(docs).collect() == []
    none = spark.createDataFrame([], "id long, code long")
    assert topk_search.top_k(none, none, 3).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCUMENTS)
    assert packing.pack(nulls).count() == 3 and mixing.schedule(nulls).count() == 0
