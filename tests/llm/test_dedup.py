"""SimHash classes, line dedup and substring dedup against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from cases import CLASHING, DOCUMENTS, classes, edge_rows, near_classes, prose, simhash, table_of, words
from conftest import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prospectrum.llm import components, line_dedup, oracles, queries as llm_queries, simhash as op4, substring_dedup


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    text = text.encode("utf-8", "ignore").decode()
    assert op4.fingerprint(text.encode()) == simhash(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_sliced_distances_are_exact(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2**64, 300, np.uint64, endpoint=False)
    for i in range(150):  # many within and about the radius
        flips = rng.choice(64, rng.integers(0, radius + 3), replace=False)
        fps[150 + i] = fps[i] ^ np.bitwise_or.reduce(np.array([1 << int(b) for b in flips] or [0], np.uint64))
    planes = op4.bit_planes(fps)
    words = np.arange(planes.shape[1])
    for q in fps[::17]:
        found = op4.within_radius(planes, words, np.full(len(words), q), radius)
        lanes = np.unpackbits(found.view(np.uint8), bitorder="little")[: len(fps)].astype(bool)
        assert (lanes == (np.bitwise_count(fps ^ q) <= radius)).all()


@pytest.mark.parametrize("size", [2, 40, 64, 65, 300])
def test_a_bucket_keeps_its_components(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 2**64, 5, np.uint64, endpoint=False)
    fps = np.array(sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for c in rng.choice(centres, size)}), np.uint64)
    a, b = op4.bucket_links(fps, np.array([0, len(fps)]), 4)
    root = {int(x): int(x) for x in fps} | {int(fps[i]): int(fps[j]) for i, j in zip(a, b, strict=True)}
    assert root == classes([int(x) for x in fps])


@pytest.mark.parametrize("bucket_rows", [8192, 4])
def test_near_duplicates_match_all_pairs(spark, bucket_rows):
    rows = edge_rows()
    found = op4.near_duplicates(table_of(spark, rows), bucket_rows=bucket_rows).collect()
    want = near_classes([r[:2] for r in rows])
    assert len(found) == len(rows)
    keyed = [r for r in found if r.doc_id is not None]
    assert {r.doc_id: r.component_id for r in keyed} == {k: v for k, v in want.items() if k is not None}
    assert {r.doc_id: r.fp % 2**64 for r in keyed} == {r[0]: simhash(r[1]) for r in rows if r[0] is not None}


@pytest.mark.parametrize("bucket_rows", [8192, 16])
def test_a_large_cluster_of_near_copies_is_one_class(spark, bucket_rows):
    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**63))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (120, 2))} | {int(x) for x in rng.integers(0, 2**63, 60)})
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in components.components(op4.links(nodes, bucket_rows=bucket_rows)).collect()}
    assert {x: roots.get(x, x) for x in fps} == classes(fps)


def test_one_document_of_each_class_stays(spark):
    rows = edge_rows()
    docs = table_of(spark, rows)
    kept = op4.keep_one(docs)
    assert kept.columns == docs.columns
    want = near_classes([r[:2] for r in rows])
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(r[0] for r in rows if r[0] is not None and want[r[0]] == r[0])
    assert kept.where("doc_id is null").count() == 2
    again = [(3, "one two three four five", None, None, None), (7, "one two three four five", None, None, None), (7, "others are these few words here", None, None, None)]
    assert sorted((r.doc_id, r.text) for r in op4.keep_one(table_of(spark, again)).collect()) == [(3, again[0][1]), (7, again[2][1])]
    assert kept.where("want <> 'own want'").count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 300)] + [(5, 5), (2, 1)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 300)}


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    """The awkward rows as a table for DuckDB, each key once."""
    rows = {r[0]: r for r in edge_rows() if r[0] is not None}
    folder = tmp_path_factory.mktemp("edge")
    table_of(spark, list(rows.values()), clashing=False).toPandas().to_parquet(folder / "documents.parquet")
    return str(folder)


def test_line_dedup_on_awkward_rows(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text")
    assert_same(line_dedup.dedup(docs, report=True), oracles.LINE_DEDUP, edge_dir)


def test_line_dedup_keeps_rows_and_columns(spark):
    docs = table_of(spark, edge_rows())
    cut = line_dedup.dedup(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.where("want <> 'own want' or __key <> 'own __key'").count() == 0


def test_line_dedup_finds_shifted_passages(spark):
    import random

    rng = random.Random(1)
    shared = prose(rng, 700)
    rows = [(i, prose(rng, 50 + 30 * i) + "\n" + shared + "\n" + prose(rng, 200), None, None, None) for i in range(6)]
    cut = {r.doc_id: r.text for r in line_dedup.dedup(table_of(spark, rows, False)).collect()}
    assert cut[0] == rows[0][1]
    for i in range(1, 6):
        gone = len(rows[i][1]) - len(cut[i])
        assert len(shared) <= gone < 1.2 * len(shared)


def test_short_passages_go_and_clean_texts_stay(spark):
    """Passages of two to six lines, each in several texts at other places."""
    rng = random.Random(6)
    names = [f"w{i}" for i in range(4000)]
    lines = lambda n: [" ".join(rng.choice(names) for _ in range(rng.randint(3, 9))) for _ in range(n)]
    planted, rows, of = [lines(2 + i % 5) for i in range(25)], [], {}
    for i in range(150):
        before, after = lines(rng.randint(1, 9)), lines(rng.randint(1, 9))
        middle = planted[i // 3 % 25] if i % 3 == 0 else []
        if i == 75:  # a blank line within the passage is part of it
            middle = [middle[0], "", *middle[1:]]
        of[i] = (before, middle, after)
        rows.append((i, "\n".join([*before, *middle, *after]), None, None, None))
    rows += [(1000 + i, "\n".join([f"def f{i}():", "    if x:", "        }", "    }", f"    return {i}"]), None, None, None) for i in range(9)]
    left = {r.doc_id: r.text for r in line_dedup.dedup(table_of(spark, rows, False)).collect()}
    for i, (before, _, after) in of.items():
        later = i % 3 == 0 and i > 75
        assert left[i] == ("\n".join([*before, *after]) if later else rows[i][1]), i
    assert all(left[1000 + i] == rows[150 + i][1] for i in range(9))


def test_pairs_inside_chunks_that_go_are_not_compared(spark):
    part = lambda kind, first, last, kept: (kind, first, last, kept)
    want = [part(0, 0, 3, False), part(0, 4, 6, False), part(1, 0, 1, False), part(1, 3, 4, False), part(1, 6, 7, False), part(1, 9, 10, False), part(1, 11, 12, True)]
    row = spark.createDataFrame([(want,)], "want array<struct<kind int, first int, last int, kept boolean>>").select(line_dedup._needed(F.col("want")).alias("n")).first().n
    assert sorted(map(tuple, row)) == sorted([want[0], want[1], want[4], want[5], want[6]])


def test_line_dedup_compares_bytes(spark, monkeypatch):
    """Under a digest that collides, chunks of other bytes stay."""
    monkeypatch.setattr(line_dedup, "digest", lambda b: F.lit("00" * 16))
    one, two = "a b c d\nc d", "e f\ng h i j"
    rows = [(1, one, None, None, None), (2, two, None, None, None), (3, one, None, None, None), (4, f"x\n{two}", None, None, None)]
    left = {r.doc_id: r.text for r in line_dedup.dedup(table_of(spark, rows, False)).collect()}
    assert left == {1: one, 2: two, 3: "", 4: f"x\n{two}"}


def test_substring_dedup_on_awkward_rows(spark, edge_dir, monkeypatch):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    monkeypatch.setattr(llm_queries, "table", lambda *_: docs)
    assert assert_same(llm_queries.op7_substring_dedup(spark, edge_dir), oracles.SUBSTRING_DEDUP, edge_dir) > 0


def plain_units(t: str) -> list[tuple[int, int]]:
    """Clauses with a word, long ones in pieces of twelve words."""
    out = []
    for m in re.finditer(f"[^{substring_dedup.MARKS}]+[{substring_dedup.MARKS}]*|[{substring_dedup.MARKS}]+", t):
        starts = [m.start() + w.start() for w in re.finditer("[^\x20\x09-\x0d]+", m.group())]
        edges = [m.start(), *(starts[12::12] if len(starts) > 20 else []), m.end()]
        out += list(zip(edges, edges[1:], strict=False)) if starts else []
    return out


def plain_substring_dedup(rows: list[tuple], min_words: int) -> dict[tuple, str]:
    """By (key, text) what is left: passages that came before, run by run, and
    the equal words beside a run and beside the place that stays."""
    distinct = sorted({(k, substring_hash(t), t) for k, t in rows if k is not None and t is not None})
    first, runs = {}, {}
    for k, h, t in distinct:
        units = plain_units(t)
        runs[k, h] = found = []
        for i in range(len(units)):
            j, n = i, 0
            while n < min_words and j < len(units):
                n += len(words(t[slice(*units[j])]))
                j += 1
            if n < min_words:
                break
            start, end = units[i][0], units[j - 1][1]
            kept = first.setdefault(tuple(words(t[start:end].lower())), (t, start, end, k, h))
            if kept == (t, start, end, k, h):
                continue
            if found and start < found[-1][1]:
                found[-1][1], found[-1][3] = end, kept
            else:
                found.append([start, end, kept, kept])
    out, of = {}, lambda x: [(w.group().lower(), w.start(), w.end()) for w in re.finditer("[^\x20\x09-\x0d]+", x)]
    for k, h, t in distinct:
        gone = set()
        for start, end, left, right in runs[k, h]:
            same = 0
            for (x, s, _), (y, _, _) in zip(of(t[:start])[::-1][:40], of(left[0][: left[1]])[::-1], strict=False):
                if x != y:
                    break
                same = start - s
            more = 0
            for (x, _, e), (y, _, _) in zip(of(t[end:])[:40], of(right[0][right[2] :]), strict=False):
                if x != y:
                    break
                more = e
            gone.update(range(start - same, end + more))
        out[k, t] = "".join(c for i, c in enumerate(t) if i not in gone)
    return out


def substring_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(text.encode(), 42) >> 63 else 0)


@pytest.mark.parametrize("min_words", [1, 6, 25])
def test_substring_remove_matches_a_plain_version(spark, min_words):
    """All awkward rows, repeated keys with other texts among them."""
    rows = edge_rows()
    left = substring_dedup.remove(table_of(spark, rows), min_words=min_words)
    assert left.columns == table_of(spark, rows).columns
    want = plain_substring_dedup([r[:2] for r in rows], min_words)
    got = sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id is not None and r.text is not None)
    assert got == sorted((r[0], want[r[0], r[1]]) for r in rows if r[0] is not None and r[1] is not None)
    nulls = Counter((r[0], r[1]) for r in rows if r[0] is None or r[1] is None)
    assert Counter((r.doc_id, r.text) for r in left.collect() if r.doc_id is None or r.text is None) == nulls
    assert left.where("__key <> 'own __key' or h <> 'own h'").isEmpty()


def test_runs_are_longer_by_the_equal_words_beside_them(spark):
    """Half clauses at both ends go, up to the first other word; words of one
    long clause and of one repeated word go too."""
    rng = random.Random(12)
    w = [f"w{i}" for i in range(400)]
    inner = " ".join(w[:8]) + ", " + " ".join(w[8:40]) + ". " + " ".join(w[40:50])
    one = "x1 x2 " + inner + " y1 y2"
    two = f"z1 Z2 {inner.upper()}  q1 q2. " + " ".join(rng.sample(w[100:], 40))
    rows = [(1, one, None, None, None), (2, two, None, None, None), (3, " ".join(w[200:260]), None, None, None), (4, "a b c " + " ".join(w[203:258]) + " d e", None, None, None), (5, "spam " * 300, None, None, None), (6, "ham " + "spam " * 200, None, None, None)]
    left = {r.doc_id: r.text for r in substring_dedup.remove(table_of(spark, rows, False)).collect()}
    assert left[1] == one and left[2] == two.replace(inner.upper(), "") and left[3] == rows[2][1]
    assert len(words(left[5])) <= 36 and len(words(left[6])) <= 37 and left[6].startswith("ham")
    found = {(r.doc_id, r.kept_doc_id, r.kept_start) for r in substring_dedup.removals(table_of(spark, rows[:2], False)).collect()}
    assert found == {(2, 1, one.index("w0"))}


def test_two_texts_under_one_key_lose_only_their_own_passages(spark):
    rng = random.Random(2)
    a, b, c = (prose(rng, 60).replace("\n", " ") + "." for _ in range(3))
    rows = [(1, a, None, None, None), (2, f"{b}\n{a}", None, None, None), (2, f"{c}\n{b} more", None, None, None)]
    left = sorted(r.text for r in substring_dedup.remove(table_of(spark, rows)).collect())
    assert a in left and not any(a in t for t in left if t != a)
    assert sum(b in t for t in left) == 1 and sum(c in t for t in left) == 1


def test_substring_spans_are_the_original_text(spark):
    rows = edge_rows()
    texts = {(r[0], substring_hash(r[1])): r[1] for r in rows if r[1] is not None}
    found = substring_dedup.removals(table_of(spark, rows)).collect()
    for r in found:
        gone = texts[r.doc_id, r.text_hash][r.start : r.end].lower().split()[:25]
        kept = [t[r.kept_start :].lower().split()[:25] for (k, _), t in texts.items() if k == r.kept_doc_id]
        assert gone in kept and (r.kept_doc_id, r.kept_start) < (r.doc_id, r.start)
    assert found


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of 51 to 120 words inside lines of other texts, between clauses
    or in the middle of them, some wrapped at seven words a line."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(names) + (rng.choice(".,") if rng.random() < 0.12 else "") for _ in range(n))
    wrapped = lambda t: "\n".join(" ".join(t.split()[i : i + 7]) for i in range(0, len(t.split()), 7))
    planted = [text(rng.randint(51, 120)) for _ in range(30)]
    rows, of = [], {}
    for i in range(400):
        before, after = text(rng.randint(30, 200)), text(rng.randint(30, 200))
        if i % 4 == 0:
            passage = planted[i // 4 % 30]
            of[i] = passage
            passage = passage if i % 8 else passage.upper()
            rows.append((i, f"{before} {passage} {after}" if i % 3 else f"{before}. {passage}. {after}", None, None, None))
        elif i % 4 == 1 and i < 120:
            rows.append((i, f"{before}\n{wrapped(planted[0])}\n{after}", None, None, None))
        else:
            rows.append((i, f"{before} {after}", None, None, None))
    left = {r.doc_id: r.text for r in substring_dedup.remove(table_of(spark, rows, False)).collect()}
    caught, total = Counter(), Counter()
    for i, passage in of.items():
        if i >= 120:  # the first 30 are the earliest of each
            there = " ".join(left[i].lower().split())
            here = passage.lower().split()
            caught[i % 3 > 0] += sum(" ".join(here[j : j + 4]) not in there for j in range(len(here) - 3))
            total[i % 3 > 0] += len(here) - 3
    assert caught[False] / total[False] >= 0.97 and caught[True] / total[True] >= 0.97
    clean = [r for r in rows if r[0] not in of and not (r[0] % 4 == 1 and r[0] < 120)]
    assert all(left[r[0]] == r[1] for r in clean)
    assert all(left[i] == rows[i][1] for i in of if i < 120)


@pytest.mark.parametrize("operator", [op4.near_duplicates, op4.keep_one, line_dedup.dedup, substring_dedup.removals, substring_dedup.remove])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCUMENTS)).collect() == []
    nothing = spark.createDataFrame([(None, None, None, None, None)] * 3, DOCUMENTS).withColumns({c: F.lit(1) for c in CLASHING})
    assert operator(nothing).count() in (0, 3)
