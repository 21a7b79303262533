"""Operators 11 to 13 against plain versions, round trips and awkward inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from base64 import b32encode
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import edge_rows, table_of
from pyspark.sql import functions as F

from prospectrum.llm import centroids, resampling, warc

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text: str | None, max_n: int = 1) -> list[str]:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def buckets(text: str | None, max_n: int, n: int) -> list[int]:
    return [zlib.crc32(f.encode()) % n for f in features(text, max_n)]


def resampled(rows: list[tuple], target: list[str | None], max_n: int, n: int, min_words: int, percent: int) -> Counter:
    """All result rows, by a sort of everything."""
    of = [buckets(t, max_n, n) for _, t in rows]
    s, t = Counter(b for x in of for b in x), Counter(b for x in target for b in buckets(x, max_n, n))
    all_s, all_t = sum(s.values()) + n, sum(t.values()) + n
    gain = [math.floor(1000 * math.log((t[i] + 1) * all_s / ((s[i] + 1) * all_t))) for i in range(n)]
    found = []
    for (key, text), x in zip(rows, of, strict=True):
        weight = sum(gain[b] for b in x) // len(x) if x else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        found.append([key, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text))])
    fit = sorted((r for r in found if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = i + 1
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize(("max_n", "n", "min_words", "percent"), [(1, 10_000, 20, 10), (3, 97, 1, 50), (2, 64, 0, 100)])
def test_resampling_equals_a_sort_of_all_rows(spark, max_n, n, min_words, percent):
    rows = edge_rows() + [(77, edge_rows()[15][1], None, None, 0)] * 40 + [(-5, "MiXed-Case wörds_and 0xff " * 9, None, None, 0), (1 << 62, "y" * 3000 + " z" * 30, None, None, 0), (-(1 << 62), "a b " * 30, None, None, 0)]
    target = [rows[12][1], None, "", rows[9][1]]
    docs = table_of(spark, rows).repartition(5)
    found = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=max_n, buckets=n, min_words=min_words, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == resampled([r[:2] for r in rows], target, max_n, n, min_words, percent)


def test_checksums_of_spans_are_those_of_zlib():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 47, 48, 49, 50, 300, *range(1, 40)]]
    rng.shuffle(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    found = resampling.crc32_spans(data, ends - [len(t) for t in texts], ends)
    assert found.tolist() == [zlib.crc32(t) for t in texts]


@pytest.mark.parametrize("wide", [False, True])
def test_the_kth_key_is_that_of_a_sort(spark, wide):
    rng = random.Random(6)
    id_of = (lambda: rng.choice([-(1 << 63), (1 << 63) - 1, 5, -7, rng.randrange(-(1 << 63), 1 << 63)])) if wide else (lambda: rng.randrange(90_000, 300_000))
    rows = [(rng.randrange(-5, 5) * 40_000, rng.choice([id_of(), id_of(), None])) for _ in range(300)] + [(0, 100_000)] * 50
    df = spark.createDataFrame(rows, "score long, id long").repartition(3)
    order = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    for k in (1, 2, 100, 175, 349, 350):
        assert resampling.kth_key(df, k) == order[k - 1]
    assert resampling.kth_key(df, 0) is None and resampling.kth_key(df, 351) is None


def test_resampling_of_nothing(spark):
    empty = table_of(spark, [])
    target = spark.createDataFrame([], "text string")
    assert resampling.resample(empty, target).collect() == []
    alone = resampling.resample(table_of(spark, [(1, "one two", None, None, 0)]), target, min_words=1, percent=100).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in alone] == [(1, 2, 1)]


PAGES = "page_id long, url string, html string, key string, first string, n string"


def page_rows() -> list[tuple]:
    rng = random.Random(8)
    bodies = ["<p>" + " ".join(rng.choice(["alpha", "beta", "ünï", "漢字"]) for _ in range(n)) + "</p>" for n in [3, 50, 400, 5000]]
    rows = [(i, f"https://a.example/{i}?q=ü x", bodies[i % 4], "own", "own", "own") for i in range(3, 40)]
    rows += [(100, None, None, None, None, None), (101, "", "", None, None, None), (102, "http://x/\r\nX: y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc", None, None, None)]
    rows += [(103, "u", "\x1f\x08 \r\n\r\n", None, None, None), (None, "u", bodies[0], None, None, None), (None, "u", "only null keys", None, None, None), (None, "v", "only null keys", None, None, None)]
    return rows + [rows[0], rows[5]] + [(200, "big", "long text " * 300_000, None, None, None)]


def archived(rows: list[tuple], min_bytes: int) -> Counter:
    first: dict[bytes, int] = {}
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        if key is not None and len(body) >= min_bytes:
            first[body] = min(first.get(body, key), key)
    out = []
    for key, _, html, *_ in rows:
        body = (html or "").encode()
        at = first.get(body)
        again = at is not None and key != at
        out.append((key, len(body), b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", at if again else None))
    return Counter(out)


@pytest.mark.parametrize("min_bytes", [0, 300])
def test_archives_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    found = warc.round_trip(pages, min_bytes=min_bytes)
    assert Counter(map(tuple, found.collect())) == archived(page_rows(), min_bytes)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_text_keys_survive(spark):
    keys = ["a:b", "c d", "100%", "ü/+&", "", "x+y"]
    found = warc.round_trip(spark.createDataFrame([(k, "u", f"body {i % 2}") for i, k in enumerate(keys)], "page_id string, url string, html string"))
    first = {k: min(keys[i % 2 :: 2]) for i, k in enumerate(keys)}
    assert {r.page_id: r.refers_to for r in found.collect()} == {k: None if k == f else f for k, f in first.items()}


@pytest.mark.parametrize("split", [97, 4096, 1 << 20])
def test_every_range_size_reads_each_record_once(spark, split):
    rows = page_rows()[:40]
    files = warc.write(spark.createDataFrame(rows, PAGES).coalesce(2), file_bytes=9000)
    assert files.count() > 2 and files.agg(F.sum("records")).first()[0] == 40
    back = warc.read(spark, files, split_bytes=split).where("record_type <> 'warcinfo'").collect()
    assert Counter(warc.key_of(r.record_id) for r in back) == Counter(str(r[0]) for r in rows)
    stored = [r for r in back if r.record_type == "response"]
    assert all(r.intact and len(r.payload) == r.payload_bytes for r in stored)
    by_digest = {r.payload_digest: bytes(r.payload).decode() for r in stored}
    assert all(by_digest[b32encode(hashlib.sha1((r[2] or "").encode()).digest()).decode()] == (r[2] or "") for r in rows)


def archive(tmp_path, name: str, data: bytes):
    (tmp_path / name).write_bytes(data)


def test_an_archive_in_an_archive_is_a_payload(spark, tmp_path):
    """Members stored inside a record are not records, wherever a range starts."""
    inner = b"".join(warc.page_member(f"in{i}", "u", bytes(60), warc.base32_sha1(bytes(60)), None, False, "1970") for i in range(30))
    outer = b"".join(warc.member([("WARC-Type", "resource"), ("WARC-Record-ID", f"<urn:out:{i}>"), ("Content-Type", "application/gzip")], inner, level=0) for i in range(3))
    archive(tmp_path, "nested.warc.gz", outer)
    for split in (64, 500, 3000, 10**6):
        back = warc.read(spark, warc.listed(spark, str(tmp_path)), split_bytes=split).collect()
        assert sorted(r.record_id for r in back) == ["urn:out:0", "urn:out:1", "urn:out:2"], split
        assert all(bytes(r.payload) == inner for r in back)


def test_damaged_archives_give_the_whole_records(spark, tmp_path):
    one = [warc.page_member(str(i), "u", f"body {i}".encode() * 40, warc.base32_sha1(f"body {i}".encode() * 40), None, False, "1970") for i in range(6)]
    broken = bytearray(one[2])
    broken[len(broken) // 2] ^= 0xFF
    wrong = warc.page_member("9", "u", b"other", warc.base32_sha1(b"not it"), None, False, "1970")
    archive(tmp_path, "a.warc.gz", one[0] + b"noise \x1f\x8b\x08 noise" + one[1] + bytes(broken) + one[3] + zlib.compress(b"x") + wrong + one[4] + one[5][:-4])
    archive(tmp_path, "empty.warc.gz", b"")
    for split in (50, 10**6):
        back = warc.read(spark, warc.listed(spark, str(tmp_path)), split_bytes=split).collect()
        assert sorted((warc.key_of(r.record_id), r.intact) for r in back) == [("0", True), ("1", True), ("3", True), ("4", True), ("9", False)]


def test_members_hold_several_records_and_folded_headers():
    two = b"WARC/1.0\r\nWARC-Type: metadata\r\nX-Long: a\r\n b\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n" * 2
    found = warc.records(two)
    assert [b for _, b in found] == [b"hi", b"hi"] and found[0][0]["x-long"] == "a b"
    assert warc.records(two[:-8]) is None and warc.records(b"WARC/1.0\r\nContent-Length: x\r\n\r\n") is None and warc.records(b"") is None


VECTORS = "vec_id long, embedding array<float>, cluster string, id string, v string"


def clustered(rows: list[tuple], dims: int, scale: int, k: int, rounds: int) -> Counter:
    """Lloyd's rounds in Python's integers."""
    kept = [(key, [math.floor(scale * float(np.float32(x))) for x in v]) for key, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    means = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(means))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), c in zip(kept, of, strict=True) if c == i] for i in range(len(means))]
        means = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else m for g, m in zip(groups, means, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, c in last if c == i) for i in range(len(means))]
    fits = lambda x: x if x < 1 << 63 else None
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return Counter((key, c, fits(d), fits(inertia[c]) if all(fits(x) is not None for x, i in last if i == c) else None, fits(sum(inertia)) if all(fits(x) is not None for x, _ in last) else None, name[c]) for (key, _), (d, c) in zip(kept, last, strict=True))


def vector_rows(size: float, n: int = 300) -> list[tuple]:
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(0, 1) * size)) for _ in range(5)], "own", "own", "own") for i in range(n)]
    rows += [(900, None, None, None, None), (901, [], None, None, None), (902, [1.0] * 4, None, None, None), (903, [1.0, None, 1.0, 1.0, 1.0], None, None, None)]
    rows += [(904, [math.nan, 1.0, 1.0, 1.0, 1.0], None, None, None), (905, [math.inf, 1.0, 1.0, 1.0, 1.0], None, None, None), (906, [-math.inf] * 5, None, None, None)]
    return rows + [rows[3]] * 100 + [(None, rows[4][1], None, None, None), (3, rows[7][1], None, None, None)]


@pytest.mark.parametrize("size", [1.0, 3e6, 1e9, 1e30])
def test_clusters_are_exact_at_every_magnitude(spark, size):
    """float64, 64-bit and unbounded integers all give the exact result."""
    rows = vector_rows(size)
    found = centroids.report(spark.createDataFrame(rows, VECTORS).repartition(4), dims=5, clusters=7)
    assert Counter(map(tuple, found.collect())) == clustered(rows, 5, 64, 7, 3)


def test_few_vectors_and_none(spark):
    rows = vector_rows(1.0, 8)
    few = [r for r in rows if r[0] in (1, 2)] + rows[8:15]
    found = centroids.report(spark.createDataFrame(few, VECTORS), dims=5, clusters=7)
    assert Counter(map(tuple, found.collect())) == clustered(few, 5, 64, 7, 3)
    assert centroids.report(spark.createDataFrame(rows[8:15], VECTORS), dims=5).collect() == []


def test_distances_in_all_three_arithmetics_agree():
    rng = np.random.default_rng(1)
    x, c = rng.integers(-2000, 2000, (50, 64)).astype(float), rng.integers(-2000, 2000, (16, 64)).tolist()
    want = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(2)
    found = centroids.distances(x, c)
    assert found.dtype == np.int64 and (found == want).all()
    for shift in (1 << 22, 1 << 40):
        far = centroids.distances(x + shift, (np.array(c, object) + shift).tolist())
        assert (far == want).all()


def test_records_of_a_stream_cross_its_chunks(monkeypatch):
    monkeypatch.setattr(warc, "_CHUNK", 64)
    monkeypatch.setattr(warc, "_STEP", 16)
    data = b"".join(warc.page_member(str(i), "u", random.Random(i).randbytes(i * 7), "D", None, False, "1970") for i in range(30))
    for start, end in [(0, len(data)), (1, len(data)), (100, 900)]:
        found = [at for at, _, _ in warc.members(pa.BufferReader(data), start, end, len(data))]
        whole = [at for at, _, _ in warc.members(pa.BufferReader(data), 0, len(data), len(data))]
        assert len(whole) == 30 and found == [at for at in whole if start <= at < end]
