"""Near duplicates by SimHash, compared bit-sliced.

1. Each whole text becomes a 64-bit fingerprint: the bitwise majority of the
   XXH64 values (seed 42) of its word shingles, repeats counted.
2. Equal fingerprints are one node, so copies cost one comparison.
3. Two fingerprints within ``radius`` bits agree on at least
   ``segments - radius`` of ``segments`` bit segments; each choice of that
   many segments is a table, whose key is the bits chosen. No link is lost.
4. The nodes of one key are compared bit-sliced: bit planes are stored
   vertically, 64 fingerprints a word; carry-save counters add up to 64
   distances at once, and words in which all lanes exceed the radius are
   abandoned. Only a spanning forest of each key's links leaves the task.
5. Components of the links give each document its class.

A key with over ``bucket_rows`` nodes is not held in one task: its rows are
dealt into chunks, and every pair of chunks becomes a bucket of its own.

Defined results: a null or wordless text has fingerprint zero and links like
any other; a text of fewer words than a shingle is one shingle; repeated rows
stay; a null key keeps its row and never names a component; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written
from prospectrum.llm.components import components
from prospectrum.llm.textblock import blocks

SHINGLE_WORDS, RADIUS, SEGMENTS, BUCKET_ROWS = 4, 4, 6, 8192
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = 64
#: Cells (a query and a word of 64 lanes) compared at once; they fit a CPU cache.
_CELLS = 1 << 13


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one UTF-8 text."""
    words = text.translate(_ASCII_LOWER).split()  # bytes.split() takes 0x20, 0x09-0x0D
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: n - shingle_words + 1].tolist(), ends[shingle_words - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(key, h, fp): h is the text's hash, fp the fingerprint as a signed long."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    schema = rows.select("key", "h").schema.add("fp", "long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b in blocks(batch.column(2)):
                data, at = b.data.tobytes(), b.offsets.tolist()
                fps = np.array([fingerprint(data[s:e], shingle_words) for s, e in zip(at, at[1:], strict=False)], np.uint64)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(row, end - row) for i in (0, 1)), pa.array(fps.view(np.int64))], names=schema.names)

    return rows.mapInArrow(hashed, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Fingerprints stored vertically: plane p, word w holds bit p of 64 of them."""
    padded = np.zeros(-(-len(fps) // _LANES) * _LANES, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    above, equal = over.copy(), ~over
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            equal &= counters[i]
        else:
            above |= equal & counters[i]
            equal &= ~counters[i]
    return above


def within_radius(planes: np.ndarray, words: np.ndarray, queries: np.ndarray, radius: int) -> np.ndarray:
    """For each cell, a query against the 64 lanes of a word: the lanes whose
    distance is at most the radius. Counters are bit-sliced too; two planes
    are added in one carry-save step, and abandoned cells leave the work."""
    found = np.zeros(len(words), np.uint64)
    cells, zero = np.arange(len(words)), np.zeros(len(words), np.uint64)
    counters, over = [zero.copy() for _ in range(max(1, radius.bit_length()))], zero.copy()
    for p in range(0, 64, 2):
        x, y = (planes[q][words] ^ (np.uint64(0) - ((queries >> np.uint64(q)) & np.uint64(1))) for q in (p, p + 1))
        odd = x ^ y
        carry = (x & y) | (odd & counters[0])
        counters[0] = odd ^ counters[0]
        for i in range(1, len(counters)):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over = over | carry
        if p % 8 == 6 and p < 62:
            alive = ~_exceeds(counters, over, radius) != 0
            if not alive.any():
                return found
            if alive.mean() < 0.7:
                cells, words, queries, over = cells[alive], words[alive], queries[alive], over[alive]
                counters = [c[alive] for c in counters]
    found[cells] = ~_exceeds(counters, over, radius)
    return found


def _small_buckets(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of buckets of up to 64 rows, each in one word: (row, smallest row linked)."""
    bucket = np.repeat(np.arange(len(first)), size)
    lane = np.arange(len(bucket)) - np.repeat(np.cumsum(size) - size, size)
    rows = first[bucket] + lane
    padded = np.zeros((len(first), _LANES), np.uint64)
    padded[bucket, lane] = fps[rows]
    planes = bit_planes(padded.ravel())
    reach = np.concatenate([within_radius(planes, bucket[i : i + _CELLS], fps[rows[i : i + _CELLS]], radius) for i in range(0, len(rows), _CELLS)])
    reach &= (~np.uint64(0)) >> (np.uint64(_LANES) - size[bucket].astype(np.uint64))
    start = np.cumsum(size) - size
    for k in range(int(size.max())):  # transitive closure, lane by lane
        via = (size[bucket] > k) & ((reach >> np.uint64(k)) & np.uint64(1)).astype(bool)
        reach[via] |= reach[start[bucket[via]] + k]
    lowest = np.bitwise_count((reach & (np.uint64(0) - reach)) - np.uint64(1)).astype(np.int64)
    return rows, first[bucket] + lowest


def _large_bucket(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each row of a bucket, the smallest row of its component."""
    n, planes = len(fps), bit_planes(fps)
    label, per = np.arange(n), max(1, _CELLS // planes.shape[1])
    for at in range(0, n, per):
        queries = fps[at : at + per]
        words = np.arange(at // _LANES, planes.shape[1])
        found = within_radius(planes, np.tile(words, len(queries)), np.repeat(queries, len(words)), radius)
        near = np.unpackbits(found.view(np.uint8).reshape(len(queries), -1), axis=1, bitorder="little").view(bool)
        for i in range(len(queries)):
            linked = label[words[0] * _LANES + np.flatnonzero(near[i, : n - words[0] * _LANES])]
            if (linked != label[at + i]).any():
                roots = np.unique(np.append(linked, label[at + i]))
                label[np.isin(label, roots)] = roots[0]
    return label


def bucket_links(fps: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links inside buckets: rows sorted by bucket, runs holds the
    bucket bounds. Returns (row, smallest row of its component in the bucket)."""
    first, size = runs[:-1], np.diff(runs)
    out = []
    few = (size > 1) & (size <= _LANES)
    if few.any():
        out.append(_small_buckets(fps, first[few], size[few], radius))
    for s, n in zip(first[size > _LANES], size[size > _LANES], strict=True):
        out.append((s + np.arange(n), s + _large_bucket(fps[s : s + n], radius)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, least = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows[rows != least], least[rows != least]


def _compare(radius: int, bucket_rows: int):
    """Streams sorted (key, part, fp) rows; yields links (a, b) and, with their
    key, the rows of buckets that are too large for one task."""

    def links(key: np.ndarray, part: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        new = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
        a, b = bucket_links(fps, np.concatenate([[0], new, [len(key)]]), radius)
        return batch(None, fps[a], fps[b]) if len(a) else None

    def batch(key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        k = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
        return pa.RecordBatch.from_arrays([k, pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], names=["key", "a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, put_off = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)], None
        for rows in batches:
            now = [rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(2).to_numpy().view(np.uint64)]
            if not len(now[0]):
                continue
            if put_off is not None:  # the rest of a bucket found too large
                rest = int(np.searchsorted(now[0] != put_off, True))
                if rest:
                    yield batch(now[0][:rest], now[2][:rest], None)
                if rest == len(now[0]):
                    continue
                put_off, now = None, [x[rest:] for x in now]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)]
            new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            bounds = np.concatenate([[0], new])
            size = np.diff(np.append(bounds, len(held[0])))
            if bucket_rows and (size > bucket_rows).any():
                large = np.repeat(size > bucket_rows, size)
                yield batch(held[0][large], held[2][large], None)
                if size[-1] > bucket_rows:
                    put_off, last = held[0][-1], len(held[0])
                done = ~large[:last]
                ready = [x[:last][done] for x in held]
            else:
                ready = [x[:last] for x in held]
            held = [x[last:] for x in held]
            if len(ready[0]) and (out := links(*ready)) is not None:
                yield out
        if len(held[0]) and (out := links(*held)) is not None:
            yield out

    return compared


def _segment_keys(radius: int, segments: int) -> list:
    """An expression for each table: its number and the chosen bits, in a long."""
    width = [64 // segments + (i < 64 % segments) for i in range(segments)]
    start = [sum(width[:i]) for i in range(segments)]
    keys = []
    for t, chosen in enumerate(combinations(range(segments), segments - radius)):
        key, used = F.lit(0).cast("long"), 0
        for i in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", start[i]).bitwiseAND(F.lit((1 << width[i]) - 1)), used))
            used += width[i]
        keys.append(key.bitwiseOR(F.lit(t << used)))
    return keys


def links(nodes: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b) fingerprints within the radius: enough to join all that are linked.

    nodes: distinct fingerprints in a long column fp.
    """
    keyed = nodes.select("fp", F.explode(F.array(*_segment_keys(radius, segments))).alias("key"))
    dealt = keyed.select("key", F.lit(0).cast("long").alias("part"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    schema = "key long, a long, b long"
    first = written(dealt.mapInArrow(_compare(radius, bucket_rows), schema), "links")
    found, large = first.where("b is not null").select("a", "b"), first.where("b is null").select("key", F.col("a").alias("fp"))
    sizes = written(large.groupBy("key").agg(F.ceil(F.count("*") / bucket_rows).alias("k")), "large-keys")
    if sizes.isEmpty():
        return found
    chunked = large.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")))
    pairs = chunked.select("key", "k", "c", "fp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("d"))
    pairs = pairs.select("key", (F.least("c", "d") * F.col("k") + F.greatest("c", "d")).alias("part"), "fp")
    rest = pairs.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(_compare(radius, 0), schema)
    return found.unionByName(written(rest, "large-links").select("a", "b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, segments: int = SEGMENTS, shingle_words: int = SHINGLE_WORDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, h, fp, component_id) of every row."""
    prints = written(fingerprints(docs, key, text, shingle_words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "nodes")
    roots = components(links(nodes.select("fp"), radius, segments, bucket_rows))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(named, "fp").select("key", "h", "fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", **params) -> DataFrame:
    """(key, fp, component_id): component_id is the smallest key among the
    documents that links reach, the document itself included."""
    return classes(docs, key, **params).select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", **params) -> DataFrame:
    """One document of each class of near duplicates, that with the smallest
    key, with all columns. Rows with a null key stay, as do rows that repeat
    the key that stays in its class; texts that share a key go one by one."""
    gone = written(classes(docs, key, **params).where("key > component_id").select(F.col("key").alias("__key"), F.col("h").alias("__h")).distinct(), "near-copies")
    return docs.join(gone.hint("merge"), (docs[key] == gone["__key"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti").select(docs.columns)
