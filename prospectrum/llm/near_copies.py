"""Near copies by the Jaccard similarity of their sets of word shingles.

The classes of operator 4 (SimHash) give the first candidates: each document
against the first one of its class. A fingerprint of 64 bits can't tell similarity 0.8 apart: such
pairs differ in 5 to 12 bits mostly, and tables for that many bits hold most of
the documents. So further candidates come from min-hashes, and the sets themselves decide.

0. With ``groups`` (classes of operator 4), the nodes of a class are compared with
   the node of its first document, and those that are similar enough go.
1. A text's set holds 64-bit hashes of its shingles of ``SHINGLE_WORDS`` words
   (ASCII letters in lower case). Texts of equal sets are one node.
2. ``BANDS`` times ``BAND_ROWS`` min-hashes put each node into a bucket of
   every band. A pair of similarity s shares a bucket with the probability
   1 - (1 - s ** BAND_ROWS) ** BANDS, 0.9993 at 0.8.
3. In a bucket of up to ``FEW`` nodes all pairs are compared, by whole sets. In
   a larger one the smallest node is compared with all others. Those that are
   similar enough go, so copies of one text leave after few pairs.
4. What is left of the larger buckets meets by rare shingles. In an order by
   frequency, of two sets that are similar enough the greater one's first fifth
   and the smaller one's first ninth share a shingle, at places that leave room
   for the overlap (prefix and position filters, both exact for ``SIMILARITY``). First each
   shingle's smallest node is compared with the others, then all pairs that
   pass the filters. So unlike nodes of a bucket are told apart by where their
   own shingles stand, not pair by pair.

So a document goes only for a smaller one of similarity ``SIMILARITY`` or more,
and of two similar ones that share a bucket at most one stays.

Defined results: texts without a word are equal; a text of fewer words than a
shingle is one shingle; rows that repeat the key that stays stay; rows with a
null key stay and are compared with nothing; an empty table gives an empty
result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from prospectrum.llm.common import written
from prospectrum.llm.textblock import TextBlock, blocks, mix

SHINGLE_WORDS, SIMILARITY, BANDS, BAND_ROWS = 5, 0.8, 24, 6
FEW = 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _factors(n: int) -> np.ndarray:
    """Pairs (odd factor, summand) of n hash functions of 32 bits."""
    drawn = np.random.default_rng(20240805).integers(0, 2**32, (n, 2), np.uint32)
    drawn[:, 0] |= np.uint32(1)
    return drawn


def shingles(b: TextBlock, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, repeats included, and their bounds by text."""
    words = TextBlock(_LOWER[b.data], b.offsets)
    hashes, ends = words.word_hashes, np.cumsum(words.n_words)
    at, last = np.arange(len(hashes)), np.repeat(ends, words.n_words)
    first = np.repeat(ends - words.n_words, words.n_words)
    starts = at[(at + n <= last) | (at == first)]
    out, stop = np.zeros(len(starts), np.uint64), last[starts]
    for j in range(n):
        here = starts + j
        out = mix(out * _STEP + np.where(here < stop, hashes[np.minimum(here, max(len(hashes) - 1, 0))], np.uint64(0)) + np.uint64(j + 1))
    return out, np.concatenate([[0], np.cumsum(np.where(words.n_words, np.maximum(words.n_words - n + 1, 1), 0))])


def bucket_keys(hashes: np.ndarray, bounds: np.ndarray, bands: int = BANDS, band_rows: int = BAND_ROWS) -> np.ndarray:
    """A row of bucket keys, one for each band, for each text that has a shingle."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out, low = np.zeros((len(starts), bands), np.uint64), (hashes >> np.uint64(32)).astype(np.uint32)
    if len(starts):
        for i, (factor, summand) in enumerate(_factors(bands * band_rows)):
            band = i // band_rows
            out[:, band] = mix(out[:, band] * _STEP + np.minimum.reduceat(low * factor + summand, starts) + np.uint64(band))
    return out


def _node(distinct: np.ndarray) -> int:
    return int.from_bytes(md5(distinct.tobytes(), usedforsecurity=False).digest()[:8], "little", signed=True)


def sketches(docs: DataFrame, key: str, text: str, with_sets: bool = False) -> DataFrame:
    """(key, h, node, values) of every row: h is the hash of the text, values
    are the bucket keys or, with_sets, the shingles."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    schema = rows.select("key", "h").schema.add("node", "long").add("values", ArrayType(LongType()))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, b in blocks(batch.column(2)):
                hashes, bounds = shingles(b)
                sets = [np.unique(hashes[s:e]) for s, e in zip(bounds, bounds[1:], strict=False)]
                if with_sets:
                    sizes, values = [len(x) for x in sets], np.concatenate(sets)
                else:
                    values = bucket_keys(hashes, bounds)
                    sizes, values = np.where(np.diff(bounds) > 0, values.shape[1], 0), values.ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.astype(np.uint64).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), pa.array(list(map(_node, sets)), pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(made, schema)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The nodes a of the pairs (a, b) whose sets are similar enough."""
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("values").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("values").alias("y")), "b")
    sized = met.select("a", F.size("x").alias("n"), F.size("y").alias("m"), F.size(F.array_intersect("x", "y")).alias("both"))
    return sized.where(F.col("both") + 1e-9 >= (F.col("n") + F.col("m") - F.col("both")) * similarity).select("a").distinct()


def _sets(docs: DataFrame, keyed: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node, values): the sets of nodes, read from one text each."""
    firsts = keyed.groupBy("node").agg(F.min(F.struct("key", "h")).alias("r"))  # copies are combined before they move
    one = firsts.join(nodes.distinct(), "node", "left_semi").select(F.col("r.key").alias("key"), F.col("r.h").alias("h"))
    whole = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    chosen = whole.join(one, ["key", "h"], "left_semi")
    return written(sketches(chosen, "key", "text", with_sets=True).groupBy("node").agg(F.min("values").alias("values")), "sets")


def _rare_first(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(token, node, first, n, i): of each set of n shingles those in its prefix
    that other sets have too, i being the place in an order by frequency."""
    each = written(sets.join(nodes, "node", "left_semi").select("node", F.explode("values").alias("token")), "tokens")
    counted = each.join(each.groupBy("token").agg(F.count("*").alias("f")), "token")
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("s")).withColumn("n", F.size("s"))
    prefix = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * similarity - 1e-6) + 1).cast("int"))
    placed = ordered.select("node", "n", F.posexplode(prefix).alias("i", "x")).where("x.f > 1")
    return written(placed.join(nodes, "node").select("x.token", "node", "first", "n", "i"), "rare")


def _fits(x: str, y: str, similarity: float) -> Column:
    """Whether sets x and y, that share the shingle at these places and none before, can be similar enough."""
    n, i, m, j = (F.col(c) for c in (f"{x}.n", f"{x}.i", f"{y}.n", f"{y}.i"))
    return F.least(n - i, m - j) + 1e-6 >= (n + m) * (similarity / (1 + similarity))


def rest_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> Iterator[DataFrame]:
    """The nodes (node, first) that are similar to one with a smaller first: those
    found by the smallest node of each shingle, then of the rest all others."""
    rare = _rare_first(nodes, sets, similarity)
    heads = rare.groupBy("token").agg(F.min(F.struct("first", "node", "n", "i")).alias("p"), F.count("*").alias("sets")).where("sets > 1")
    star = rare.alias("x").join(heads, "token").where((F.col("first") > F.col("p.first")) & _fits("x", "p", similarity))
    near = written(_similar(written(star.select(F.col("node").alias("a"), F.col("p.node").alias("b")).distinct(), "pairs"), sets, similarity).withColumnRenamed("a", "node"), "near-copies")
    yield near
    left = rare.join(near, "node", "left_anti")
    short = left.where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6))
    order = (F.col("x.n") > F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") > F.col("y.node")))
    met = left.alias("x").join(short.alias("y"), (F.col("x.token") == F.col("y.token")) & order & _fits("x", "y", similarity) & (F.col("x.first") != F.col("y.first")))
    later = F.col("x.first") > F.col("y.first")
    pairs = met.select(F.when(later, F.col("x.node")).otherwise(F.col("y.node")).alias("a"), F.when(later, F.col("y.node")).otherwise(F.col("x.node")).alias("b")).distinct()
    yield written(_similar(written(pairs, "pairs"), sets, similarity).withColumnRenamed("a", "node"), "near-copies")


def class_pairs(keyed: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): each node against that of its class's first document. groups:
    (key, h, component_id); a node in several classes counts in the least one."""
    rows = keyed.select("key", "h", "node").distinct().join(groups.select("key", "h", "component_id").distinct(), ["key", "h"])
    nodes = written(rows.groupBy("node").agg(F.min("component_id").alias("class"), F.min("key").alias("first")), "class-nodes")
    heads = nodes.groupBy("class").agg(F.min(F.struct("first", "node")).alias("p"), F.count("*").alias("n")).where("n > 1")
    return nodes.join(heads, "class").where("node <> p.node and first > p.first").select(F.col("node").alias("a"), F.col("p.node").alias("b"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, few: int = FEW, groups: DataFrame | None = None) -> DataFrame:
    """docs without the near copies of a document with a smaller key. groups:
    (key, h, component_id) of ``simhash.classes``."""
    prints = written(sketches(docs, key, text), "sketches")
    keyed = prints.where("key is not null")
    place, gone = F.struct("first", "node"), []
    left = keyed
    if groups is not None:
        pairs = written(class_pairs(keyed, groups), "class-pairs")
        near = _sets(docs, keyed, pairs.select(F.explode(F.array("a", "b")).alias("node")), key, text)
        gone.append(written(_similar(pairs, near, similarity).withColumnRenamed("a", "node"), "near-copies"))
        left = keyed.join(gone[0], "node", "left_anti")
    live = written(left.select(F.explode("values").alias("bucket"), "node", "key").groupBy("bucket", "node").agg(F.min("key").alias("first")), "buckets")
    least = written(live.groupBy("bucket").agg(F.min(place).alias("p"), F.count("*").alias("size")).where("size > 1"), "least")
    if not least.isEmpty():
        met = written(live.join(least, "bucket"), "met")
        sets = _sets(docs, keyed, met.select("node"), key, text)
        small, rest = met.where(F.col("size") <= few), met.where((F.col("size") > few) & (place != F.col("p")))
        others = small.select("bucket", F.col("node").alias("b"), F.col("first").alias("least"))
        pairs = small.join(others, "bucket").where("first > least").select(F.col("node").alias("a"), "b")
        pairs = written(pairs.unionByName(rest.where("first > p.first").select(F.col("node").alias("a"), F.col("p.node").alias("b"))).distinct(), "pairs")
        gone.append(written(_similar(pairs, sets, similarity).withColumnRenamed("a", "node"), "near-copies"))
        live = written(rest.join(gone[-1], "node", "left_anti").select("bucket", "node", "first"), "live")
        shared = live.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        nodes = written(live.join(shared, "bucket", "left_semi").groupBy("node").agg(F.min("first").alias("first")), "rest")
        if not nodes.isEmpty():
            gone += rest_pairs(nodes, sets, similarity)
    firsts = written(keyed.groupBy("node").agg(F.min("key").alias("first")), "firsts")
    for found in gone:  # no key comes before null, so all of a node's rows go
        firsts = firsts.join(found.withColumn("gone", F.lit(True)), "node", "left").select("node", F.when(F.col("gone").isNull(), F.col("first")).alias("first"))
    out = keyed.join(written(firsts, "stays"), "node").where("first is null or key > first").select(F.col("key").alias("__key"), F.col("h").alias("__h")).distinct()
    out = written(out, "gone")
    return docs.join(out, (docs[key] == out["__key"]) & (F.xxhash64(docs[text]) == out["__h"]), "left_anti").select(docs.columns)
