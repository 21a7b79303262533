"""Exact top-k search over 64-bit codes by incremental multi-index hashing.

A code is cut into ``SEGMENTS`` segments. In round s every open query probes,
in each segment, the keys at exactly s differing bits from its own; whatever
it finds is verified by its whole Hamming distance. After round s all codes
nearer than SEGMENTS * (s + 1) have been seen, so a query is settled once its
k-th verified distance is below that; the others grow their radius.

A segment's table is dealt into cells by the leading bits of the key, as many
as the table's size asks for, and cells above ``cell_rows`` into chunks. A
query goes to the cells its radius can touch; inside, a task holds one cell
as a sorted array and streams the queries past it in blocks. Per query and
cell at most k rows leave a task.

Of rows with equal codes only the first k + 1 ids can be in any answer, so
copies cost no more than that; equal queries are answered once.

Defined results: neighbours rank by distance, then id; a query is no
neighbour of itself; with fewer than k others all are returned; rows with a
null id or embedding neither ask nor answer; a null or NaN component counts
as not positive; a vector of more components than a code has bits is an
error, as a code of its beginning would lose neighbours; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.llm.common import written

SEGMENTS, WIDTH, CELL_ROWS = 4, 16, 8192
CODE_BITS = SEGMENTS * WIDTH
#: Candidates verified at once.
_BLOCK = 1 << 20


def sign_codes(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, code): bit i is set if component i is above zero."""
    bits = F.expr(f"aggregate(transform({vector}, (x, i) -> if(x > 0 and not isnan(x), shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)")
    wide = F.raise_error(F.lit(f"a vector of {vector} has more than {CODE_BITS} components"))
    code = F.when(F.size(vector) > CODE_BITS, wide.cast("long")).otherwise(bits)
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("id"), code.alias("code"))


def _masks(width: int) -> list[np.ndarray]:
    """Numbers below 2**width by their count of bits."""
    every = np.arange(1 << width, dtype=np.int64)
    ones = np.bitwise_count(every)
    return [every[ones == n] for n in range(width + 1)]


class _Cell:
    """The codes of a segment whose keys share their leading bits."""

    def __init__(self, segment: int, prefix: int, prefix_bits: int, code: np.ndarray, ids: np.ndarray):
        self.low_bits, self.prefix, self.shift = WIDTH - prefix_bits, prefix, np.uint64(WIDTH * segment)
        low = self.keys(code) & ((1 << self.low_bits) - 1)
        order = np.argsort(low, kind="stable")
        self.code, self.ids = code[order], ids[order]
        self.bounds = np.searchsorted(low[order], np.arange((1 << self.low_bits) + 1))

    def keys(self, code: np.ndarray) -> np.ndarray:
        return ((code >> self.shift) & np.uint64((1 << WIDTH) - 1)).astype(np.int64)

    def probe(self, query: np.ndarray, bound: np.ndarray, radius: int, masks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, distance, id): up to k per query within its bound,
        among codes whose key differs in exactly ``radius`` bits."""
        keys = self.keys(query)
        spent = np.bitwise_count((keys >> self.low_bits) ^ self.prefix)
        low, found = keys & ((1 << self.low_bits) - 1), []
        for used in range(min(radius, WIDTH) + 1):
            if radius - used > self.low_bits:
                continue
            mask = masks[radius - used]
            own = np.flatnonzero(spent == used)
            per = max(1, _BLOCK // max(len(mask), 1))
            for at in range(0, len(own), per):
                q = own[at : at + per]
                probes = (low[q][:, None] ^ mask).ravel()
                first, n = self.bounds[probes], self.bounds[probes + 1] - self.bounds[probes]
                hit = np.flatnonzero(n)
                first, n, of = first[hit], n[hit], np.repeat(q, len(mask))[hit]
                for s in self._cuts(n):
                    rows = np.repeat(first[s] - (np.cumsum(n[s]) - n[s]), n[s]) + np.arange(n[s].sum())
                    who = np.repeat(of[s], n[s])
                    distance = np.bitwise_count(self.code[rows] ^ query[who]).astype(np.int64)
                    near = distance <= bound[who]
                    found.append(_best(who[near], distance[near], self.ids[rows[near]], k))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return _best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)

    @staticmethod
    def _cuts(n: np.ndarray) -> Iterator[slice]:
        """Runs of probes with about a block of candidates."""
        total, at = np.cumsum(n), 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _BLOCK, "right")))
            yield slice(at, end)
            at = end


def _best(who: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, distance, who))
    who, distance, ids = who[order], distance[order], ids[order]
    new = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
    rank = np.arange(len(who)) - np.repeat(new, np.diff(np.append(new, len(who))))
    return who[rank < k], distance[rank < k], ids[rank < k]


def _probed(radius: int, prefix_bits: int, k: int):
    """Streams rows sorted by cell, the index before the queries."""

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, cell, now, held = _masks(WIDTH - prefix_bits), None, None, []
        for batch in batches:
            keys, chunks, kinds, codes, ids, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            codes = codes.view(np.uint64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if s == e:
                    continue
                if (keys[s], chunks[s]) != now:
                    now, cell, held = (keys[s], chunks[s]), None, []
                if kinds[s] == 0:
                    held.append((codes[s:e], ids[s:e]))
                    continue
                if not held:
                    continue
                if cell is None:
                    segment, prefix = divmod(int(keys[s]), 1 << prefix_bits)
                    cell = _Cell(segment, prefix, prefix_bits, *(np.concatenate(x) for x in zip(*held, strict=True)))
                who, distance, found = cell.probe(codes[s:e], bounds[s:e], radius, masks, k)
                yield pa.RecordBatch.from_pydict({"code": codes[s:e][who].view(np.int64), "distance": distance, "id": found})

    return probed


def top_k(index: DataFrame, queries: DataFrame, k: int = 10, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(query_id, rank, neighbor_id, distance). index, queries: (id, code)."""
    first = Window.partitionBy("code").orderBy("id")
    index = written(index.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("code", "id"), "codes")
    queries = written(queries.distinct(), "queries")
    n, most = index.count(), 1 << WIDTH
    wanted = min(k + 1, n)
    prefix_bits = min(WIDTH, max(0, ceil(log2(max(n, 1) / cell_rows))))

    parts = F.array(*[F.shiftrightunsigned("code", WIDTH * i).bitwiseAND(F.lit(most - 1)).alias(str(i)) for i in range(SEGMENTS)])
    cells = index.select("code", "id", F.posexplode(parts).alias("segment", "part"))
    cells = cells.select("code", "id", (F.col("segment") * (1 << prefix_bits) + F.shiftright("part", WIDTH - prefix_bits)).cast("long").alias("cell"))
    sizes = written(cells.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("chunks")), "cells")
    cells = cells.join(sizes, "cell").select("cell", F.pmod(F.hash("code"), F.col("chunks")).cast("int").alias("chunk"), F.lit(0).alias("kind"), "code", "id", F.lit(0).cast("long").alias("bound"))
    cells = written(cells, "indexed")

    top_type = "array<struct<distance:bigint,id:bigint>>"
    open_queries = queries.select("code").distinct().withColumn("top", F.array().cast(top_type))
    settled = []
    for radius in range(WIDTH + 1):
        bound = F.when(F.size("top") >= wanted, F.get("top", F.lit(wanted - 1))["distance"]).otherwise(64)
        routed = open_queries.select("code", bound.cast("long").alias("bound"), F.posexplode(parts).alias("segment", "part"))
        lead = F.shiftright("part", WIDTH - prefix_bits)
        near = F.filter(F.sequence(F.lit(0), F.lit((1 << prefix_bits) - 1)), lambda p: F.bit_count(p.cast("long").bitwiseXOR(lead)) <= radius)  # noqa: B023
        routed = routed.select("code", "bound", F.explode(F.transform(near, lambda p: (F.col("segment") * (1 << prefix_bits) + p).cast("long"))).alias("cell"))
        routed = routed.join(sizes, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("kind"), "code", F.lit(0).cast("long").alias("id"), "bound")
        both = cells.unionByName(routed).select("cell", "chunk", "kind", "code", "id", "bound")
        dealt = both.repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "kind")
        hits = dealt.mapInArrow(_probed(radius, prefix_bits, wanted), "code long, distance long, id long")
        # at most `wanted` rows for each cell that a query goes to
        kept = hits.groupBy("code").agg(F.collect_set(F.struct("distance", "id")).alias("new"))
        merged = open_queries.join(kept, "code", "left").select("code", F.slice(F.array_sort(F.array_distinct(F.concat("top", F.coalesce("new", F.array().cast(top_type))))), 1, max(wanted, 1)).alias("top"))
        merged = written(merged, f"radius-{radius}")
        done = (F.size("top") >= wanted) & (F.coalesce(F.get("top", F.lit(wanted - 1))["distance"], F.lit(0)) < SEGMENTS * (radius + 1))
        settled.append(merged.where(done))
        open_queries = merged.where(~done)
        if open_queries.isEmpty():
            break
    answers = settled[0]
    for more in [*settled[1:], open_queries]:
        answers = answers.unionByName(more)
    joined = queries.withColumnRenamed("id", "query_id").join(answers, "code")
    others = F.slice(F.filter("top", lambda x: x["id"] != F.col("query_id")), 1, k)
    each = joined.select("query_id", F.posexplode(others).alias("at", "x"))
    return each.select("query_id", (F.col("at") + 1).cast("long").alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
