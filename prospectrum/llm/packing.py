"""Packing of tokenised documents into sequences by minimum bin slack.

1. Each text becomes token ids and an end id; a document longer than a
   sequence is cut into whole sequences, with the shorter piece first.
2. Only lengths matter to a packing, and there are at most ``capacity`` of
   them, so the driver gets a histogram with that many numbers at most. Per
   bin, the largest length left is set, and a bitset dynamic program over the
   lengths still available finds the fullest feasible combination; it is
   removed as often as its lengths last. A few tokens of slack may count as
   full, which saves short lengths for later; of several slacks that with the
   fewest bins is taken. The result is a list of patterns, each with a number
   of bins.
3. Every piece gets its rank among the pieces of its length, from row numbers
   inside blocks of pieces and running counts of the blocks. Rank and length give
   pattern, bin and offset by binary search.

Ids come from a byte-pair vocabulary file (rank format); texts are encoded
whole. The added tokens of the vocabulary (``SPECIAL``) count as one id
wherever a text has them, as in ``tokenizers``.

Defined results: a null text counts as empty, and an empty text is its end id
alone; rows that repeat a key are packed one by one; a null key keeps its
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prospectrum.llm.common import written
from prospectrum.llm.textblock import blocks

CAPACITY, END_ID, BLOCK_PIECES = 1024, 2, 1 << 12
#: The added tokens of byte_bpe_50k.json, which the rank format leaves out.
SPECIAL = {"<|endoftext|>": 50256}
#: Free tokens that count as none while a bin is filled; each is tried.
SLACKS = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a vocabulary file; made once in each worker."""
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def pieces(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """(key, piece, start, length, ids_crc32, __block) of every document; a block
    holds some ``block_pieces`` pieces that one task made, whatever their keys."""
    path = vocabulary or vocabulary_path()
    schema = docs.select(key).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("__block", "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = encoding(path).encode_to_numpy, TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for row, end, b in blocks(batch.column(1)):
                data, at = b.data.tobytes(), b.offsets.tolist()
                of, piece, start, length, crc = [], [], [], [], []
                for i in range(b.n_docs):
                    ids = encode(data[at[i] : at[i + 1]].decode("utf-8"), allowed_special="all")
                    ids = np.append(ids, end_id).astype("<u4")
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for p, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                        of.append(row + i)
                        piece.append(p)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(ids[s:e].tobytes()))
                block = task + (made + np.arange(len(of))) // block_pieces
                made += len(of)
                columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, block))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(key, "text").mapInArrow(cut, schema)


def fullest(left: dict[int, int], capacity: int, slack: int = 0) -> dict[int, int]:
    """The lengths (and how many of each) that fill a bin best, the largest
    length left among them. left: lengths and counts, largest length first.
    A bin with no more than ``slack`` free is full enough: shorter lengths
    then aren't tried, so that they are left for later bins."""
    anchor = next(iter(left))
    room = capacity - anchor
    enough = max(0, room - slack)
    bits, mask, items = 1, (1 << (room + 1)) - 1, []
    for length, count in left.items():
        most = min(count - (length == anchor), room // length)
        take = 1
        while most > 0 and not bits >> enough:
            take = min(take, most)
            items.append((length, take, bits))
            bits |= (bits << (take * length)) & mask
            most, take = most - take, 2 * take
        if bits >> enough:
            break
    goal, used = bits.bit_length() - 1, {anchor: 1}
    for length, take, before in reversed(items):
        if not before >> goal & 1:
            goal -= take * length
            used[length] = used.get(length, 0) + take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY, slacks: tuple[int, ...] = SLACKS) -> list[tuple[dict[int, int], int]]:
    """(lengths in a bin, number of such bins): the packing of the histogram
    with the fewest bins among those by the slacks given."""
    best = None
    for slack in slacks:
        left = {length: histogram[length] for length in sorted(histogram, reverse=True)}
        patterns, bins = [], 0
        while left:
            used = fullest(left, capacity, slack)
            times = min(left[length] // n for length, n in used.items())
            patterns.append((used, times))
            bins += times
            for length, n in used.items():
                left[length] -= n * times
                if not left[length]:
                    del left[length]
        if best is None or bins < best[0]:
            best = bins, patterns
        if best[0] * capacity - sum(k * n for k, n in histogram.items()) < capacity:
            break  # no packing has fewer
    return best[1]


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, in a bin, first bin, offset) by rank."""
    rows: dict[int, list] = {}
    rank: dict[int, int] = {}
    first_bin = 0
    for used, times in patterns:
        offset = 0
        for length, n in used.items():
            rows.setdefault(length, []).append((rank.get(length, 0), n, first_bin, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        first_bin += times
    return {length: np.array(x, np.int64).reshape(-1, 4) for length, x in rows.items()}


def pack(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Each piece with its sequence_id and its offset there."""
    cut = written(pieces(docs, key, capacity, end_id, vocabulary, block_pieces), "pieces")
    counts = written(cut.groupBy("length", "__block").agg(F.count("*").alias("n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = slots(minimum_bin_slack(histogram, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("length", "__block", before.alias("__base"))
    inside = F.row_number().over(Window.partitionBy("length", "__block").orderBy(key, "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("__in", inside).join(bases, ["length", "__block"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", (F.col("__base") + F.col("__in") - 1).alias("__rank"))
    schema = cut.select(key, "piece", "start", "length", "ids_crc32").schema.add("sequence_id", "long").add("offset", "long")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            found, starts = np.unique(length[order], return_index=True)
            for value, rows in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
                table = place[value]
                at = table[np.searchsorted(table[:, 0], rank[rows], "right") - 1]
                nth = rank[rows] - at[:, 0]
                sequence[rows] = at[:, 2] + nth // at[:, 1]
                offset[rows] = at[:, 3] + nth % at[:, 1] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(placed, schema)
