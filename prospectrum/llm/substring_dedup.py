"""Removal of repeated passages by digests of lines and clauses, with original
offsets kept.

1. A text is cut into units: lines, and inside a line clauses, which end after
   a run of the marks ``MARKS``; a clause of more than ``LONG`` words is cut
   after every ``PART`` words. A unit is normalised: lower case, runs of
   white space to one space, none at the ends. Units without a word join no
   passage.
2. From every unit on, the fewest units in a row that hold ``min_words`` words
   are a passage; its normalised words are digested by MD5. So a line that is
   long enough is a passage of its own, and short lines make one together,
   while a short line that stands alone is left alone.
3. Digests are grouped over all documents. The earliest occurrence, by key,
   then place, stays; the units of all others go. Every removed unit thus has
   an equal one at an earlier place that stays.
4. A repeat seldom starts and ends with a unit. Where units go, the words
   before and after them are compared, one by one, with the words beside the
   occurrence that stays (``CONTEXT`` on each side, more than a unit has); those
   that are equal go as well.
5. What goes from a text is returned as spans of the original text, in
   characters, each with the key and offset of the equal text that stays.

A first shuffle has 64 bits of each digest and a count, combined before it;
only digests that come twice are grouped with their places. The join back to
the occurrences has a plain shuffle on both sides, which adaptive execution
splits at hot digests. Texts move twice: to the places whose words are wanted,
each place once however many repeats it has, and to their own lists of spans.

Defined results: null and empty texts have no units and stay as they are; a
passage that repeats in one document goes there too; rows that repeat a key
rank by a hash of their text, and equal rows (key and text) count as one
occurrence, which stays or goes as one; rows with a null key are left alone;
an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prospectrum.llm.common import written

MIN_WORDS, LONG, PART, CONTEXT = 25, 20, 12, 40
#: A line's end and the marks that end a clause inside a line.
MARKS = ".,;:!?。，、；：！？\n"
_UNIT = re.compile(f"[^{MARKS}]+[{MARKS}]*|[{MARKS}]+")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_ROWS = 256

#: A span on its way: its place, and at each end the place of the occurrence that stays.
_SPAN = "start int, end int, left_key {0}, left_h long, left_at int, right_key {0}, right_h long, right_at int"


def cut(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, number of words) of each unit with a word."""
    out = []
    for m in _UNIT.finditer(text):
        words = m.group().lower().encode().split()  # bytes.split() takes 0x20, 0x09-0x0D
        if len(words) > LONG:
            starts = [w.start() for w in _WORD.finditer(text, *m.span())][::PART]
            for i, (start, end) in enumerate(zip([m.start(), *starts[1:]], [*starts[1:], m.end()], strict=True)):
                part = words[i * PART : (i + 1) * PART]
                out.append((start, end, b" ".join(part), len(part)))
        elif words:
            out.append((*m.span(), b" ".join(words), len(words)))
    return out


def passages_of(text: str, min_words: int) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the passage from each unit on."""
    units, end, n = cut(text), 0, 0
    for i, (start, _, _, own) in enumerate(units):
        while n < min_words:
            if end == len(units):
                return
            n += units[end][3]
            end += 1
        yield start, units[end - 1][1], md5(b" ".join([u[2] for u in units[i:end]]), usedforsecurity=False).digest()
        n -= own


def words_before(text: str, at: int, most: int = CONTEXT) -> list[tuple[str, int]]:
    """The last words before a place, the nearest first, with their starts."""
    reach = 16 * most
    while True:
        first = max(0, at - reach)
        found = list(_WORD.finditer(text, first, at))
        if first > 0 and found and found[0].start() == first:
            found.pop(0)  # perhaps the end of a word
        if len(found) >= most or first == 0:
            return [(m.group().lower(), m.start()) for m in found[: -most - 1 : -1]]
        reach *= 4


def words_after(text: str, at: int, most: int = CONTEXT) -> list[tuple[str, int]]:
    """The first words after a place, with their ends."""
    return [(m.group().lower(), m.end()) for m in islice(_WORD.finditer(text, at), most)]


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, h, at, d, e) of all passages: h is the text's hash; at holds start
    and end, 32 bits each; d and e are the halves of the digest."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).where("key is not null and text is not null")
    schema = rows.select("key", "h").schema.add("at", "long").add("d", "long").add("e", "long")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), _ROWS):
                part = batch.slice(first, _ROWS)
                of, at, digests = [], [], []
                for i, one in enumerate(part.column(2)):
                    for start, end, digest in passages_of(one.as_py(), min_words):
                        of.append(i)
                        at.append(start << 32 | end)
                        digests.append(digest)
                if of:
                    place, halves = pa.array(of, pa.int64()), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(place), part.column(1).take(place), pa.array(at, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=schema.names)

    return rows.mapInArrow(made, schema)


def _start(at: str) -> Column:
    return F.shiftright(at, 32).cast("int")


def _end(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _met(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """(key, h, spans): by text, the units that go, merged where passages overlap."""
    found = written(passages(docs, key, text, min_words), "passages")
    twice = written(found.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "repeated-digests")
    met = written(found.join(twice, "d"), "repeated-passages")
    place = F.struct("key", "h", "at")
    groups = met.groupBy("d", "e").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    repeats = met.join(written(groups.select("d", "e", "first"), "kept-passages"), ["d", "e"]).where(place != F.col("first"))
    kind = met.schema["key"].dataType.simpleString()
    one = F.struct("at", F.col("first.key").alias("kept_key"), F.col("first.h").alias("kept_h"), F.col("first.at").alias("kept_at"))
    lists = repeats.groupBy("key", "h").agg(F.sort_array(F.collect_set(one)).alias("p"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            at, kept_key, kept_h, kept_at = batch.column(2).flatten().flatten()
            row, at, kept = np.repeat(np.arange(len(batch)), batch.column(2).value_lengths().to_numpy()), at.to_numpy(), kept_at.to_numpy()
            s, e = at >> 32, at & 0xFFFFFFFF
            # a later passage of a text never ends earlier
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (s[1:] >= e[:-1])))
            last = np.append(first[1:], len(row)) - 1
            int32 = lambda x: pa.array(x.astype(np.int32))
            left, right = pa.array(first), pa.array(last)
            parts = [int32(s[first]), int32(e[last]), kept_key.take(left), kept_h.take(left), int32(kept[first] >> 32), kept_key.take(right), kept_h.take(right), int32(kept[last] & 0xFFFFFFFF)]
            spans = pa.StructArray.from_arrays(parts, names=[c.split()[0] for c in _SPAN.split(", ")])
            bounds = pa.array(np.searchsorted(row[first], np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(bounds, spans)], names=["key", "h", "spans"])

    struct = ", ".join(f"{n}: {k}" for n, k in (c.split() for c in _SPAN.format(kind).split(", ")))
    return written(lists.mapInArrow(merged, f"key {kind}, h long, spans array<struct<{struct}>>"), "spans")


def _ends(docs: DataFrame, key: str, text: str, spans: DataFrame) -> DataFrame:
    """(key, h, ends): by text, both ends of each of its spans, with the words
    beside the occurrence that stays and where they start there."""
    each = spans.select("key", "h", F.posexplode("spans").alias("i", "s"))
    side = lambda name, right: each.select("key", "h", "i", F.lit(right).alias("right"), F.col("s.end" if right else "s.start").alias("place"), F.col(f"s.{name}_key").alias("kept_key"), F.col(f"s.{name}_h").alias("kept_h"), F.col(f"s.{name}_at").alias("kept_at"))
    both = written(side("left", False).unionByName(side("right", True)), "ends")
    wanted = both.groupBy("kept_key", "kept_h").agg(F.collect_set(F.struct("right", "kept_at")).alias("asked"))
    texts = docs.select(F.col(key).alias("kept_key"), F.xxhash64(text).alias("kept_h"), F.col(text).alias("text")).where("kept_key is not null and text is not null")
    rows = texts.join(wanted, ["kept_key", "kept_h"])
    schema = rows.select("kept_key", "kept_h").schema.add("right", "boolean").add("kept_at", "integer").add("words", T.ArrayType(T.StringType())).add("starts", T.ArrayType(T.IntegerType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for i, (one, asked) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                for a in asked:
                    words = (words_after if a["right"] else words_before)(one, a["kept_at"])
                    of.append(i)
                    out.append((a["right"], a["kept_at"], [w for w, _ in words], [p for _, p in words]))
            if of:
                place = pa.array(of, pa.int64())
                kinds = (pa.bool_(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *[pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)]], names=schema.names)

    contexts = written(rows.mapInArrow(read, schema).dropDuplicates(["kept_key", "kept_h", "right", "kept_at"]), "contexts")
    known = both.join(contexts, ["kept_key", "kept_h", "right", "kept_at"])
    return known.groupBy("key", "h").agg(F.sort_array(F.collect_list(F.struct("i", "right", "place", "kept_key", "kept_at", "words", "starts"))).alias("ends"))


def _same(own: list[tuple[str, int]], words: list[str]) -> int:
    """How many words from the first on are equal."""
    return next((i for i, ((a, _), b) in enumerate(zip(own, words, strict=False)) if a != b), min(len(own), len(words)))


def extended(text: str, ends: list[dict]) -> list[dict]:
    """The spans of a text, longer by the equal words at both ends, merged
    where they overlap; ends: left and right of each span, in order."""
    spans: list[dict] = []
    for left, right in zip(ends[::2], ends[1::2], strict=True):
        before, after = words_before(text, left["place"]), words_after(text, right["place"])
        n, m = _same(before, left["words"]), _same(after, right["words"])
        span = {"start": before[n - 1][1] if n else left["place"], "end": after[m - 1][1] if m else right["place"], "kept_key": left["kept_key"], "kept_start": left["starts"][n - 1] if n else left["kept_at"]}
        if spans and span["start"] < spans[-1]["end"]:
            first = min(spans[-1], span, key=lambda s: s["start"])
            spans[-1] = first | {"end": max(spans[-1]["end"], span["end"])}
        else:
            spans.append(span)
    return spans


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, text_hash, start, end, kept_key, kept_start) of every span that
    goes; text_hash (xxhash64) tells rows apart that share a key."""
    gone = remove(docs.select(key, text), key, text, min_words, report=True, text_hash=True).dropDuplicates([key, "text_hash"])
    each = gone.select(F.col(key), "text_hash", F.explode("removed_spans").alias("s"))
    return each.select(key, "text_hash", "s.start", "s.end", F.col("s.kept_key").alias(f"kept_{key}"), "s.kept_start")


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, report: bool = False, text_hash: bool = False) -> DataFrame:
    """docs without the repeated passages, one row for each. report adds
    n_removed_spans, n_removed_words and removed_spans, an array of
    (start, end, kept_key, kept_start); text_hash adds the hash of the text as it was."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    own, at = names[docs.columns.index(key)], docs.columns.index(text)
    ends = _ends(docs, key, text, _met(docs, key, text, min_words))
    right = ends.select(F.col("key").alias("of"), F.col("h").alias("of_h"), "ends").hint("merge")
    base = docs.toDF(*names)
    rows = base.join(right, (base[own] == right["of"]) & (F.xxhash64(base[names[at]]) == right["of_h"]), "left").select(*names, F.xxhash64(base[names[at]]).alias("h"), "ends")
    span = T.StructType().add("start", "long").add("end", "long").add("kept_key", docs.schema[key].dataType).add("kept_start", "long")
    schema = rows.select(*names).schema.add("n_spans", "long").add("n_words", "long").add("spans", T.ArrayType(span)).add("h", "long")
    spans_kind = to_arrow_type(T.ArrayType(span))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(at), batch.column(len(names) + 1)
            new, n_words, found = [], [], []
            for i in range(len(batch)):
                old, ends, n = texts[i].as_py(), lists[i].as_py(), 0
                spans = extended(old, ends) if ends else None
                if spans:
                    kept, end = [], 0
                    for s in spans:
                        kept.append(old[end : s["start"]])
                        end = s["end"]
                        n += len(old[s["start"] : end].encode().split())
                    old = "".join(kept) + old[end:]
                new.append(old)
                n_words.append(n)
                found.append(spans)
            columns = [pa.array(new, texts.type) if j == at else batch.column(j) for j in range(len(names))]
            counts = pa.array([len(x or []) for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, counts, pa.array(n_words, pa.int64()), pa.array(found, spans_kind), batch.column(len(names))], names=schema.names)

    out = rows.mapInArrow(left, schema)
    more = ["n_removed_spans", "n_removed_words", "removed_spans"]
    out = out.toDF(*docs.columns, *more, "text_hash")
    return out.select(*docs.columns, *(more if report else []), *(["text_hash"] if text_hash else []))
