"""Removal of repeated passages by content-defined chunks of lines.

1. A text is split at newlines; a line's hash is 32 bits of its MD5.
2. A rolling hash combines each line's hash with those of the two lines
   before it. A line ends a chunk where its rolling hash is strictly below
   both neighbours', so boundaries follow the content, move with insertions,
   and leave at least two lines in every inner chunk.
3. Chunks of two lines or more with a word in at least two of them are
   grouped over all documents by MD5 and length. In each group the chunk of
   the smallest document, then the smallest position, stays.
4. A repeated passage seldom begins and ends where chunks do. For its edges,
   and for passages too short to hold a chunk, neighbouring lines with words
   (blank ones between them included) are grouped as pairs in the same way,
   if they have ``PAIR_WORDS`` words together.
5. Another chunk or pair of a group goes only if its bytes equal the kept
   one's; pairs of lines that chunks remove anyway are not compared.
6. The lines that remain, joined by newlines, are the new text.

So a run of two lines or more that an earlier place has goes as a whole, and
every line that goes has an equal one at an earlier place that stays.

Only hashes and positions take part in the grouping: first 64 bits and a
count, then the rows of what comes twice. Texts move once, to meet their own
document's candidates, and then only the text of candidates moves.
Everything is DataFrame work inside the JVM.

Defined results: a null text stays null and an empty one empty, without
chunks; equal documents give up all but the first one's chunks; rows of the
same key rank by a hash of their text, and equal rows (key and text) are
treated alike, so nothing of a repeated row is removed because of its own
repetition; a document may end empty but keeps its row; a null key is never
matched and keeps its text; extra columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written

#: Weights of a line's hash and of the two before it.
WEIGHTS, MODULUS = (1, 31, 961), 2147483647
WORD = "[^\\x20\\x09-\\x0D]"
#: Words that two neighbouring lines need to count as a pair; bare brackets and one-word lines don't.
PAIR_WORDS = 6
CHUNK, PAIR = 0, 1


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it.
    (An expression put into a lambda would be computed for every element.)"""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _rolling(hashes: Column) -> Column:
    """Rolling hash at each line over its own and the two earlier hashes."""

    def at(h: Column, x: Column, i: Column) -> Column:
        total = x * WEIGHTS[0]
        for back in (1, 2):
            total += F.when(i >= back, F.get(h, i - back)).otherwise(0) * WEIGHTS[back]
        return total % MODULUS

    return _let(hashes, lambda h: F.transform(h, lambda x, i: at(h, x, i)))


def _cuts(rolling: Column) -> Column:
    """The last line of every chunk."""

    def found(r: Column) -> Column:
        n = F.size(r)
        inner = F.when(n > 2, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.filter(inner, lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) < F.get(r, i + 1))), F.array(n - 1))

    return _let(rolling, found)


def _chunks(lines: Column) -> Column:
    """Chunks of an array of lines: an array of (first line, last line)."""
    return _let(
        _cuts(_rolling(F.transform(lines, _line_hash))),
        lambda c: F.transform(c, lambda e, i: F.struct(F.when(i == 0, 0).otherwise(F.get(c, i - 1) + 1).alias("first"), e.alias("last"))),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _of(lines: Column, part: Column) -> Column:
    return F.slice(lines, part["first"] + 1, part["last"] - part["first"] + 1)


def _hashed(lines: Column, parts: Column, kind: int) -> Column:
    """(kind, digest, first, last) of some parts of the lines."""
    one = lambda p: F.struct(F.lit(kind).alias("kind"), digest(F.array_join(_of(lines, p), "\n")).alias("h"), p["first"].alias("first"), p["last"].alias("last"))
    return F.transform(parts, one)


def _large_chunks(lines: Column) -> Column:
    """The chunks with two lines or more that have a word."""
    filled = lambda c: F.size(F.filter(_of(lines, c), lambda x: x.rlike(WORD))) >= 2
    return F.filter(_chunks(lines), lambda c: (c["last"] > c["first"]) & filled(c))


def _pairs(lines: Column) -> Column:
    """Neighbouring lines with a word, by the words that both have."""
    counted = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.regexp_count(x, F.lit(WORD + "+")).alias("n")))
    return _let(
        F.filter(counted, lambda x: x["n"] > 0),
        lambda w: F.filter(
            F.transform(w, lambda x, k: F.struct(x["i"].alias("first"), F.get(w, k + 1)["i"].alias("last"), (x["n"] + F.get(w, k + 1)["n"]).alias("n"))),
            lambda p: F.coalesce(p["n"] >= PAIR_WORDS, F.lit(False)),
        ),
    )


def _doc(text: str) -> Column:
    return F.xxhash64(text).alias("__doc")


def repeated_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(__key, __doc, want): by document, its chunks and pairs whose digest
    repeats, each with whether it is the one that stays. __doc is the text's hash."""
    whole = docs.select(F.col(key).alias("__key"), _doc(text), F.col(text).alias("__text")).where("__key is not null and __text is not null")
    every = _let(_lines(F.col("__text")), lambda x: F.concat(_hashed(x, _large_chunks(x), CHUNK), _hashed(x, _pairs(x), PAIR)))
    rows = written(whole.select("__key", "__doc", F.explode(every).alias("c")).select("__key", "__doc", "c.*"), "parts").withColumn("d", F.xxhash64("kind", "h"))
    twice = written(rows.groupBy("d").agg(F.count("*").alias("n")).where("n > 1").select("d"), "repeated-digests")
    rows = written(rows.join(twice, "d").drop("d"), "repeated-parts")
    place = F.struct("__key", "__doc", "first")
    groups = rows.groupBy("kind", "h").agg(F.min(place).alias("keeper"), F.max(place).alias("other")).where("keeper <> other").select("kind", "h", "keeper")
    wanted = rows.join(written(groups, "kept-parts"), ["kind", "h"]).select("__key", "__doc", F.struct("kind", "h", "first", "last", (F.col("keeper") == place).alias("kept")).alias("c"))
    return wanted.groupBy("__key", "__doc").agg(F.collect_set("c").alias("want"))


def _covered(parts: Column) -> Column:
    """All lines of the parts."""
    return F.flatten(F.transform(parts, lambda c: F.sequence(c["first"], c["last"])))


def _needed(want: Column) -> Column:
    """Without the pairs that go and whose lines go with chunks."""
    lost = _covered(F.filter(want, lambda c: (c["kind"] == CHUNK) & ~c["kept"]))
    pairs = F.filter(want, lambda c: (c["kind"] == PAIR) & ~c["kept"])
    ends = F.concat(F.transform(pairs, lambda c: c["first"]), F.transform(pairs, lambda c: c["last"]))
    edges = _let(F.array_except(ends, lost), lambda e: F.filter(pairs, lambda c: F.array_contains(e, c["first"]) | F.array_contains(e, c["last"])))
    return F.concat(F.filter(want, lambda c: (c["kind"] == CHUNK) | c["kept"]), edges)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """docs with the repeated chunks and pairs cut out of text; report adds
    n_lines, n_removed_lines and n_removed_chunks."""
    want = repeated_parts(docs, key, text).withColumn("want", _needed(F.col("want"))).where(F.size("want") > 0)
    want = written(want, "wanted-parts")
    # the only move of the texts: to the lists of their own parts, which grow with the input
    whole = docs.select(F.col(key).alias("__key"), _doc(text), F.struct(*docs.columns).alias("row"))
    met = written(whole.join(want.hint("merge"), ["__key", "__doc"], "left"), "texts-and-parts")
    old = F.col("row")[text]

    bytes_of = _let(_lines(old), lambda x: F.transform("want", lambda c: F.struct(c["kind"].alias("kind"), c["h"].alias("h"), c["first"].alias("first"), c["last"].alias("last"), c["kept"].alias("kept"), F.array_join(_of(x, c), "\n").alias("bytes"))))
    texts = met.where("want is not null").select("__key", "__doc", F.explode(bytes_of).alias("c")).select("__key", "__doc", "c.*")
    variants = texts.groupBy("kind", "h", "bytes").agg(F.max("kept").alias("kept"))
    unlike = written(variants.where("not kept").select("kind", "h", "bytes"), "unlike-parts")  # same digest, other bytes
    gone = F.transform(F.filter("want", lambda c: ~c["kept"]), lambda c: F.struct(c["kind"].alias("kind"), c["first"].alias("first"), c["last"].alias("last")))
    if not unlike.isEmpty():
        spared = texts.join(unlike, ["kind", "h", "bytes"]).groupBy("__key", "__doc").agg(F.collect_set(F.struct("kind", "first", "last")).alias("__spared"))
        met = met.join(spared, ["__key", "__doc"], "left")
        gone = F.when(F.col("__spared").isNull(), gone).otherwise(F.filter(gone, lambda c: ~F.array_contains("__spared", c)))
    met = met.withColumn("__gone", gone)

    some = F.col("__gone").isNotNull() & (F.size("__gone") > 0)
    stay = lambda x: F.array_except(F.sequence(F.lit(0), F.size(x) - 1), _covered(F.col("__gone")))
    left = _let(_lines(old), lambda x: F.transform(stay(x), lambda i: F.get(x, i)))
    cut = met.withColumn("__left", F.when(some, F.struct(left.alias("lines"))))
    new = F.when(some, F.array_join("__left.lines", "\n")).otherwise(old)
    out = [new.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns]
    if report:
        n = F.when(old.isNull(), 0).otherwise(F.size(_lines(old)))
        chunks = F.size(F.filter("__gone", lambda c: c["kind"] == CHUNK))
        out += [n.cast("long").alias("n_lines"), F.when(some, n - F.size("__left.lines")).otherwise(0).cast("long").alias("n_removed_lines"), F.when(some, chunks).otherwise(0).cast("long").alias("n_removed_chunks")]
    return cut.select(*out)
