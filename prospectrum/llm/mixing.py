"""Temperature mixing of sources, realised as budgeted block permutations.

1. Tokens are summed by source. With shares p, a source's weight is
   p**a / sum(p**a): a = 1 keeps the shares, a = 0 makes all equal.
2. The exponent a in [0, 1] is bisected: the largest that reaches the target
   entropy (a part of the largest possible, ln of the number of sources), then
   raised, where needed, to the smallest that keeps every source's
   repetitions (its quota over its tokens) at the limit.
3. A source's quota is its weight times the budget. Its documents are dealt
   into blocks of about ``block_docs`` by a hash; each epoch permutes the
   blocks and the documents in them anew, by hashes. Epochs follow each other
   until the quota is used up: a document is taken if it ends within the quota.

Prefix sums run over the documents of a block, the blocks of one of 256
groups, and the groups, so that no task gets a whole source. The bisection
works on one array with a number for each source. All is DataFrame work.

Defined results: null or empty texts have no tokens; a null source is a source
of its own; a source without tokens has weight 0 and nothing of it is taken;
rows that repeat a key count one by one (``schedule``; equal ones are counted
before they are ordered, so that a key with most of the rows is no hot spot)
or, if they have the same text, together (``take``); an empty table, or one without
tokens, gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prospectrum.llm.common import written

BLOCK_DOCS, STEPS = 1024, 50
#: Up to so many sources their table is broadcast (some 100 bytes each).
BROADCAST_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often then uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _weights(shares: Column, a: Column) -> Column:
    powers = _let(a, lambda x: F.transform(shares, lambda p: F.pow(p, x)))
    return _let(powers, lambda y: _let(_total(y), lambda s: F.transform(y, lambda x: x / s)))


def _bisected(low_fits: Column, fits) -> Column:
    """Where ``fits`` turns, in [0, 1]; low_fits: the end that fits is the low one."""
    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

    def step(x: Column, _: Column) -> Column:
        middle = (x["lo"] + x["hi"]) / 2
        up = fits(middle) == low_fits
        return F.struct(F.when(up, middle).otherwise(x["lo"]).alias("lo"), F.when(up, x["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)


def source_quotas(totals: DataFrame, budget: float, entropy: float, max_repeats: float) -> DataFrame:
    """(source, tokens, docs, weight, quota, epochs) for each source with tokens.

    totals: (source, tokens, docs); budget: a part of all tokens.
    """
    one = totals.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens", "docs"))).alias("s"), F.sum("tokens").alias("all"))
    one = one.where(F.size("s") > 0).withColumn("budget", F.floor(F.col("all") * budget))
    one = one.withColumn("shares", F.transform("s", lambda x: x["tokens"] / F.col("all")))
    tokens = F.transform("s", lambda x: x["tokens"].cast("double"))
    spread = lambda a: -_total(F.transform(_weights(F.col("shares"), a), lambda w: F.when(w > 0, w * F.ln(w)).otherwise(0.0)))
    repeats = lambda a: F.array_max(F.zip_with(_weights(F.col("shares"), a), tokens, lambda w, t: w * F.col("budget") / t))
    goal = F.ln(F.size("s").cast("double")) * entropy
    one = one.withColumn("a_entropy", F.when(spread(F.lit(1.0)) >= goal, 1.0).otherwise(_bisected(F.lit(True), lambda a: spread(a) >= goal)["lo"]))
    one = one.withColumn("a_repeats", F.when(repeats(F.lit(0.0)) <= max_repeats, 0.0).otherwise(_bisected(F.lit(False), lambda a: repeats(a) <= max_repeats)["hi"]))
    one = one.withColumn("weights", _weights(F.col("shares"), F.greatest("a_entropy", "a_repeats")))
    each = one.select("budget", F.explode(F.arrays_zip("s", "weights")).alias("x")).select("x.s.*", F.col("x.weights").alias("w"), "budget")
    quota = F.round(F.col("w") * F.col("budget")).cast("long")
    each = each.select("source", "tokens", "docs", F.round("w", 9).alias("weight"), quota.alias("quota"))
    return each.withColumn("epochs", F.ceil(F.col("quota") / F.col("tokens")).cast("int"))


def _before(order: list, by: list[str], what: str) -> Column:
    return F.coalesce(F.sum(what).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def schedule(docs: DataFrame, key: str = "doc_id", budget: float = 0.5, entropy: float = 0.95, max_repeats: float = 4.0, block_docs: int = BLOCK_DOCS, tokens: Column | None = None) -> DataFrame:
    """(key, source, weight, n_tokens, epoch, start): each taking of a document;
    start is its place in the source's stream of tokens."""
    rows = docs.select(F.col(key).alias("id"), F.col("source"), (words() if tokens is None else tokens).alias("n"))
    taken = _scheduled(rows, budget, entropy, max_repeats, block_docs)
    # copies follow each other, dealt out by thousands before each gets its row
    hundreds = taken.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / 1000))))
    copies = F.sequence(F.col("part") * 1000, F.least(F.col("copies"), F.col("part") * 1000 + 1000) - 1)
    each = hundreds.withColumn("copy", F.explode(copies)).withColumn("start", F.col("start") + F.col("copy") * F.col("n"))
    each = each.where(F.col("start") + F.col("n") <= F.col("quota"))
    return each.select(F.col("id").alias(key), "source", "weight", F.col("n").alias("n_tokens"), F.col("epoch").cast("long").alias("epoch"), F.col("start").cast("long").alias("start"))


def _scheduled(rows: DataFrame, budget: float, entropy: float, max_repeats: float, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(id, source, n, copies, weight, quota, epoch, start) of equal rows (id,
    source, n) whose first copy ends within the quota."""
    counted = written(rows.groupBy("id", "source", "n").agg(F.count("*").alias("copies")), "token-counts")
    totals = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens"), F.sum("copies").alias("docs"))
    quotas = written(source_quotas(totals, budget, entropy, max_repeats).where("quota > 0"), "quotas")
    quotas = quotas.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("long"))
    few = quotas.count() <= BROADCAST_SOURCES
    named = counted.join(F.broadcast(quotas) if few else quotas, counted["source"].eqNullSafe(quotas["source"])).drop(quotas["source"])
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    place = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.col("blocks"))
    dealt = named.select("id", "source", "n", "copies", "weight", "quota", place.alias("block"), F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)).alias("epoch"), F.col("tokens").alias("all"))
    dealt = dealt.withColumn("o", F.md5(F.concat_ws("|", "epoch", text).cast("binary")))
    by = ["source", "epoch", "block"]
    whole = F.col("n") * F.col("copies")
    inside = dealt.withColumn("all_n", whole).withColumn("before", _before(["o", "id", "n"], by, "all_n"))

    blocks = dealt.groupBy(*by).agg(F.sum(whole).alias("n"))
    blocks = blocks.withColumn("o", F.md5(F.concat_ws("|", "epoch", F.coalesce("source", F.lit("")), "block").cast("binary"))).withColumn("p", F.substring("o", 1, 2))
    blocks = written(blocks, "blocks")
    groups = blocks.groupBy("source", "epoch", "p").agg(F.sum("n").alias("n")).withColumn("base", _before(["p"], ["source", "epoch"], "n")).drop("n")
    placed = blocks.withColumn("off", _before(["o", "block"], ["source", "epoch", "p"], "n"))
    same = lambda a, b, names: [a[x].eqNullSafe(b[x]) for x in names]
    placed = placed.join(groups, same(placed, groups, ["source", "epoch", "p"])).select(placed["source"], placed["epoch"], "block", (F.col("base") + F.col("off")).alias("base"))
    start = F.col("all") * inside["epoch"] + F.col("base") + F.col("before")
    taken = inside.join(placed, same(inside, placed, by)).withColumn("start", start).where(F.col("start") + F.col("n") <= F.col("quota"))
    return taken.select("id", inside["source"], "n", "copies", "weight", "quota", inside["epoch"], "start")


def take(docs: DataFrame, key: str = "doc_id", budget: float = 0.9, entropy: float = 0.95, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The documents that the mixture takes when none may repeat, with all
    their columns. Equal rows (key, source and text) are taken together, or
    none of them; rows with a null key are told apart by their text."""
    name = lambda of: F.concat_ws("|", of[key].cast("string"), F.xxhash64(of["text"]).cast("string"))
    units = docs.select(name(docs).alias("id"), docs["source"], words().alias("n")).groupBy("id", "source").agg(F.sum("n").alias("n"))
    chosen = _scheduled(units, budget, entropy, 1.0, block_docs).where(F.col("start") + F.col("n") <= F.col("quota"))
    taken = written(chosen.select(F.col("id").alias("__id"), F.col("source").alias("__source")), "taken")  # grows with the input: never broadcast
    same = (name(docs) == taken["__id"]) & docs["source"].eqNullSafe(taken["__source"])
    return docs.join(taken.hint("merge"), same, "left_semi").select(docs.columns)
