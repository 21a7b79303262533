"""Connected components of an edge table, by alternating large and small stars.

Every round halves the distance to the smallest node, roughly; each ends with
a table in the shared folder, so lineage stays short and a lost executor costs
a re-read. A hub is no hot spot: minima are combined before the shuffle and
written, and the join that follows has a plain shuffle on both sides, which
adaptive execution splits where a key is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectrum.llm.common import written


def _smallest(pairs: DataFrame) -> DataFrame:
    return written(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"))
    return written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")


def _small_star(edges: DataFrame) -> DataFrame:
    least = _smallest(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge, but for the roots themselves.

    edges: two long columns a and b; order, repeats and loops don't matter.
    The root is the component's smallest node.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        now = _small_star(_large_star(now))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
