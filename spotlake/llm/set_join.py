"""Exact join of similar sets, for sets of which many are linked already.

Shingles of a set are ordered by how many sets hold them, rarest first. Of two sets with ``share`` of their union in
common, a first common shingle stands early in both orders; how early follows from the two sizes. So every set is indexed
under its first shingles, in a class of similar sizes, and asks each class of smaller sizes with as many shingles as that
class needs. Shingles of one set alone are counted but never stored, so a set with enough of its own asks nothing.
Sets that are connected already are never paired: under each shingle the largest group only meets the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.tables import checked_broadcast, stored

STEP = 1.04  # ratio of the sizes in one class
SLACK = 1e-6  # against rounding; more candidates, never fewer


def _class(size: Column) -> Column:
    return F.floor(F.log(size.cast("double")) / math.log(STEP) + 1e-9).cast("int")


def _ordered(sets: DataFrame) -> DataFrame:
    """(n, size, root, alone, first): shingles held by several sets, rarest first; ``alone`` counts the others."""
    each = sets.select("n", "size", "root", F.explode("hashes").alias("h"))
    often = stored(each.groupBy("h").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    shared = each.join(checked_broadcast(often), "h").groupBy("n", "size", "root").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("first"))
    shared = shared.withColumn("first", F.transform("first", lambda x: x["h"]))
    return stored(shared.withColumn("alone", F.col("size") - F.size("first")), "ordered")


def _early(ordered: DataFrame, length: Column, *more: str) -> DataFrame:
    """(h, place, n, size, root, ...) of the first ``length`` shingles of each set."""
    early = ordered.withColumn("early", F.slice("first", F.lit(1), F.greatest(length - F.col("alone"), F.lit(0)).cast("int")))
    return early.select("n", "size", "root", "alone", *more, F.posexplode("early").alias("at", "h")).select(
        "h", "n", "size", "root", (F.col("alone") + F.col("at")).alias("place"), *more)


def unlinked_pairs(sets: DataFrame, share: float) -> DataFrame:
    """(a, b), a > b: all pairs with different roots that can have ``share`` of their union in common. Stored.

    ``sets`` is a stored table (n, size, root, hashes): distinct values and their number, at least one.
    """
    size, part = F.col("size"), share / (1 + share)
    ordered = _ordered(sets)
    index = _early(ordered.withColumn("class", _class(size)), size - F.ceil(2 * part * size - SLACK) + 1, "class")
    asked = ordered.withColumn("class", F.explode(F.sequence(_class(F.ceil(share * size - SLACK)), _class(size))))
    least = F.greatest(share * size, F.pow(F.lit(STEP), F.col("class")))
    asks = _early(asked, size - F.ceil(part * (least + size) - 1e-3) + 1, "class")
    index = stored(index, "index")
    asks = stored(asks.join(index.select("h", "class").distinct(), ["h", "class"], "left_semi"), "asks")
    counts = index.select("h", "class", "root").union(asks.select("h", "class", "root")).groupBy("h", "class", "root").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("h", "class").agg(F.max(F.struct("k", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    main = stored(main.where("roots > 1").select("h", "class", F.col("most.root").alias("main")), "main")
    small = index.join(main, ["h", "class"]).select("h", "class", *[F.col(c).alias(f"m_{c}") for c in ("n", "size", "root", "place")], (F.col("root") == F.col("main")).alias("m_in"))
    large = asks.join(main, ["h", "class"]).withColumn("in", F.col("root") == F.col("main"))
    pairs = large.where("NOT in").join(small, ["h", "class"]).union(large.where("in").join(small.where("NOT m_in"), ["h", "class"]))
    # The larger set asks, of equal ones that with the larger number. What follows a first common shingle bounds the overlap.
    larger = (size > F.col("m_size")) | ((size == F.col("m_size")) & (F.col("n") > F.col("m_n")))
    left = F.least(size - F.col("place"), F.col("m_size") - F.col("m_place"))
    enough = (left >= part * (size + F.col("m_size")) - SLACK) & (F.col("m_size") >= share * size - SLACK)
    near = pairs.where(larger & enough & (F.col("root") != F.col("m_root")))
    return stored(near.select(F.greatest("n", "m_n").alias("a"), F.least("n", "m_n").alias("b")).distinct(), "unlinked")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * common values >= percent * values of the union, compared over whole sets."""
    left = sets.select(F.col("n").alias("a"), F.col("size").alias("a_size"), F.col("hashes").alias("a_hashes"))
    right = sets.select(F.col("n").alias("b"), F.col("size").alias("b_size"), F.col("hashes").alias("b_hashes"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", F.size(F.array_intersect("a_hashes", "b_hashes")).alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("a_size") + F.col("b_size") - F.col("common"))).select("a", "b")
