"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns many points of a ring; a row goes clockwise from the hash of its doc_id to the first point whose
shard is not full. A shard is full once it holds ``1 + slack`` times the mean of all bytes; the rows that reach it in
one round are taken in a fixed order until then, and the others go on. In each round but the last a shard fills up,
so there are at most as many rounds as shards, and each but the first moves overflow only.

Where a shard stops is found by histograms of the order, digit by digit: a histogram has ``shards`` times 1,024 bins
however many rows there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spotlake.llm.tables import stored

SHARDS, POINTS, SLACK = 40, 256, 0.002
DIGIT = 10  # bits of the order that one histogram resolves


def ring(spark: SparkSession, shards: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the virtual nodes, and their shards; shards * points entries, as the parameters say."""
    each = spark.range(shards * points).select(F.floor(F.col("id") / points).alias("shard"), F.pmod("id", F.lit(points)).alias("point"))
    rows = each.select(F.xxhash64(F.lit("node"), "shard", "point").alias("at"), "shard").orderBy("at", "shard").collect()
    return np.array([r.at for r in rows], dtype=np.int64), np.array([r.shard for r in rows], dtype=np.int32)


def _clockwise(at: np.ndarray, owner: np.ndarray, full: set[int], column: str) -> Column:
    """The shard of the first point, from a hash on, whose shard is not in ``full``."""
    is_open = ~np.isin(owner, list(full))
    at, owner = at[is_open], owner[is_open]

    @F.pandas_udf("int")
    def place(position: pd.Series) -> pd.Series:
        return pd.Series(owner[np.searchsorted(at, position.to_numpy()) % len(at)])

    return place(column)


def _digits(slack_bytes: float) -> list[Column]:
    """Order within a shard: large rows first, so that the row that fills a shard is small; then by hash, then row."""
    large = F.greatest(F.lit(0), F.floor(F.log2(F.col("size") / F.lit(max(1.0, slack_bytes)))))
    out = [(F.lit(1023) - F.least(F.lit(1023), large)).cast("int")]
    for name, bits in (("draw", 60), ("row", 60)):
        out += [F.shiftrightunsigned(name, shift).bitwiseAND((1 << DIGIT) - 1).cast("int") for shift in range(bits - DIGIT, -1, -DIGIT)]
    return out


def _limits(rows: DataFrame, free: dict[int, int], digits: list[Column]) -> tuple[dict[int, list[int]], dict[int, int], int]:
    """(limits, bytes, rows): for each shard of ``free`` that ``rows`` would fill, the digits of the last row it takes.

    A shard takes rows while the bytes before them are fewer than its free bytes. bytes and rows count all of ``rows``.
    """
    limits: dict[int, list[int]] = {}
    totals: dict[int, int] = {}
    n_rows = 0
    asked = dict(free)
    for level, digit in enumerate(digits):
        cut = rows
        if level:
            at_limit = F.lit(False)
            for shard in asked:
                same = F.col("shard") == shard
                for known, value in zip(digits, limits[shard], strict=False):
                    same = same & (known == value)
                at_limit = at_limit | same
            cut = rows.where(at_limit)
        bins = cut.groupBy("shard", digit.alias("bin")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        by_shard: dict[int, list] = {}
        for b in sorted(bins, key=lambda b: b.bin):
            by_shard.setdefault(b.shard, []).append(b)
            if not level:
                totals[b.shard] = totals.get(b.shard, 0) + b.bytes
                n_rows += b.n
        for shard in list(asked):
            before, stop = 0, None
            for b in by_shard.get(shard, []):
                if before + b.bytes >= asked[shard]:
                    stop = b
                    break
                before += b.bytes
            if stop is None:
                del asked[shard]  # everything fits
                continue
            limits.setdefault(shard, []).append(stop.bin)
            asked[shard] -= before
            if stop.n == 1:
                del asked[shard]
        if not asked:
            break
    return limits, totals, n_rows


def _within(limits: dict[int, list[int]], digits: list[Column]) -> Column:
    """True where a row is not after the limit of its shard (or its shard has none)."""
    out = F.lit(True)
    for shard, prefix in limits.items():
        own = F.array(*digits[: len(prefix)]) <= F.array(*[F.lit(v) for v in prefix])
        out = F.when(F.col("shard") == shard, own).otherwise(out)
    return out


def assign_shards(docs: DataFrame, shards: int = SHARDS, points: int = POINTS, slack: float = SLACK, seed: int = 0) -> DataFrame:
    """(row, doc_id, size, text_crc32, draw, shard) for every row of ``docs``, stored.

    size is the number of UTF-8 bytes of the text (null: none) plus 16. A shard holds at most ``1 + slack`` times
    the mean, plus one row, of at most twice ``slack`` times the mean where so small rows remain. Rows with one
    doc_id, and all without, start at one place of the ring and spread clockwise once shards are full. Rows are told
    apart by a number given when the table of sizes is written, so that repeated rows are placed each.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), "doc_id").alias("at")).withColumn("draw", F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32")), "sizes")
    total = rows.agg(F.sum("size")).first()[0] or 0
    mean = total / shards
    room = int(np.ceil(mean * (1 + slack)))
    at, owner = ring(spark, shards, points)
    digits, load, full = _digits(mean * slack), dict.fromkeys(range(shards), 0), set()
    placed, left = None, rows
    while True:
        asked = stored(left.withColumn("shard", _clockwise(at, owner, full, "at")), "asked")
        limits, totals, n_rows = _limits(asked, {s: room - load[s] for s in range(shards) if s not in full}, digits)
        taken = asked.where(_within(limits, digits))
        placed = taken if placed is None else placed.union(taken)
        if not limits or not n_rows:
            break
        for shard, held in totals.items():
            load[shard] += held
        full |= set(limits)
        left = asked.where(~_within(limits, digits))
    return placed.drop("at")


def shard_slots(placed: DataFrame, rows_per_part: int = 100_000) -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard, ordered by draw, then row.

    A shard is cut into ranges of the draw whose number follows the row count; ranges are counted, and only a
    range of about ``rows_per_part`` rows is numbered in one task. Rows with one doc_id and text share a draw, so
    the row number mixes them over the ranges.
    """
    parts = max(1, -(-placed.count() // rows_per_part))
    mixed = placed.withColumn("part", F.pmod(F.xxhash64("draw", "row"), F.lit(parts)))
    counts = stored(mixed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = stored(counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first")), "first")
    own = mixed.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "part").orderBy("draw", "row")))
    return own.join(first, ["shard", "part"]).select(*placed.columns, (F.col("first") + F.col("nth") - 1).alias("slot"))
