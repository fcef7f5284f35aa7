"""Positions inside a group (0, 1, 2, ...) without sorting a whole group in one task.

Rows are dealt by range over (group, order), so that a large group spreads over many partitions, and sorted inside
each partition. The position is the row's place among the rows of its group in the partition, plus the rows of the
group in the partitions before. There is one path for all sizes; Spark draws the range borders from the rows, and
their number follows the row count through the shuffle partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.session import materialise


def position_by_number(df: DataFrame, group: Sequence[str], key: str, out: str, width: int = 65536) -> DataFrame:
    """0-based position by a unique integer ``key``; buckets are equal ranges of the key.

    The number of partitions is given, since rows of two keys are so small that Spark would put all of them into one task.
    """
    group = list(group)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = df.withColumn("__b", F.floor(F.col(key) / F.lit(width)).cast("bigint")).repartition(tasks, *group, "__b")
    counts = bucketed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"))
    inside = Window.partitionBy(*group, "__b").orderBy(key)
    return (
        bucketed.withColumn("__r", F.row_number().over(inside) - 1)
        .join(_offsets(counts, group).hint("merge"), [*group, "__b"])  # else the rows may be broadcast, by the size of their file
        .withColumn(out, (F.col("__off") + F.col("__r")).cast("bigint"))
        .drop("__b", "__off", "__r")
    )


def position(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """0-based position by ``order`` (a total order inside each group); descending columns are negated by the caller.

    The dealt rows are written to the shared folder, since both the counts and the result need the same partitions;
    what the caller does next reads them from there instead of computing ``df`` again.
    """
    group = list(group)
    keys = [F.col(g) for g in group]
    dealt = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    dealt = materialise(dealt.withColumn("__at", F.monotonically_increasing_id()).withColumn("__b", F.spark_partition_id()))
    # A null group is a group like any other, hence the null-safe joins.
    counts = dealt.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__c"), F.min("__at").alias("__first"))
    offsets = _offsets(counts, group, "__first").select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__b").alias("__ob"), "__off", "__first")
    same = F.col("__b") == F.col("__ob")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    placed = dealt.join(offsets, same).withColumn(out, F.col("__off") + F.col("__at") - F.col("__first"))
    return placed.drop("__at", *offsets.columns, "__b")


def _offsets(counts: DataFrame, group: list[str], *more: str) -> DataFrame:
    """Rows of the group in earlier buckets; one row for each group and bucket."""
    before = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("__b")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*group, "__b", *more, F.coalesce(F.sum("__c").over(before), F.lit(0)).cast("bigint").alias("__off"))
