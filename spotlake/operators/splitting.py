"""Patient-safe splits, hash-based draws and neighbour dropout.

Draws use md5 of ``seed:key``, never ``rand()``: they do not depend on partitioning, retries or engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.scalars import seeded_hash
from spotlake.functions.vectors import zeros_like
from spotlake.operators.index import position

SPOT = ["sample_id", "barcode"]


def patient_split(
    samples: DataFrame, val_ratio: float = 0.2, test_ratio: float = 0.0, seed: int = 42,
) -> DataFrame:
    """(id, patient_group, split): no patient is in two splits; a missing patient is its own group.

    ``ceil(ratio * groups)`` groups are held out. With a test share the held-out groups are divided again;
    a single held-out group goes to validation as a whole.
    """
    grouped = samples.withColumn("patient_group", F.coalesce(F.col("patient"), F.col("id").cast("string")))
    groups = grouped.select("patient_group").distinct()
    total = groups.agg(F.count(F.lit(1))).scalar()
    placed = position(groups, [], [seeded_hash(seed, F.col("patient_group")), F.col("patient_group")], "pos")
    held = F.ceil(F.lit(float(val_ratio + test_ratio)) * total)
    split: Column = F.when(F.col("pos") >= held, "train")
    if test_ratio > 0:
        share = test_ratio / (val_ratio + test_ratio)
        # held-out groups are in hash order already: the tail of them is the test part
        n_test = F.when(held > 1, F.ceil(F.lit(share) * held)).otherwise(0)
        split = split.when(F.col("pos") >= held - n_test, "test")
    return grouped.join(placed.select("patient_group", split.otherwise("val").alias("split")), "patient_group").select(
        "id", "patient_group", "split")


def random_split(ids: DataFrame, val_ratio: float = 0.2, seed: int = 42, key: str = "id") -> DataFrame:
    """Split without patients: cut the hash order at ``int(n * (1 - val_ratio))``; one id goes to both."""
    n = ids.agg(F.count(F.lit(1))).scalar()
    placed = position(ids.select(key), [], [seeded_hash(seed, F.col(key)), F.col(key)], "pos")
    cut = F.floor(n * F.lit(1.0 - val_ratio))
    both = F.array(F.lit("train"), F.lit("val"))
    one = F.array(F.when(F.col("pos") < cut, "train").otherwise("val"))
    return placed.select(key, F.explode(F.when(n <= 1, both).otherwise(one)).alias("split"))


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def leaking_patients(split: DataFrame) -> DataFrame:
    """Patients found in more than one split; empty for a sound split."""
    return split.groupBy("patient_group").agg(F.countDistinct("split").alias("n_splits")).filter(F.col("n_splits") > 1)


def restrict_split(split: DataFrame, available: DataFrame, key: str = "id") -> DataFrame:
    """The split is drawn over the whole registry and then cut to what is available."""
    return split.join(available.select(key).distinct(), key, "left_semi")


def neighbour_dropout(sequence: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Zero the vectors of 0 to 2 neighbours per spot, never the spot itself.

    ``sequence`` has (sample_id, barcode, rank, features). The number is uniform in ``[0, min(3, k))``;
    windows are single sequences of k + 1 rows.
    """
    if k <= 1:
        return sequence.withColumn("dropped", F.lit(False))
    n_drop = F.pmod(seeded_hash(seed, F.col("sample_id"), F.col("barcode")), F.lit(min(3, k)))
    draw = seeded_hash(seed, F.col("sample_id"), F.col("barcode"), F.col("rank"))
    order = Window.partitionBy(*SPOT, F.col("rank") == 0).orderBy(draw, "rank")
    return (
        sequence.withColumn("dropped", (F.col("rank") > 0) & (F.row_number().over(order) <= n_drop))
        .withColumn("features", F.when(F.col("dropped"), zeros_like(F.col("features"))).otherwise(F.col("features"))))

