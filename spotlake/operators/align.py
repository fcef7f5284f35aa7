"""Alignment of tables to requested names, barcodes and catalogues; absent entries become zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPOT = ["sample_id", "barcode"]


def with_each(df: DataFrame, catalogue: DataFrame, name: str) -> DataFrame:
    """Every row of ``df`` once per distinct ``catalogue.name``.

    The catalogue (set names, requested names) is a short list; it reaches the rows as one array value
    of a scalar subquery, so there is no join at all.
    """
    values = catalogue.agg(F.array_sort(F.collect_set(name))).scalar()
    return df.select("*", F.explode(values).alias(name))


def align_activities(barcodes: DataFrame, activities: DataFrame, order: str | None = None) -> DataFrame:
    """Scores for an ordered barcode list: missing spots get 0 and ``valid`` false.

    ``order`` names a column of ``activities`` that says which of several rows for one
    (spot, pathway) came last; that one counts.
    """
    acts = activities
    if order is not None:
        acts = acts.groupBy(*SPOT, "pathway").agg(F.max_by("score", order).alias("score"))
    stored = acts.select(*SPOT).distinct().withColumn("valid", F.lit(True))
    wanted = with_each(barcodes, activities, "pathway")
    return (
        wanted.join(acts.select(*SPOT, "pathway", "score"), [*SPOT, "pathway"], "left")
        .join(stored, SPOT, "left")
        .na.fill({"score": 0.0, "valid": False}))


def project_requested(
    spots: DataFrame, activities: DataFrame, weights: DataFrame, requested: DataFrame
) -> DataFrame:
    """Requested pathways for every spot, in request order; missing score and weight are 0.

    ``requested`` has columns (pos, pathway); ``weights`` has (sample_id, pathway, morans_i).
    """
    slots = requested.agg(F.array_sort(F.collect_list(F.struct("pos", "pathway")))).scalar()
    return (
        spots.select(*SPOT, F.explode(slots).alias("s")).select(*SPOT, "s.pos", "s.pathway")
        .join(activities.select(*SPOT, "pathway", "score"), [*SPOT, "pathway"], "left")
        .join(weights.select("sample_id", "pathway", F.col("morans_i").alias("weight")),
              ["sample_id", "pathway"], "left")
        .na.fill({"score": 0.0, "weight": 0.0}))


def attach_weights(spots: DataFrame, weights: DataFrame) -> DataFrame:
    """Per-slide pathway weights on every spot of the slide; a slide without weights keeps its spots, with nulls."""
    return spots.join(weights, "sample_id", "left")


def membership(gene_sets: DataFrame, genes: DataFrame, scale: float = 1.0) -> DataFrame:
    """Full set x gene table with ``scale`` for members and 0 otherwise."""
    flags = gene_sets.select("pathway", "gene").distinct().withColumn("__m", F.lit(True))
    return (
        with_each(genes.select("gene").distinct(), gene_sets, "pathway")
        .join(flags, ["pathway", "gene"], "left")
        .select("pathway", "gene",
                F.when(F.col("__m"), F.lit(float(scale))).otherwise(0.0).alias("value")))


def valid_patches(patches: DataFrame, obs: DataFrame) -> DataFrame:
    """``patches`` with a flag: does the expression table know the spot?"""
    known = obs.select(*SPOT).distinct().withColumn("__k", F.lit(True))
    return patches.join(known, SPOT, "left").withColumn("valid", F.col("__k").isNotNull()).drop("__k")


def requested_names(names: DataFrame, requested: DataFrame | None, default: int = 6) -> DataFrame:
    """Match requested names, with or without the set prefix, to available (pos, pathway) names.

    Unknown names drop out. Without a request the first ``default`` names are taken.
    """
    from spotlake.functions.scalars import short_name

    available = names.select(F.col("pos").alias("pathway_pos"), "pathway", short_name(F.col("pathway")).alias("key"))
    if requested is None:
        first = available.orderBy("pathway_pos").limit(default)
        return first.select(F.col("pathway_pos").alias("pos"), F.col("key").alias("name"), "pathway")
    wanted = requested.select("pos", short_name(F.col("pathway")).alias("key"))
    # of several sets with one short name the first one counts
    one = available.groupBy("key").agg(F.min_by("pathway", "pathway_pos").alias("pathway"))
    return wanted.join(one, "key").select("pos", F.col("key").alias("name"), "pathway")


def injected_table(obs: DataFrame, predictions: DataFrame, names: list[str]) -> DataFrame:
    """One labelled row per spot: coordinates plus a column per pathway.

    The plan raises, and gives no row, when a spot has no prediction, a prediction has no spot, a (spot, pathway)
    is missing or repeated, or a name is unknown; the check is part of the one pass over the predictions.
    """
    known = F.col("pathway").isin(*names) & F.col("pathway").isNotNull()
    named = F.when(known, F.col("pathway")).otherwise(F.raise_error(F.concat(F.lit("unknown pathway "), F.coalesce("pathway", F.lit("NULL")))))
    score = {n: F.when(F.col("pathway") == n, F.col("score")) for n in names}
    wide = predictions.withColumn("pathway", named).groupBy(*SPOT).agg(
        F.count(F.lit(1)).alias("__n"), F.countDistinct("pathway").alias("__names"), *[F.max(c).alias(n) for n, c in score.items()])
    both = obs.select(*SPOT, "x", "y", F.lit(True).alias("__spot")).join(wide, SPOT, "full")
    problem = (
        F.when(F.col("__spot").isNull(), "prediction without a spot").when(F.col("__n").isNull(), "spot without a prediction")
        .when((F.col("__names") != len(names)) | (F.col("__n") != len(names)), "pathways of a spot are missing or repeated"))
    fine = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(F.lit(True))
    return both.filter(fine).select(*SPOT, "x", "y", *names)


def default_names(n: int) -> list[str]:
    return [f"pathway_{i}" for i in range(n)]


def context_spots(
    centres: DataFrame, spots: DataFrame, m: int, seed: int = 42
) -> DataFrame:
    """For every centre, ``m`` spots of the same slide drawn with replacement by hash.

    Slots hold a slide-local position, so the draw is an equi join on (sample, position).
    """
    from spotlake.functions.scalars import seeded_hash
    from spotlake.operators import index

    placed = index.position(spots.select(*SPOT), ["sample_id"], [F.col("barcode")], "idx")
    sizes = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    slots = (
        centres.select("sample_id", F.col("barcode").alias("centre")).join(sizes, "sample_id")
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(m))).alias("slot"))
        .withColumn("idx", F.pmod(seeded_hash(seed, F.col("sample_id"), F.col("centre"), F.col("slot")), F.col("n"))))
    return slots.join(placed, ["sample_id", "idx"]).select("sample_id", "centre", "slot", "barcode")

