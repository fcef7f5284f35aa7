"""Coordinate operators that need statistics of a slide; all statistics are pre-aggregated."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.coords import dihedral, in_canvas

SPOT = ["sample_id", "barcode"]
# Gaps up to 0.5 are noise; a step below 2 means the coordinates are a grid already.
MIN_GAP, MIN_STEP = 0.5, 2.0


def _axes(points: DataFrame) -> DataFrame:
    return points.select("sample_id", "x", "y").unpivot("sample_id", ["x", "y"], "axis", "v")


def coordinate_gaps(points: DataFrame, width: float = 64.0) -> DataFrame:
    """Gap of each distinct coordinate to the one before it, per sample and axis.

    Values are compared inside bins of ``width``; the first value of a bin looks at the last value of the
    bin before it, so no task sees all values of a slide.
    """
    values = _axes(points).distinct().withColumn("bin", F.floor(F.col("v") / F.lit(width)))
    inside = Window.partitionBy("sample_id", "axis", "bin").orderBy("v")
    bins = values.groupBy("sample_id", "axis", "bin").agg(F.max("v").alias("hi"))
    chain = Window.partitionBy("sample_id", "axis").orderBy("bin")
    before = bins.select("sample_id", "axis", "bin", F.lag("hi").over(chain).alias("prev_hi"))
    return (
        values.withColumn("prev", F.lag("v").over(inside)).join(before, ["sample_id", "axis", "bin"])
        .select("sample_id", "axis", "v", (F.col("v") - F.coalesce("prev", "prev_hi")).alias("gap")))


def grid_step(points: DataFrame) -> DataFrame:
    """Smallest gap above 0.5 over both axes per sample; NULL when there is none.

    Two values inside one bin of width 0.5 cannot be a valid gap apart, so the lowest and highest value of
    each bin suffice: the rows that are sorted per slide are bounded by the slide's extent in pixels.
    """
    bins = _axes(points).groupBy("sample_id", "axis", F.floor(F.col("v") / MIN_GAP).alias("bin")).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    chain = Window.partitionBy("sample_id", "axis").orderBy("bin")
    gap = F.col("lo") - F.lag("hi").over(chain)
    gaps = bins.select("sample_id", gap.alias("gap"))
    return gaps.groupBy("sample_id").agg(F.min(F.when(F.col("gap") > MIN_GAP, F.col("gap"))).alias("step"))


def normalise_grid(points: DataFrame) -> DataFrame:
    """Pixel coordinates to grid indices, rounding halves to even; grids with a small step stay as they are."""
    coarse = F.col("step") >= F.lit(MIN_STEP)
    return points.join(grid_step(points), "sample_id", "left").select(
        *SPOT,
        F.when(coarse, F.rint(F.col("x") / F.col("step"))).otherwise(F.col("x")).alias("x"),
        F.when(coarse, F.rint(F.col("y") / F.col("step"))).otherwise(F.col("y")).alias("y"))


def centred(points: DataFrame) -> DataFrame:
    """Coordinates centred on the slide mean and divided by one scale for both axes, at least 1."""
    stats = points.groupBy("sample_id").agg(*[
        f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("mu", F.avg), ("lo", F.min), ("hi", F.max))])
    far = F.greatest(*[d for c in ("x", "y") for d in (
        F.col(f"hi_{c}") - F.col(f"mu_{c}"), F.col(f"mu_{c}") - F.col(f"lo_{c}"))], F.lit(1.0))
    return points.join(stats, "sample_id").select(
        *SPOT, ((F.col("x") - F.col("mu_x")) / far).alias("x"), ((F.col("y") - F.col("mu_y")) / far).alias("y"))


def all_dihedral(points: DataFrame) -> DataFrame:
    """Each point under each of the eight operations."""
    eight = points.select(*SPOT, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("op"))
    dx, dy = dihedral(F.col("x"), F.col("y"), F.col("op"))
    return eight.select(*SPOT, "op", dx.alias("dx"), dy.alias("dy"))


def relative_to_centre(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbour minus centre for (sample_id, barcode, neighbor, rank) rows."""
    here = points.select(*SPOT, F.col("x").alias("cx"), F.col("y").alias("cy"))
    there = points.select("sample_id", F.col("barcode").alias("neighbor"), "x", "y")
    return edges.join(here, SPOT).join(there, ["sample_id", "neighbor"]).select(
        *SPOT, "neighbor", "rank", (F.col("x") - F.col("cx")).alias("rel_x"), (F.col("y") - F.col("cy")).alias("rel_y"))


def to_image_space(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` has (sample_id, scalef); spots of a sample without one stay, with null coordinates."""
    return points.join(chosen.select("sample_id", "scalef"), "sample_id", "left").select(
        *SPOT, (F.col("x") * F.col("scalef")).alias("x"), (F.col("y") * F.col("scalef")).alias("y"))


def canvas_check(points: DataFrame, chosen: DataFrame, tolerance: float = 224.0) -> DataFrame:
    """Do all projected spots of a sample lie on its image, give or take ``tolerance`` pixels?"""
    box = points.groupBy("sample_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (
        ("lo", F.min), ("hi", F.max))])
    s = F.col("scalef")
    return box.join(chosen, "sample_id").select("sample_id", (
        in_canvas(F.col("lo_x") * s, F.col("hi_x") * s, F.col("w"), tolerance)
        & in_canvas(F.col("lo_y") * s, F.col("hi_y") * s, F.col("h"), tolerance)).alias("in_canvas"))
