"""Exact k nearest neighbours inside each sample, as a distributed join.

Spots with a missing, NaN or infinite coordinate neither ask nor answer, whatever the size of their slide.
A first small job counts the spots per slide. Slides of a bounded size go one slide per group to NumPy,
which needs a single shuffle. Larger slides are never put into one task, and no step forms all pairs of
a slide; their points are packed into quadtree leaves of bounded size:

1. Each sample gets a square grid fine enough for its point count. Cells that are still too full are
   split further, cell by cell (dense regions), and neighbouring sparse cells merge into one leaf.
2. A radius per query point is proven to hold k neighbours: the k-th distance inside its own leaf, or the
   diagonal of the parent square, which holds more than k points.
3. Leaves whose bounding box lies within that radius are found by an equi join on grid cells.
4. Points of such leaf pairs within the radius are ranked by (squared distance, id).

Ties are broken by id. Many points on one location are reduced to the k+1 smallest ids as candidates,
which is exact, since all of them are equally far from everything.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.session import materialise

# Slides up to this many spots are handled whole, by one task each.
SLIDE = 4096
LEAF = 32
MAX_LEVEL = 50
SAMPLE, ID = "sample_id", "barcode"


def knn_edges(
    points: DataFrame, k: int, queries: DataFrame | None = None, slide_size: int = SLIDE, leaf_size: int = LEAF
) -> DataFrame:
    """Edges (sample_id, barcode, neighbor, d2, rank) with rank 1..k; self is never a neighbour.

    ``queries`` (sample_id, barcode) restricts the left side; neighbours still come from all points.
    A spot without finite coordinates has no neighbours and is none.
    """
    pts = points.select(SAMPLE, ID, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    finite = F.lit(float("inf"))
    pts = pts.filter((F.abs("x") < finite) & (F.abs("y") < finite))  # NaN is greater than any number
    sizes = pts.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_pts"))
    largest = sizes.agg(F.max("n_pts")).first()[0] or 0
    if queries is None:
        pts = pts.withColumn("q", F.lit(True))
    else:
        asked = queries.select(SAMPLE, ID).distinct().withColumn("__q", F.lit(True))
        pts = pts.join(asked, [SAMPLE, ID], "left").withColumn("q", F.col("__q").isNotNull()).drop("__q")
    if largest <= slide_size:
        return _whole_slides(pts, k)
    big = sizes.filter(F.col("n_pts") > slide_size).select(SAMPLE)
    small = pts.join(big, SAMPLE, "left_anti")
    return _whole_slides(small, k).unionByName(_leaf_join(pts.join(big, SAMPLE, "left_semi"), k, leaf_size))


def _whole_slides(pts: DataFrame, k: int) -> DataFrame:
    """Slides of bounded size, one group each."""
    ids = pts.schema[ID].dataType
    schema = T.StructType([
        pts.schema[SAMPLE], T.StructField(ID, ids), T.StructField("neighbor", ids),
        T.StructField("d2", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    return pts.groupBy(SAMPLE).applyInPandas(lambda slide: _nearest_in_slide(slide, k), schema)


def _nearest_in_slide(slide: pd.DataFrame, k: int) -> pd.DataFrame:
    slide = slide.sort_values(ID, kind="stable", ignore_index=True)
    x, y, ids = slide["x"].to_numpy(), slide["y"].to_numpy(), slide[ID].to_numpy()
    asked = np.flatnonzero(slide["q"].to_numpy())
    n, parts = len(slide), []
    take = min(k, n - 1)
    for start in range(0, len(asked) if take > 0 else 0, 512):
        rows = asked[start:start + 512]
        dx, dy = x[rows, None] - x[None, :], y[rows, None] - y[None, :]
        d2 = dx * dx + dy * dy
        d2[np.arange(len(rows)), rows] = np.inf
        bound = np.partition(d2, take - 1, axis=1)[:, take - 1]
        r, c = np.nonzero(d2 <= bound[:, None])
        order = np.lexsort((c, d2[r, c], r))  # column order is id order
        r, c = r[order], c[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1
        keep = rank <= take
        parts.append((rows[r[keep]], c[keep], d2[r[keep], c[keep]], rank[keep]))
    i, j, d2, rank = (np.concatenate(a) for a in zip(*parts)) if parts else (np.empty(0, int),) * 4
    return pd.DataFrame({
        SAMPLE: slide[SAMPLE].iloc[:1].repeat(len(i)).to_numpy(), ID: ids[i], "neighbor": ids[j],
        "d2": d2.astype("float64"), "rank": rank.astype("int32")})


def _leaf_join(pts: DataFrame, k: int, leaf_size: int) -> DataFrame:
    # the radius of a query is its k-th distance inside its leaf: in a leaf of k points it would reach far beyond the k nearest
    leaf_size = max(leaf_size, 4 * (k + 2))
    pts = materialise(pts)  # read by every step
    reps, stacked = pts, None
    grid = _grid(reps, leaf_size)
    fullest = _fullest(grid)
    if fullest > leaf_size and _stacked(pts, leaf_size):
        here = Window.partitionBy(SAMPLE, "x", "y").orderBy(ID)
        reps = pts.withColumn("__r", F.row_number().over(here)).filter(F.col("__r") <= k + 1)
        # the other points of a location have its k smallest ids as neighbours, at distance 0
        stacked = (
            pts.filter("q").join(reps.select(SAMPLE, ID), [SAMPLE, ID], "left_anti")
            .join(reps.filter(F.col("__r") <= k).select(SAMPLE, "x", "y", F.col(ID).alias("neighbor"),
                                                        F.col("__r").alias("rank")), [SAMPLE, "x", "y"])
            .select(SAMPLE, ID, "neighbor", F.lit(0.0).alias("d2"), F.col("rank").cast("int")))
        reps = reps.drop("__r")
        grid = _grid(reps, leaf_size)
        fullest = _fullest(grid)
    while fullest > leaf_size:  # each round moves every such cell at least one level down, MAX_LEVEL at most
        grid = _split_full_cells(grid, leaf_size)
        fullest = _fullest(grid)
    edges = _search(materialise(_leaves(grid, k, leaf_size)), k)  # read five times there
    return edges if stacked is None else edges.unionByName(stacked)


def weighted_edges(edges: DataFrame, k: int) -> DataFrame:
    """Edge table with the row-normalised weight 1/k."""
    return edges.withColumn("w", F.lit(1.0 / k))


def neighbour_sequence(points: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """Rank 0 = the spot itself, ranks 1..k = its neighbours by distance, padded with the spot itself."""
    centres = points if queries is None else points.join(queries.select(SAMPLE, ID).distinct(), [SAMPLE, ID], "left_semi")
    edges = knn_edges(points, k, queries)
    slots = centres.select(SAMPLE, ID, F.explode(F.sequence(F.lit(0), F.lit(k))).alias("rank"))
    return (
        slots.join(edges.select(SAMPLE, ID, "rank", "neighbor"), [SAMPLE, ID, "rank"], "left")
        .select(SAMPLE, ID, "rank", F.coalesce("neighbor", ID).alias("neighbor"),
                (F.col("neighbor").isNull() & (F.col("rank") > 0)).alias("padded")))


# ---------------------------------------------------------------- grid


def _cell(c: str, low: str, level: Column) -> Column:
    # scaling by a power of two is exact, so a cell's ancestor is its index shifted right
    return F.floor((F.col(c) - F.col(low)) / F.col("side") * F.pow(F.lit(2.0), level)).cast("bigint")


def _grid(pts: DataFrame, leaf_size: int) -> DataFrame:
    box = pts.groupBy(SAMPLE).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.count(F.lit(1)).alias("n"),
        (F.max("x") - F.min("x")).alias("bw"), (F.max("y") - F.min("y")).alias("bh"))
    span = F.greatest("bw", "bh")
    share = F.lit(leaf_size / 4.0) / F.col("n")
    width = F.greatest(F.sqrt(F.col("bw") * F.col("bh") * share), span * share)
    box = box.select(
        SAMPLE, "x0", "y0", F.when(span > 0, span * (1 + 1e-9)).otherwise(1.0).alias("side"),
        F.when((F.col("n") <= leaf_size) | (span <= 0), 0)
        .otherwise(F.least(F.greatest(F.ceil(F.log2(span / width)), F.lit(0)), F.lit(28))).cast("int").alias("lvl"))
    return pts.join(box, SAMPLE).withColumn("cx", _cell("x", "x0", F.col("lvl"))).withColumn(
        "cy", _cell("y", "y0", F.col("lvl")))


def _cells(grid: DataFrame) -> DataFrame:
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))
    return grid.groupBy(SAMPLE, "lvl", "cx", "cy").agg(
        F.count(F.lit(1)).alias("cnt"), span.alias("span"), F.first("side").alias("whole"))


def _splittable(cells: DataFrame) -> DataFrame:
    # the points of a cell without extent are one location, which no split parts
    return cells.filter((F.col("lvl") < MAX_LEVEL) & (F.col("span") > 0))


def _fullest(grid: DataFrame) -> int:
    """Points of the fullest cell that can still be split."""
    return _splittable(_cells(grid)).agg(F.max("cnt")).first()[0] or 0


def _stacked(pts: DataFrame, leaf_size: int) -> bool:
    """Does any single location hold more points than a leaf?"""
    return bool(pts.groupBy(SAMPLE, "x", "y").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > leaf_size).take(1))


def _split_full_cells(grid: DataFrame, leaf_size: int) -> DataFrame:
    """Move the points of too full cells to a level that fits the extent of the points in the cell."""
    full = _splittable(_cells(grid)).filter(F.col("cnt") > leaf_size)
    wanted = F.ceil(F.log2(F.col("whole") / F.col("span") * F.sqrt(F.col("cnt") * 4 / F.lit(float(leaf_size)))))
    full = full.select(SAMPLE, "lvl", "cx", "cy", F.least(
        F.greatest(wanted, F.col("lvl") + 1), F.lit(MAX_LEVEL)).cast("int").alias("to"))
    out = grid.join(full, [SAMPLE, "lvl", "cx", "cy"], "left").withColumn("lvl", F.coalesce("to", "lvl")).drop("to")
    out = out.withColumn("cx", _cell("x", "x0", F.col("lvl"))).withColumn("cy", _cell("y", "y0", F.col("lvl")))
    # the grid is used twice per round, so its plan must not grow from round to round
    return materialise(out)


# ---------------------------------------------------------------- leaves

_ANCESTOR = "CAST(shiftright({c}, {lvl} - {to}) AS BIGINT)"


def _up(c: str, lvl: str, to: str) -> Column:
    return F.expr(_ANCESTOR.format(c=c, lvl=lvl, to=to))


def _leaves(grid: DataFrame, k: int, leaf_size: int) -> DataFrame:
    """One row per leaf: points, query points with squared radius, bounding box, level and cell."""
    cells = _cells(grid)
    chain = cells.select(SAMPLE, "lvl", "cx", "cy", "cnt", F.explode(F.sequence(F.lit(0), F.col("lvl"))).alias("l"))
    chain = chain.withColumn("ax", _up("cx", "lvl", "l")).withColumn("ay", _up("cy", "lvl", "l"))
    # The few nodes of the coarse levels have very many cells below them: spread those by a salt.
    copies = F.when(F.col("l") < 5, F.pow(F.lit(4), 5 - F.col("l"))).otherwise(1).cast("int")
    node = [SAMPLE, "l", "ax", "ay"]
    small = (
        chain.groupBy(*node).agg(F.sum("cnt").alias("total")).filter(F.col("total") <= leaf_size)
        .select(*node, F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt")))
    leaf_of = (
        chain.withColumn("salt", F.pmod(F.xxhash64("cx", "cy"), copies).cast("int"))
        .join(small, [*node, "salt"])
        .groupBy(SAMPLE, "lvl", "cx", "cy").agg(F.min("l").alias("leaf_l")))
    placed = grid.join(leaf_of, [SAMPLE, "lvl", "cx", "cy"], "left").withColumn("l", F.coalesce("leaf_l", "lvl"))
    placed = placed.withColumn("lx", _up("cx", "lvl", "l")).withColumn("ly", _up("cy", "lvl", "l"))
    packed = placed.groupBy(SAMPLE, "l", "lx", "ly").agg(
        F.collect_list(F.struct(F.col(ID).alias("id"), "x", "y", "q")).alias("pts"),
        F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
        F.first("x0").alias("x0"), F.first("y0").alias("y0"), F.first("side").alias("side"))
    diagonal2 = F.pow(F.col("side") * F.pow(F.lit(0.5), F.col("l") - 1), 2) * 2 * (1 + 1e-9)

    def radius2(p: Column) -> Column:
        distances = F.transform("pts", lambda o: _d2(p, o))
        return F.when(F.size("pts") > k, F.element_at(F.array_sort(distances), k + 1)).otherwise(diagonal2)

    return packed.withColumn(
        "queries", F.transform(F.filter("pts", lambda p: p.q),
                               lambda p: F.struct(p.id.alias("id"), p.x.alias("x"), p.y.alias("y"), radius2(p).alias("r2"))))


def _d2(a: Column, b: Column) -> Column:
    return (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)


# ---------------------------------------------------------------- search


def _search(leaves: DataFrame, k: int) -> DataFrame:
    head = leaves.select(
        SAMPLE, "l", "lx", "ly", "x_lo", "x_hi", "y_lo", "y_hi", "x0", "y0", "side",
        F.array_max(F.transform("queries", lambda p: p.r2)).alias("r2"))
    floor_level = head.groupBy(SAMPLE).agg(F.min("l").alias("l_min"))
    head = head.join(floor_level, SAMPLE)

    reach = F.sqrt("r2") * (1 + 1e-9)
    # A radius taken from the parent square is searched on the parent's level, at most 5 x 5 cells.
    seek = head.filter(F.col("r2").isNotNull()).withColumn(
        "sl", F.when(reach > F.col("side") * F.pow(F.lit(0.5), F.col("l")) * 1.5, F.greatest(F.col("l") - 1, F.lit(0)))
        .otherwise(F.col("l")).cast("int"))
    last = F.pow(F.lit(2.0), F.col("sl")) - 1

    def line(lo: Column, hi: Column, origin: str) -> Column:
        scale = F.pow(F.lit(2.0), F.col("sl"))
        first = F.greatest(F.floor((lo - F.col(origin)) / F.col("side") * scale), F.lit(0))
        final = F.least(F.floor((hi - F.col(origin)) / F.col("side") * scale), last)
        return F.sequence(first.cast("bigint"), F.greatest(first, final).cast("bigint"))

    own = ["l", "lx", "ly"]
    seek = seek.select(
        SAMPLE, *[F.col(c).alias("q_" + c) for c in own], "l_min", "sl", "r2",
        *[F.col(c).alias("q_" + c) for c in ("x_lo", "x_hi", "y_lo", "y_hi")],
        F.explode(line(F.col("x_lo") - reach, F.col("x_hi") + reach, "x0")).alias("cx"),
        line(F.col("y_lo") - reach, F.col("y_hi") + reach, "y0").alias("cys"))
    seek = seek.select("*", F.explode("cys").alias("cy")).drop("cys")
    # (a) leaves at or below the searched cell, (b) larger leaves around it
    at = seek.select("*", F.lit(True).alias("below"), F.col("sl").alias("m"))
    around = (
        seek.filter(F.col("sl") > F.col("l_min"))
        .select("*", F.lit(False).alias("below"),
                F.explode(F.sequence(F.col("l_min"), F.col("sl") - 1)).alias("m"))
        .withColumn("cx", _up("cx", "sl", "m")).withColumn("cy", _up("cy", "sl", "m")).distinct())
    lookup = at.unionByName(around)

    box = head.select(SAMPLE, "l_min", *own, "x_lo", "x_hi", "y_lo", "y_hi")
    below = box.select(
        "*", F.lit(True).alias("below"),
        F.explode(F.sequence(F.greatest(F.col("l_min") - 1, F.lit(0)), F.col("l"))).alias("m"))
    offered = below.unionByName(box.select("*", F.lit(False).alias("below"), F.col("l").alias("m")))
    offered = offered.withColumn("cx", _up("lx", "l", "m")).withColumn("cy", _up("ly", "l", "m")).drop("l_min")

    def gap(lo: str, hi: str) -> Column:
        return F.greatest(F.col(lo) - F.col("q_" + hi), F.col("q_" + lo) - F.col(hi), F.lit(0.0))

    gx, gy = gap("x_lo", "x_hi"), gap("y_lo", "y_hi")
    pairs = (
        lookup.join(offered, [SAMPLE, "below", "m", "cx", "cy"])
        .filter(gx * gx + gy * gy <= F.col("r2") * (1 + 1e-9))
        .select(SAMPLE, "q_l", "q_lx", "q_ly", *own))
    asking = leaves.select(SAMPLE, *[F.col(c).alias("q_" + c) for c in own], "queries")
    holding = leaves.select(SAMPLE, *own, "pts", "x_lo", "x_hi", "y_lo", "y_hi")
    near_x = F.greatest(F.col("x_lo") - F.col("s.x"), F.col("s.x") - F.col("x_hi"), F.lit(0.0))
    near_y = F.greatest(F.col("y_lo") - F.col("s.y"), F.col("s.y") - F.col("y_hi"), F.lit(0.0))
    d2 = (F.col("s.x") - F.col("p.x")) * (F.col("s.x") - F.col("p.x")) + (
        F.col("s.y") - F.col("p.y")) * (F.col("s.y") - F.col("p.y"))
    found = (
        pairs.join(asking, [SAMPLE, "q_l", "q_lx", "q_ly"]).join(holding, [SAMPLE, *own])
        .select(SAMPLE, F.explode("queries").alias("s"), "pts", "x_lo", "x_hi", "y_lo", "y_hi")
        .filter(near_x * near_x + near_y * near_y <= F.col("s.r2") * (1 + 1e-9))
        .select(SAMPLE, "s", F.explode("pts").alias("p"))
        .withColumn("d2", d2)
        .filter((F.col("d2") <= F.col("s.r2")) & (F.col("s.id") != F.col("p.id")))
        .select(SAMPLE, F.col("s.id").alias(ID), F.col("p.id").alias("neighbor"), "d2"))
    nearest = Window.partitionBy(SAMPLE, ID).orderBy("d2", "neighbor")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
