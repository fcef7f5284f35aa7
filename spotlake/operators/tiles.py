"""Tiles of neighbouring spots with a halo: sums over edges without a copy of the counts for each edge.

Spots of a slide are put in Z-order and cut into tiles of equal size, so a tile is compact and bounded whatever the density.
A spot goes to its own tile and, as halo, to the tiles of the spots that have it as a neighbour. With its counts
packed into one row it is moved once and a little more (the rim of a tile grows with the root of its size), while
an edge join moves it once per edge. Inside a tile the edges are applied as sparse products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.operators.index import position
from spotlake.session import dealt

SPOT = ["sample_id", "barcode"]
TILE = 1024  # spots
GRID_BITS = 16  # bits of each coordinate in the Z-order
TOGETHER = 1 << 21  # entries that edges expand to at a time


def _spread(cell: Column) -> Column:
    """Bits of a GRID_BITS number moved apart, one free bit after each."""
    out = cell.cast("long")
    # Shifts and masks that halve the runs of neighbouring bits.
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(F.lit(mask))
    return out


def spot_tiles(spots: DataFrame, size: int = TILE) -> DataFrame:
    """(sample_id, barcode, tile) of every spot; a tile holds at most ``size`` spots of one slide.

    Spots without finite coordinates come first in the order; they have no neighbours, so any tile will do.
    """
    finite = ~(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")))
    points = spots.select(*SPOT, *[F.when(finite, F.col(c).cast("double")).alias(c) for c in ("x", "y")])
    box = points.groupBy("sample_id").agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("side"))
    top = (1 << GRID_BITS) - 1

    def cell(c: str) -> Column:
        return _spread(F.coalesce(F.floor((F.col(c) - F.col(f"{c}0")) / F.when(F.col("side") > 0, F.col("side")) * top), F.lit(0)))

    placed = points.join(box, "sample_id").select(*SPOT, cell("x").bitwiseOR(F.shiftleft(cell("y"), 1)).alias("z"))
    return position(placed, ["sample_id"], [F.col("z"), F.col("barcode")], "pos").select(*SPOT, F.floor(F.col("pos") / size).cast("bigint").alias("tile"))


def with_halo(tiles: DataFrame, edges: DataFrame) -> DataFrame:
    """(sample_id, tile, barcode, neighbors): the spots of each tile with their neighbours, and its halo without any.

    ``tiles`` and ``edges`` (sample_id, barcode, neighbor) are materialised tables.
    """
    own = tiles.join(edges.groupBy(*SPOT).agg(F.collect_list("neighbor").alias("neighbors")), SPOT, "left").select(
        "sample_id", "tile", "barcode", F.coalesce("neighbors", F.array()).alias("neighbors"))
    theirs = tiles.select("sample_id", F.col("barcode").alias("neighbor"), F.col("tile").alias("home"))
    asked = edges.join(tiles, SPOT).select("sample_id", "neighbor", "tile").distinct().join(theirs, ["sample_id", "neighbor"])
    halo = asked.where("tile <> home").select("sample_id", "tile", F.col("neighbor").alias("barcode"), F.lit(None).cast(own.schema["neighbors"].dataType).alias("neighbors"))
    return own.unionByName(halo)


def gene_sums(values: DataFrame, members: DataFrame) -> DataFrame:
    """(sample_id, gene, m, mean, square_sum, cross, lagged) of sparse ``values`` (sample_id, barcode, gene, x).

    ``m`` values are stored, with that mean and sum of squared deviations; ``cross`` and ``lagged`` are the sums of x_i * x_j
    and of x_j over all edges i -> j. There is one value for each spot and gene; nulls and those of spots outside
    ``members`` (of ``with_halo``) are left out.
    """
    packed = values.where("x IS NOT NULL").groupBy(*SPOT).agg(F.collect_list(F.struct("gene", F.col("x").cast("double").alias("x"))).alias("cells"))
    rows = members.join(packed, SPOT, "left").select("sample_id", "tile", "barcode", "neighbors", F.col("cells.gene").alias("genes"), F.col("cells.x").alias("xs"))
    sample, gene = values.schema["sample_id"], values.schema["gene"]

    def sums(table: pa.Table) -> pa.Table:
        found = tile_sums(*(table.column(c) for c in ("barcode", "neighbors", "genes", "xs")))
        return pa.table({"sample_id": pa.array([table.column("sample_id")[0].as_py()] * len(found["gene"]), table.schema.field("sample_id").type), **found})

    schema = T.StructType([sample, gene, *[T.StructField(c, T.DoubleType()) for c in ("m", "mean", "square_sum", "cross", "lagged")]])
    keys = ["sample_id", "gene"]
    # a row for each tile and gene, moved once for the centre and the sums
    parts = dealt(rows.groupBy("sample_id", "tile").applyInArrow(sums, schema).dropna(subset=keys), *keys)
    of_gene = Window.partitionBy(*keys)
    parts = parts.withColumn("centre", F.try_divide(F.sum(F.col("m") * F.col("mean")).over(of_gene), F.sum("m").over(of_gene)))
    apart = F.col("mean") - F.col("centre")
    return parts.groupBy(*keys).agg(
        F.sum("m").alias("m"), F.first("centre").alias("mean"), F.sum(F.col("square_sum") + F.col("m") * apart * apart).alias("square_sum"),
        F.sum("cross").alias("cross"), F.sum("lagged").alias("lagged")).where("m > 0")


def tile_sums(barcodes: pa.ChunkedArray, neighbors: pa.ChunkedArray, genes: pa.ChunkedArray, xs: pa.ChunkedArray) -> dict[str, pa.Array | np.ndarray]:
    """The sums of each gene over the spots and edges of one tile; rows without neighbours (null) are halo."""
    barcodes, neighbors, genes, xs = (pa.concat_arrays(c.chunks) for c in (barcodes, neighbors, genes, xs))
    coded = genes.flatten().dictionary_encode()
    names, gene = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    x = xs.flatten().to_numpy()
    many = len(names)
    sizes = np.nan_to_num(pc.list_value_length(genes).to_numpy(zero_copy_only=False)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    own = neighbors.is_valid().to_numpy(zero_copy_only=False)[row]
    m = np.bincount(gene[own], minlength=many).astype(float)
    mean = np.bincount(gene[own], weights=x[own], minlength=many) / np.maximum(m, 1)
    square_sum = np.bincount(gene[own], weights=(x[own] - mean[gene[own]]) ** 2, minlength=many)
    cross, lagged = np.zeros(many), np.zeros(many)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    key = row * max(many, 1) + gene
    order = np.argsort(key, kind="stable")
    key, held = key[order], x[order]
    out = np.nan_to_num(pc.list_value_length(neighbors).to_numpy(zero_copy_only=False)).astype(np.int64)
    source = np.repeat(np.arange(len(out)), out)
    target = pc.index_in(neighbors.flatten(), value_set=barcodes).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in _blocks(sizes[target]):
        i, j = source[lo:hi], target[lo:hi]
        each = sizes[j]
        edge = np.repeat(np.arange(len(j)), each)
        entry = starts[j][edge] + np.arange(len(edge)) - np.repeat(np.cumsum(each) - each, each)
        far, code = x[entry], gene[entry]
        lagged += np.bincount(code, weights=far, minlength=many)
        wanted = i[edge] * max(many, 1) + code
        at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
        hit = key[at] == wanted
        cross += np.bincount(code[hit], weights=far[hit] * held[at[hit]], minlength=many)
    return {"gene": names, "m": m, "mean": mean, "square_sum": square_sum, "cross": cross, "lagged": lagged}


def _blocks(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of edges that expand to about TOGETHER entries each, and to one edge at least."""
    if not len(sizes):
        return []
    number = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    return list(zip(cuts, cuts[1:], strict=False))
