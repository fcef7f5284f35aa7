"""Moran's I on sparse counts and on packed activity vectors, and spatial coherence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.aggregates import centred_square_sum, morans, pearson
from spotlake.functions.scalars import clipped_at_zero
from spotlake.operators.knn import knn_edges
from spotlake.operators.tiles import gene_sums, spot_tiles, with_halo
from spotlake.session import dealt, materialise

SPOT = ["sample_id", "barcode"]


def gene_morans(
    spots: DataFrame, values: DataFrame, var: DataFrame, k: int = 6, edges: DataFrame | None = None
) -> DataFrame:
    """Moran's I per (sample, gene) of sparse ``values`` (sample_id, barcode, gene, x).

    ``spots`` is the spot universe (zeros count), ``var`` the gene universe. Slides with fewer than
    ``k + 1`` spots, constant genes and genes without counts get 0. ``values`` has one row for each spot and gene;
    those of spots outside the universe are left out. ``edges`` is a materialised table. Counts are moved by tile, not by edge.
    """
    spots = materialise(spots.select(*SPOT, "x", "y"))  # read by the search, the tiles and the counts
    # the edges (k per spot) serve the tiles and their halo: search them once
    edges = materialise(knn_edges(spots, k).select(*SPOT, "neighbor")) if edges is None else edges
    n_spots = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    sums = gene_sums(values, with_halo(materialise(spot_tiles(spots)), edges))
    m, n = F.col("m"), F.col("n").cast("double")
    statistic = morans(F.col("cross"), F.col("lagged"), F.col("mean") * m / n, centred_square_sum(F.col("mean"), F.col("square_sum") / m, m, n), k)
    return (
        dealt(var.select("sample_id", "gene"), "sample_id", "gene").distinct().join(n_spots, "sample_id")
        .join(sums, ["sample_id", "gene"], "left")
        .select("sample_id", "gene",
                F.when((F.col("n") < k + 1) | F.col("m").isNull(), F.lit(0.0)).otherwise(statistic).alias("morans_i")))


def packed_morans(edges: DataFrame, packed: DataFrame, k: int) -> DataFrame:
    """Moran's I per (sample, position) of one array of values per spot.

    ``packed`` has (sample_id, barcode, v array<double>). The edge join moves one array per edge end and
    all positions are summed in one pass.
    """
    stats = packed.select("sample_id", F.posexplode("v").alias("pos", "x")).groupBy("sample_id", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), (F.var_pop("x") * F.count("x")).alias("ss"))
    ends = (
        edges.select("sample_id", "barcode", "neighbor")
        .join(packed.select(*SPOT, F.col("v").alias("vi")), SPOT)
        .join(packed.select("sample_id", F.col("barcode").alias("neighbor"), F.col("v").alias("vj")),
              ["sample_id", "neighbor"]))
    sums = ends.select("sample_id", F.posexplode(F.arrays_zip("vi", "vj")).alias("pos", "e")).groupBy(
        "sample_id", "pos").agg(F.sum(F.col("e.vi") * F.col("e.vj")).alias("cross"), F.sum("e.vj").alias("lagged"))
    statistic = morans(F.col("cross"), F.col("lagged"), F.col("mu"), F.col("ss"), k)
    return stats.join(sums, ["sample_id", "pos"], "left").select(
        "sample_id", "pos",
        F.when((F.col("n") < k + 1) | F.col("cross").isNull(), F.lit(0.0)).otherwise(statistic).alias("morans_i"))


def value_morans(points: DataFrame, column: str, k: int = 6) -> DataFrame:
    """Moran's I of one column of ``points`` per sample."""
    packed = points.select(*SPOT, F.array(F.col(column).cast("double")).alias("v"))
    return packed_morans(knn_edges(points, k), packed, k).select("sample_id", "morans_i")


def pack_scores(scores: DataFrame, value: str = "score") -> DataFrame:
    """One array per spot, ordered by pathway name; the group is one spot, bounded by the set catalogue."""
    return scores.groupBy(*SPOT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pathway", F.col(value).alias("s")))), lambda e: e.s).alias("v"))


def _names(scores: DataFrame) -> DataFrame:
    names = scores.agg(F.array_sort(F.collect_set("pathway")).alias("names"))
    return names.select(F.posexplode("names").alias("pos", "pathway"))


def pathway_morans(
    points: DataFrame, scores: DataFrame, k: int = 6, clip: bool = True, edges: DataFrame | None = None
) -> DataFrame:
    """Moran's I per (sample, pathway) of scores that are complete for every spot; negatives become 0."""
    edges = knn_edges(points, k) if edges is None else edges
    out = packed_morans(edges, pack_scores(scores), k)
    return named_morans(out, scores.agg(F.array_sort(F.collect_set("pathway")).alias("n")), clip)


def named_morans(stats: DataFrame, names: DataFrame, clip: bool = True) -> DataFrame:
    """Positions to pathway names; ``names`` is one row with the name array."""
    value = clipped_at_zero(F.col("morans_i")) if clip else F.col("morans_i")
    return stats.select(
        "sample_id", F.element_at(names.scalar(), F.col("pos") + 1).alias("pathway"), value.alias("morans_i"))


def mean_gene_morans(per_sample: DataFrame) -> DataFrame:
    """Mean over the samples that contain the gene."""
    return per_sample.groupBy("gene").agg(F.avg("morans_i").alias("morans_i"))


def coherence(truth: DataFrame, predicted: DataFrame, keys: str = "pathway", top_k: int = 50) -> DataFrame:
    """Pearson correlation of truth and prediction Moran's I over the ``top_k`` truth variables per sample.

    Both inputs have (sample_id, ``keys``, morans_i). Fewer than two variables or a constant side give 0.
    """
    best = Window.partitionBy("sample_id").orderBy(F.round("morans_i", 9).desc(), keys)
    top = (
        truth.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= top_k)
        .select("sample_id", keys, F.col("morans_i").alias("t"))
        .join(predicted.select("sample_id", keys, F.col("morans_i").alias("p")), ["sample_id", keys]))
    return top.groupBy("sample_id").agg(
        F.coalesce(pearson(F.col("t"), F.col("p"), 1e-12), F.lit(0.0)).alias("coherence"))


def spatial_coherence(points: DataFrame, predictions: DataFrame, k: int = 6, top_k: int = 50) -> DataFrame:
    """Coherence per sample of a (sample_id, barcode, pathway, pred, target) table over ``points``."""
    edges = knn_edges(points, k)
    width = predictions.groupBy(*SPOT).agg(
        F.array_sort(F.collect_list(F.struct("pathway", "target", "pred"))).alias("a"))
    both = width.select(*SPOT, F.concat(
        F.transform("a", lambda e: e.target), F.transform("a", lambda e: e.pred)).alias("v"), F.size("a").alias("p"))
    stats = packed_morans(edges, both.select(*SPOT, "v"), k)
    names = _names(predictions)
    n_names = names.agg(F.count(F.lit(1))).scalar()
    truth = stats.filter(F.col("pos") < n_names).join(names, "pos")
    pred = stats.withColumn("pos", (F.col("pos") - n_names).cast("int")).join(names, "pos")
    return coherence(truth, pred, "pathway", top_k)
