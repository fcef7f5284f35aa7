"""Gene vocabulary: totals (and Moran means) -> hybrid rank -> prioritised top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators import moran, ranking
from spotlake.session import materialise


def build_vocabulary(
    obs: DataFrame, var: DataFrame, expr: DataFrame, priority: DataFrame | None = None, num_genes: int = 1000,
    svg_weight: float = 0.0, k: int = 6,
) -> DataFrame:
    """(pos, gene, total_counts, morans_i, priority). Moran's I is computed only when it has weight."""
    if svg_weight > 0:
        expr = materialise(expr.select("sample_id", "barcode", "gene", "count"))  # read for the totals and for Moran's I
    totals = ranking.gene_totals(expr)
    if svg_weight > 0:
        values = expr.select("sample_id", "barcode", "gene", F.col("count").alias("x"))
        means = moran.mean_gene_morans(moran.gene_morans(obs, values, var, k))
        totals = totals.join(means, "gene", "left")
    else:
        totals = totals.withColumn("morans_i", F.lit(None).cast("double"))
    totals = materialise(totals)  # one row per gene, ranked twice and placed once
    ordered = ranking.hybrid_order(ranking.gene_ranks(totals), svg_weight)
    if priority is None:
        priority = totals.filter(F.lit(False)).select("gene")
    return ranking.vocabulary(ordered, priority, num_genes).select(
        "pos", "gene", "total_counts", "morans_i", "priority")
