"""Gene totals, hybrid ranks, vocabularies and top-n reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.index import position


def gene_totals(expr: DataFrame) -> DataFrame:
    return expr.groupBy("gene").agg(F.sum("count").alias("total_counts"))


def gene_ranks(genes: DataFrame) -> DataFrame:
    """0-based descending ranks by total_counts and by morans_i; ties go by gene name."""
    filled = genes.withColumn("morans_i", F.coalesce("morans_i", F.lit(0.0)))
    ranked = position(filled, [], [-F.col("total_counts"), F.col("gene")], "expr_rank")
    return position(ranked, [], [-F.round("morans_i", 9), F.col("gene")], "moran_rank")


def hybrid_order(ranked: DataFrame, svg_weight: float) -> DataFrame:
    """Lower is better: (1-w) * expression rank + w * Moran rank."""
    w = float(svg_weight)
    return ranked.withColumn(
        "hybrid", F.lit(1 - w) * F.col("expr_rank") + F.lit(w) * F.col("moran_rank"))


def vocabulary(ordered: DataFrame, priority: DataFrame, num_genes: int) -> DataFrame:
    """Prioritised genes that occur in the data first, then the best others, up to ``num_genes``.

    Prioritised genes are never cut off. ``ordered`` has (gene, hybrid, ...); result has a 0-based pos.
    """
    flagged = ordered.join(
        priority.select("gene").distinct().withColumn("__p", F.lit(1)), "gene", "left"
    ).withColumn("priority", F.col("__p").isNotNull()).drop("__p")
    placed = position(flagged, [], [(~F.col("priority")).cast("int"), F.col("hybrid"), F.col("gene")], "pos")
    return placed.filter(F.col("priority") | (F.col("pos") < F.lit(num_genes)))


def top_genes_per_sample(expr: DataFrame, n: int) -> DataFrame:
    """The n genes with most counts in each sample; per-sample groups are bounded by the gene panel."""
    totals = expr.groupBy("sample_id", "gene").agg(F.sum("count").alias("total_counts"))
    best = Window.partitionBy("sample_id").orderBy(F.col("total_counts").desc(), "gene")
    return totals.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)


def top_variables(stats: DataFrame, k: int, name: str = "gene", value: str = "morans_i") -> DataFrame:
    """The k variables with the highest statistic per sample (panel-bounded groups)."""
    best = Window.partitionBy("sample_id").orderBy(F.round(value, 9).desc(), name)
    return stats.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def first_names(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.select(column).distinct().orderBy(column).limit(n)
