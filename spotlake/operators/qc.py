"""Spot quality control on raw counts, library sizes and audit reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.functions.scalars import is_mt_prefix, is_mt_substring

SPOT = ["sample_id", "barcode"]


def spot_metrics(obs: DataFrame, expr: DataFrame, mt_rule: str = "prefix") -> DataFrame:
    """UMIs, detected genes, mitochondrial counts and share per spot; spots without counts get zeros."""
    is_mt = is_mt_prefix(F.col("gene")) if mt_rule == "prefix" else is_mt_substring(F.col("gene"))
    sums = expr.groupBy(*SPOT).agg(
        F.sum("count").alias("umis"),
        F.count_if(F.col("count") > 0).alias("n_genes"),
        F.sum(F.when(is_mt, F.col("count")).otherwise(0.0)).alias("mt_counts"),
    )
    return (
        obs.select(*SPOT)
        .join(sums.hint("merge"), SPOT, "left")  # spots grow with the data, so neither side is broadcast
        .na.fill({"umis": 0.0, "n_genes": 0, "mt_counts": 0.0})
        .withColumn("mt_frac", F.col("mt_counts") / (F.col("umis") + F.lit(1e-9)))
    )


def library_size(expr: DataFrame) -> DataFrame:
    return expr.groupBy(*SPOT).agg(F.sum("count").alias("library"))


def passes(min_umis: float | None, min_genes: float | None, max_mt: float | None):
    """The spot predicate; a threshold of None is not tested."""
    ok = F.lit(True)
    if min_umis is not None:
        ok = ok & (F.col("umis") >= F.lit(float(min_umis)))
    if min_genes is not None:
        ok = ok & (F.col("n_genes") >= F.lit(int(min_genes)))
    if max_mt is not None:
        ok = ok & (F.col("mt_frac") <= F.lit(float(max_mt)))
    return ok


def passing_spots(
    obs: DataFrame, expr: DataFrame, min_umis: float | None = 500, min_genes: float | None = 200,
    max_mt: float | None = 0.15,
) -> DataFrame:
    """Rows of ``obs`` whose spot passes; QC always comes before any normalisation.

    Without a mitochondrial gene every share is 0, so that test then passes by itself.
    """
    kept = spot_metrics(obs, expr).filter(passes(min_umis, min_genes, max_mt)).select(*SPOT)
    return obs.join(kept.hint("merge"), SPOT, "left_semi")


def passing_counts(
    expr: DataFrame, min_umis: float | None, min_genes: float | None, max_mt: float | None
) -> DataFrame:
    """Counts of passing spots with their library size, in one shuffle by spot.

    The window groups are single spots, so their size is bounded by the gene panel. Spots without any
    count have no rows here; use :func:`passing_spots` for the spot universe.
    """
    spot = Window.partitionBy(*SPOT)
    umis = F.sum("count").over(spot)
    return (
        expr.select(
            *SPOT, "gene", "count", umis.alias("umis"),
            F.count_if(F.col("count") > 0).over(spot).alias("n_genes"),
            (F.sum(F.when(is_mt_prefix(F.col("gene")), F.col("count")).otherwise(0.0)).over(spot)
             / (umis + F.lit(1e-9))).alias("mt_frac"),
        )
        .filter(passes(min_umis, min_genes, max_mt))
        .select(*SPOT, "gene", "count", F.col("umis").alias("library"))
    )


def passing_spots_of(
    obs: DataFrame, expr: DataFrame, counts: DataFrame, min_umis: float | None, min_genes: float | None,
    max_mt: float | None,
) -> DataFrame:
    """The passing spots, read off ``counts`` (see :func:`passing_counts`) where that is enough.

    A spot without counts is absent from ``counts``; only thresholds that let it pass need a second look
    at ``expr``. Testing ``gene`` keeps the shuffled columns equal, so both uses share one exchange.
    """
    if (min_umis or 0) <= 0 and (min_genes or 0) <= 0:
        return passing_spots(obs, expr, min_umis, min_genes, max_mt)
    kept = counts.filter(F.col("gene").isNotNull()).select(*SPOT).distinct()
    return obs.join(kept.hint("merge"), SPOT, "left_semi")


def empty_samples(obs: DataFrame, kept: DataFrame) -> DataFrame:
    """Samples that lose every spot."""
    return obs.select("sample_id").distinct().join(kept.select("sample_id").distinct(), "sample_id", "left_anti")


def qc_report(
    obs: DataFrame, expr: DataFrame, min_umis: float = 500, min_genes: float = 200, max_mt: float = 0.15
) -> DataFrame:
    """Audit per sample, with the substring rule for mitochondrial genes."""
    m = spot_metrics(obs, expr, "substring")
    return m.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passes(min_umis, min_genes, max_mt)).alias("kept"),
        F.count_if(F.col("umis") < min_umis).alias("low_umi"),
        F.count_if(F.col("n_genes") < min_genes).alias("low_gene"),
        F.count_if(F.col("mt_frac") > max_mt).alias("high_mt"),
    ).withColumn("kept_share", F.coalesce(F.try_divide(F.col("kept").cast("double"), F.col("total")), F.lit(0.0)))


def qc_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.avg("kept_share").alias("mean_share"), F.min("kept_share").alias("min_share"),
        F.max("kept_share").alias("max_share"), F.count(F.lit(1)).alias("n_samples"),
    )


def worst_samples(report: DataFrame, n: int = 15) -> DataFrame:
    return report.orderBy("kept_share", "sample_id").limit(n)


def expression_statistics(obs: DataFrame, var: DataFrame, expr: DataFrame) -> DataFrame:
    """Non-zero statistics, sparsity and gene mean/variance ranges per sample, without dense rows."""
    stored = expr.filter(F.col("count") != 0)
    n_obs = obs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_obs"))
    gene = stored.groupBy("sample_id", "gene").agg(
        F.count(F.lit(1)).alias("m"), F.avg("count").alias("mu"), F.var_pop("count").alias("v"),
        F.sum("count").alias("s"), F.max("count").alias("hi"), F.min("count").alias("lo"))
    n, m = F.col("n_obs"), F.coalesce(F.col("m"), F.lit(0))
    mu, v = F.coalesce(F.col("mu"), F.lit(0.0)), F.coalesce(F.col("v"), F.lit(0.0))
    # left join from var: a gene without counts has mean and variance 0 and takes part in the ranges
    per_gene = var.join(gene, ["sample_id", "gene"], "left").join(n_obs, "sample_id").select(
        "sample_id", "n_obs", m.alias("m"), F.coalesce(F.col("s"), F.lit(0.0)).alias("s"), "hi", "lo",
        (mu * m / n).alias("gene_mean"), ((v * m + m * (n - m) / n * mu * mu) / n).alias("gene_var"))
    return per_gene.groupBy("sample_id").agg(
        F.sum("m").alias("n_nonzero"),
        F.try_divide(F.sum("s"), F.sum("m")).alias("nonzero_mean"),
        F.max("hi").alias("nonzero_max"),
        F.min("lo").alias("nonzero_min"),
        (F.lit(1.0) - F.sum("m") / F.sum("n_obs")).alias("sparsity"),
        F.min("gene_mean").alias("gene_mean_min"), F.max("gene_mean").alias("gene_mean_max"),
        F.min("gene_var").alias("gene_var_min"), F.max("gene_var").alias("gene_var_max"),
        (F.max("gene_var") / (F.min("gene_var") + F.lit(1e-8))).alias("var_ratio"),
    )
