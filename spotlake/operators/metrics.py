"""Evaluation metrics on a long prediction table (sample_id, barcode, pathway, pred, target[, mask])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions import aggregates as A

PRED, TARGET = "pred", "target"


def valid_rows(predictions: DataFrame) -> DataFrame:
    """Rows that are not padding; a mask of true marks padding."""
    return predictions.filter(~F.col("mask")) if "mask" in predictions.columns else predictions


def _cols():
    return F.col(PRED), F.col(TARGET)


def masked_mse(predictions: DataFrame) -> DataFrame:
    return valid_rows(predictions).agg(A.mse(*_cols()).alias("mse"))


def weighted_mse(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """``weights`` has (pathway, weight)."""
    return valid_rows(predictions).join(weights, "pathway").agg(
        A.weighted_mse(*_cols(), F.col("weight")).alias("weighted_mse"))


def slide_pcc(predictions: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Correlation per (sample, pathway), with what decides whether a pathway is active."""
    p, t = _cols()
    return valid_rows(predictions).groupBy("sample_id", "pathway").agg(
        F.count(F.lit(1)).alias("n"), A.pcc(p, t, eps).alias("pcc"), F.stddev_samp(t).alias("target_std"))


def pcc_loss(predictions: DataFrame, eps: float = 1e-8) -> DataFrame:
    """1 - mean correlation; a constant column counts as correlation 0.

    When every sample has one row, pathways are correlated across the samples; fewer than two rows
    then give loss 0.
    """
    p, t = _cols()
    rows = valid_rows(predictions)
    within = slide_pcc(predictions, eps).agg(F.avg("pcc").alias("w"), F.max("n").alias("n_max"))
    across = rows.groupBy("pathway").agg(F.count(F.lit(1)).alias("n"), A.pcc(p, t, eps).alias("pcc")).agg(
        F.avg("pcc").alias("a"), F.max("n").alias("n_all"))
    a = across.select(F.struct("a", "n_all")).scalar()
    return within.select(
        F.when(F.col("n_max") > 1, 1 - F.col("w")).when(a.getField("n_all") < 2, F.lit(0.0))
        .otherwise(1 - a.getField("a")).alias("pcc_loss"))


def composite_loss(predictions: DataFrame, alpha: float = 1.0, weights: DataFrame | None = None) -> DataFrame:
    """MSE (weighted when weights are given) + alpha * PCC loss."""
    first = masked_mse(predictions) if weights is None else weighted_mse(predictions, weights).withColumnRenamed(
        "weighted_mse", "mse")
    return first.select("mse", pcc_loss(predictions).scalar().alias("pcc_loss")).withColumn(
        "loss", F.col("mse") + F.lit(float(alpha)) * F.col("pcc_loss"))


def robust_losses(predictions: DataFrame) -> DataFrame:
    p, t = _cols()
    return valid_rows(predictions).agg(A.huber(p, t).alias("huber"), A.poisson_nll(p, t).alias("poisson_nll"))


def mean_absolute_error(predictions: DataFrame) -> DataFrame:
    return valid_rows(predictions).agg(A.mae(*_cols()).alias("mae"))


def active_pathways(predictions: DataFrame, min_std: float = 1e-6) -> DataFrame:
    """(sample, pathway) whose target varies and whose correlation is finite; slides with < 2 spots drop out."""
    return slide_pcc(predictions).filter(
        (F.col("n") >= 2) & (F.col("target_std") > min_std) & F.col("pcc").isNotNull() & ~F.isnan("pcc"))


def validation_pcc(predictions: DataFrame) -> DataFrame:
    """Per slide: mean over its active pathways."""
    return active_pathways(predictions).groupBy("sample_id").agg(F.avg("pcc").alias("val_pcc"))


def prediction_variance(predictions: DataFrame) -> DataFrame:
    """Sample variance over spots per pathway, averaged per slide; slides with < 2 spots drop out."""
    return (
        valid_rows(predictions).groupBy("sample_id", "pathway")
        .agg(F.count(F.lit(1)).alias("n"), F.var_samp(PRED).alias("v")).filter(F.col("n") >= 2)
        .groupBy("sample_id").agg(F.avg("v").alias("pred_variance")))


def attention_correlation(attention: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pearson correlation per slide of attention and the spot's summed target; constant slides drop out."""
    total = valid_rows(predictions).groupBy("sample_id", "barcode").agg(F.sum(TARGET).alias("t"))
    return (
        attention.join(total, ["sample_id", "barcode"]).groupBy("sample_id")
        .agg(A.pearson(F.col("attention"), F.col("t")).alias("attn_corr")).filter(F.col("attn_corr").isNotNull()))


def bag_target(predictions: DataFrame) -> DataFrame:
    return valid_rows(predictions).groupBy("sample_id", "pathway").agg(F.avg(TARGET).alias("bag_target"))


def mean_weights(morans: DataFrame) -> DataFrame:
    """One weight vector from the weights of many slides."""
    return morans.groupBy("pathway").agg(F.avg("morans_i").alias("weight"))


def colour_range(predictions: DataFrame) -> DataFrame:
    """Shared value range of truth and prediction per pathway."""
    return predictions.groupBy("pathway").agg(
        F.least(F.min(PRED), F.min(TARGET)).alias("v_min"), F.greatest(F.max(PRED), F.max(TARGET)).alias("v_max"))


def batch_summary(predictions: DataFrame) -> DataFrame:
    return predictions.agg(*[
        f(c).alias(f"{c}_{n}") for c in (PRED, TARGET) for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])


def slide_report(predictions: DataFrame, eps: float = 1e-8, min_std: float = 1e-6) -> DataFrame:
    """Losses, correlations and prediction variance per slide in one pass over the predictions.

    The same values as :func:`slide_losses`, :func:`slide_pcc`, :func:`validation_pcc` and
    :func:`prediction_variance` one by one.
    """
    p, t = _cols()
    per_pathway = valid_rows(predictions).groupBy("sample_id", "pathway").agg(
        F.count(F.lit(1)).alias("n"), A.pcc(p, t, eps).alias("pcc"), F.stddev_samp(t).alias("target_std"),
        F.var_samp(p).alias("v"), F.sum((p - t) * (p - t)).alias("sse"), F.sum(F.abs(p - t)).alias("sae"))
    active = (F.col("n") >= 2) & (F.col("target_std") > min_std) & ~F.isnan("pcc")
    return per_pathway.groupBy("sample_id").agg(
        (F.sum("sse") / F.sum("n")).alias("mse"), (F.sum("sae") / F.sum("n")).alias("mae"),
        (1 - F.avg("pcc")).alias("pcc_loss"), F.avg(F.when(active, F.col("pcc"))).alias("val_pcc"),
        F.avg(F.when(F.col("n") >= 2, F.col("v"))).alias("pred_variance"))


def slide_losses(predictions: DataFrame) -> DataFrame:
    """MSE and MAE with one slide as one batch."""
    p, t = _cols()
    return valid_rows(predictions).groupBy("sample_id").agg(A.mse(p, t).alias("mse"), A.mae(p, t).alias("mae"))


def zscores(values: DataFrame, keys: list[str], value: str = "score", eps: float = 1e-8) -> DataFrame:
    """(x - mean) / (population deviation + eps) per key group; constant groups give 0.

    The statistics are pre-aggregated and joined back, so a large group is never put into one task.
    """
    stats = values.groupBy(*keys).agg(F.avg(value).alias("__mu"), F.stddev_pop(value).alias("__sd"))
    return values.join(stats, keys).withColumn(
        "z", (F.col(value) - F.col("__mu")) / (F.col("__sd") + F.lit(eps))).drop("__mu", "__sd")
