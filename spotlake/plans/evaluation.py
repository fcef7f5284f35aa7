"""Evaluation report per slide and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators import metrics, moran

MEASURES = ("mse", "mae", "pcc_loss", "val_pcc", "pred_variance", "coherence", "attn_corr")


def evaluate_slides(
    predictions: DataFrame, points: DataFrame | None = None, attention: DataFrame | None = None, k: int = 6
) -> DataFrame:
    """One row per slide. Coherence needs ``points``, attention correlation needs ``attention``."""
    report, parts = metrics.slide_report(predictions), []
    if points is not None:
        parts.append(moran.spatial_coherence(points, predictions, k))
    if attention is not None:
        parts.append(metrics.attention_correlation(attention, predictions))
    for part in parts:
        report = report.join(part, "sample_id", "left")
    return report


def evaluate_overall(slides: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Means over slides; a slide without a value does not count, nor (by default) a coherence of exactly 0."""
    have = [c for c in MEASURES if c in slides.columns]
    pick = {c: F.col(c) for c in have}
    if drop_zero and "coherence" in pick:
        pick["coherence"] = F.when(F.col("coherence") != 0, F.col("coherence"))
    return slides.agg(*[F.avg(pick[c]).alias(c) for c in have], F.count(F.lit(1)).alias("n_slides"))
