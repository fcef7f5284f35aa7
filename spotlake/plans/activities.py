"""Flagship plan: QC, normalisation, pathway scores and Moran weights for all samples at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators import moran, qc, scoring
from spotlake.operators.knn import knn_edges
from spotlake.session import materialise


@dataclass(frozen=True)
class Thresholds:
    min_umis: float | None = 500
    min_genes: float | None = 200
    max_mt: float | None = 0.15
    min_set_genes: int = 5
    min_pathways: int = 25
    k: int = 6


@dataclass(frozen=True)
class Activities:
    scores: DataFrame
    morans: DataFrame | None
    attrs: DataFrame
    rejected: DataFrame


def pathway_activities(
    obs: DataFrame, var: DataFrame, expr: DataFrame, gene_sets: DataFrame, t: Thresholds = Thresholds(),
    with_morans: bool = True,
) -> Activities:
    """Scores of all samples in one plan; samples that cannot be scored are listed, not raised.

    Where a panel lists a symbol twice, ``var`` and ``expr`` carry ``pos`` and the last row counts.
    A sample is rejected when no spot passes QC, or when fewer than ``min_pathways`` sets are scorable.
    """
    if "pos" in var.columns and "pos" in expr.columns:
        expr = scoring.last_symbols(expr, var)
    counts = qc.passing_counts(expr, t.min_umis, t.min_genes, t.max_mt)
    passed = qc.passing_spots_of(obs, expr, counts, t.min_umis, t.min_genes, t.max_mt)
    sizes = scoring.set_sizes(obs, var, gene_sets, t.min_set_genes)
    n_scored = scoring.scored_counts(sizes)
    enough = n_scored.filter(F.col("n_scored") >= t.min_pathways).select("sample_id")
    wanted = [df.join(enough, "sample_id", "left_semi") for df in (passed, scoring.normalise(counts), sizes)]
    packed = scoring.packed_scores(wanted[0], wanted[1], gene_sets, wanted[2])
    morans = None
    if with_morans:
        # read by the neighbour join and by both ends of the edge join
        packed = materialise(packed)
        values = packed.select("sample_id", "barcode", F.transform("s", lambda e: e.score).alias("v"))
        names = gene_sets.agg(F.array_sort(F.collect_set("pathway")).alias("n"))
        morans = moran.named_morans(moran.packed_morans(knn_edges(packed, t.k), values, t.k), names)
    scores = scoring.unpacked(packed)
    before = obs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots_before_qc"))
    after = passed.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots_after_qc"))
    state = before.join(after, "sample_id", "left").join(n_scored, "sample_id", "left").na.fill(
        {"n_spots_after_qc": 0, "n_scored": 0})
    alive = (F.col("n_scored") >= t.min_pathways) & (F.col("n_spots_after_qc") > 0)
    attrs = state.filter(alive).select(
        "sample_id", "n_spots_before_qc", "n_spots_after_qc",
        F.lit(t.min_umis).cast("double").alias("qc_min_umis"), F.lit(t.min_genes).cast("double").alias("qc_min_genes"),
        F.lit(t.max_mt).cast("double").alias("qc_max_mt"), F.col("n_scored").alias("n_scored_pathways"))
    rejected = state.filter(~alive).select(
        "sample_id",
        F.when(F.col("n_spots_after_qc") == 0, "no spot passes quality control")
        .otherwise("too few scorable pathways").alias("reason"))
    return Activities(scores, morans, attrs, rejected)
