"""Composite reports: QC audit, run comparison, gene availability, sample card, training-set selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.operators import genesets, qc, ranking, registry, runs, splitting
from spotlake.session import materialise


def qc_audit(obs: DataFrame, expr: DataFrame, min_umis=500, min_genes=200, max_mt=0.15, worst: int = 15):
    """(report per sample, summary, worst samples)."""
    report = materialise(qc.qc_report(obs, expr, min_umis, min_genes, max_mt))  # one row per sample, read three times
    return report, qc.qc_summary(report), qc.worst_samples(report, worst)


def compare_runs(log: DataFrame, names: list[str], window: int = 5, selected: list[str] | None = None):
    """(smoothed curves, KPI cards, export table) of the selected runs."""
    # three results come from the deduplicated cells: read the raw log once
    cells = materialise(runs.latest_cells(runs.only_runs(log, selected) if selected else log))
    table = runs.wide(cells, names)
    return runs.moving_average(cells, window), runs.last_rows(table, names), table


def gene_availability(samples: DataFrame, var: DataFrame, expr: DataFrame, technology: str, n: int = 1000) -> DataFrame:
    """How many genes all (or any) samples share, by panel and by top-n, for all and one technology.

    Panels and top lists pass one grouping by gene that counts for both scopes at once.
    """
    inside = registry.by_technology(samples, technology).select("sample_id", F.lit(True).alias("inside"))
    keep = samples.select("sample_id").join(inside, "sample_id", "left").withColumn("inside", F.col("inside").isNotNull())
    top = ranking.top_genes_per_sample(expr, n).select("sample_id", "gene", F.lit("top").alias("basis"))
    lists = var.select("sample_id", "gene").distinct().withColumn("basis", F.lit("panel")).unionByName(top)
    # an owner is a sample that has a list at all
    owners = lists.select("basis", "sample_id").distinct().join(keep, "sample_id").agg(F.struct(*[
        F.count_if((F.col("basis") == basis) & (F.col("inside") | F.lit(scope == "all"))).alias(f"{basis}_{scope}")
        for basis in ("panel", "top") for scope in ("all", "inside")])).scalar()

    def total(scope: str):
        return F.when(F.col("basis") == "panel", owners.getField(f"panel_{scope}")).otherwise(owners.getField(f"top_{scope}"))

    genes = lists.join(keep, "sample_id").groupBy("basis", "gene").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"))
    counts = genes.groupBy("basis").agg(F.array(*[
        F.struct(F.lit(scope).alias("scope"), F.lit(rule).alias("rule"), F.count_if(holds).alias("n_genes"))
        for scope, seen, every in (("all", F.col("n"), total("all")), (technology, F.col("n_inside"), total("inside")))
        for rule, holds in (("in_all", (seen == every) & (seen > 0)), ("in_any", seen > 0))]).alias("c"))
    return counts.select("basis", F.inline("c")).select("scope", "basis", "rule", "n_genes")


def sample_card(
    samples: DataFrame, obs: DataFrame, var: DataFrame, gene_sets: DataFrame, features: DataFrame,
    chosen_images: DataFrame,
) -> DataFrame:
    """Dimensions, image, set coverage and file availability per sample."""
    spots = obs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"))
    genes = var.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_genes"))
    have = features.select("sample_id").distinct().withColumn("__f", F.lit(True))
    return (
        samples.select("sample_id", "id").join(spots, "sample_id", "left").join(genes, "sample_id", "left")
        .join(genesets.sample_coverage(gene_sets, var).select("sample_id", "n_found", "coverage"), "sample_id", "left")
        .join(chosen_images.select("sample_id", "image_key", "scalef"), "sample_id", "left")
        .join(have, "sample_id", "left")
        .select("sample_id", "id", "n_spots", "n_genes", "n_found", "coverage", "image_key", "scalef",
                F.col("__f").isNotNull().alias("has_features")))


def full_sample_card(card: DataFrame, images: DataFrame, scalefactors: DataFrame, files: DataFrame) -> DataFrame:
    """Add all images with their shapes, all scale factors, and the kinds of stored files of each sample.

    ``files`` has (sample_id, kind, n_files, size), as from a listing. The arrays are in order of their names; a sample that has
    none of a sort gets an empty array.
    """
    parts = {"images": (images, ["image_key", "h", "w"]), "scalefactors": (scalefactors, ["key", "value"]), "files": (files, ["kind", "n_files", "size"])}
    for name, (table, fields) in parts.items():
        # one group is one sample: a handful of images, factors or kinds
        found = table.where("sample_id IS NOT NULL").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        card = card.join(found, "sample_id", "left").withColumn(name, F.coalesce(name, F.array().cast(found.schema[name].dataType)))
    return card


def training_selection(
    samples: DataFrame, files: DataFrame, features: DataFrame | None = None, organ: str | None = None,
    val_ratio: float = 0.2, seed: int = 42,
) -> DataFrame:
    """Discover, filter and split: (sample_id, id, split). The split is drawn on the whole registry."""
    chosen = registry.sample_ids(samples, files, organ, features)
    split = splitting.patient_split(samples, val_ratio, 0.0, seed)
    ids = samples.select("sample_id", "id").join(chosen, "sample_id", "left_semi")
    return ids.join(split.select("id", "split"), "id").select("sample_id", "id", "split")


def training_rows(
    selection: DataFrame, features: DataFrame, activities: DataFrame, obs: DataFrame
) -> DataFrame:
    """Long training rows (spot, features, pathway, score, split) of spots known to the expression table."""
    spots = features.join(obs.select("sample_id", "barcode"), ["sample_id", "barcode"], "left_semi")
    return (
        spots.join(selection.select("sample_id", "split"), "sample_id")
        .join(activities, ["sample_id", "barcode"])
        .select("sample_id", "barcode", "x", "y", "features", "pathway", "score", "split"))
