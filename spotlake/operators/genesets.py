"""Gene-set collections: merging, filtering, coverage; and set algebra on gene lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.session import dealt


def _merged(gene_sets: DataFrame, order: str, pick) -> DataFrame:
    chosen = gene_sets.groupBy("pathway").agg(pick(order).alias(order))
    return gene_sets.join(chosen, ["pathway", order], "left_semi")


def merge_first(gene_sets: DataFrame, order: str = "pos") -> DataFrame:
    """Of several collections that define a set, the first in ``order`` counts."""
    return _merged(gene_sets, order, F.min)


def merge_last(gene_sets: DataFrame, order: str = "pos") -> DataFrame:
    return _merged(gene_sets, order, F.max)


def named_sets(gene_sets: DataFrame, names: DataFrame) -> DataFrame:
    """Only the named sets; an empty result is an error."""
    kept = gene_sets.join(names.select("pathway").distinct(), "pathway", "left_semi")
    if not kept.take(1):
        raise ValueError("none of the requested gene sets exists")
    return kept


def coverage(gene_sets: DataFrame, genes: DataFrame) -> DataFrame:
    """How many genes of a list are in at least one set."""
    listed = genes.select("gene").distinct()
    member = gene_sets.select("gene").distinct().withColumn("__m", F.lit(1))
    return listed.join(member, "gene", "left").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("__m").alias("n_covered"),
        F.try_divide(F.count("__m") * 100.0, F.count(F.lit(1))).alias("pct_covered"))


def matched_per_set(gene_sets: DataFrame, genes: DataFrame) -> DataFrame:
    sets = gene_sets.select("pathway", "gene").distinct()
    hit = genes.select("gene").distinct().withColumn("__m", F.lit(1))
    return sets.join(hit, "gene", "left").groupBy("pathway").agg(
        F.count("__m").alias("n_matched"), F.count(F.lit(1)).alias("n_genes"))


def sample_coverage(gene_sets: DataFrame, var: DataFrame) -> DataFrame:
    """Share of the distinct collection genes that each sample measures."""
    wanted = dealt(gene_sets.select("gene"), "gene").distinct()
    total = wanted.agg(F.count(F.lit(1))).scalar()
    return (
        dealt(var.select("sample_id", "gene"), "gene").distinct()
        .join(wanted.withColumn("__m", F.lit(1)).hint("merge"), "gene", "left")
        .groupBy("sample_id").agg(F.count("__m").alias("n_found"))
        .select("sample_id", "n_found", total.alias("n_wanted"),
                F.try_divide(F.col("n_found").cast("double"), total).alias("coverage")))


def in_all(lists: DataFrame, item: str = "gene", owner: str = "sample_id") -> DataFrame:
    """Items that every owner has (n-way intersection, by counting)."""
    pairs = dealt(lists.select(owner, item), item).distinct()
    owners = lists.select(owner).distinct().agg(F.count(F.lit(1))).scalar()
    return pairs.groupBy(item).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == owners).select(item)


def in_any(lists: DataFrame, item: str = "gene") -> DataFrame:
    return lists.select(item).distinct()


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_anti")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def set_symbols(gene_sets: DataFrame, pathways: Column | None = None) -> DataFrame:
    """Distinct genes of the (filtered) sets; the prioritised genes of a vocabulary."""
    kept = gene_sets if pathways is None else gene_sets.filter(pathways)
    return kept.select("gene").distinct()
