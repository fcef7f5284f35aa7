"""Gene-set (pathway) activity scores on sparse counts.

With n spots, mean mu and deviation sigma per (sample, gene), the mean z-score of a set over a spot is

    ( sum of x/sigma over stored counts  -  sum of mu/sigma over member genes ) / member genes present

The second sum is one number per (sample, set), so nothing is ever expanded to spots x genes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.functions.aggregates import centred_square_sum
from spotlake.functions.scalars import log_normalised
from spotlake.operators.align import with_each
from spotlake.session import dealt

SPOT = ["sample_id", "barcode"]


def normalise(counts: DataFrame, target_sum: float = 10000.0) -> DataFrame:
    """``counts`` with columns count and library -> column x."""
    return counts.select(*SPOT, "gene", log_normalised(F.col("count"), F.col("library"), target_sum).alias("x"))


def last_symbols(expr: DataFrame, var: DataFrame) -> DataFrame:
    """Counts of the last ``var`` row of each (sample, gene), for panels that list a symbol twice.

    Both tables carry the position ``pos`` of the row in ``var``. What goes is the short list of earlier rows, so
    the counts meet it in an anti join and are not grouped; a last row without a count in a spot means 0 there.
    """
    rows = dealt(var.select("sample_id", "gene", "pos"), "sample_id", "gene").distinct()
    last = rows.groupBy("sample_id", "gene").agg(F.max("pos").alias("__last"), F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    earlier = rows.join(last, ["sample_id", "gene"]).filter("pos < __last").select("sample_id", "gene", "pos")
    return expr.join(earlier, ["sample_id", "gene", "pos"], "left_anti")


def gene_moments(x: DataFrame, n_spots: DataFrame) -> DataFrame:
    """Mean and population deviation per (sample, gene), zeros included; a zero deviation becomes 1."""
    stored = x.groupBy("sample_id", "gene").agg(
        F.count(F.lit(1)).alias("m"), F.avg("x").alias("mu_stored"), F.var_pop("x").alias("v_stored"))
    m, n = F.col("m").cast("double"), F.col("n_spots").cast("double")
    n = F.when(m > n, F.raise_error(F.lit("a gene has several counts in one spot; see last_symbols"))).otherwise(n)
    variance = centred_square_sum(F.col("mu_stored"), F.col("v_stored"), m, n) / n
    return stored.join(n_spots, "sample_id").select(
        "sample_id", "gene", (F.col("mu_stored") * m / n).alias("mu"),
        F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("sigma"))


def set_weights(gene_sets: DataFrame) -> DataFrame:
    """(pathway, gene, times, weight): a gene listed twice in a set counts twice.

    An optional ``weight`` column of the sets turns the plain mean into a weighted mean. It grows with the gene panel, and its
    file is much smaller than its rows, so joins by gene are merge joins: the driver never holds it for a broadcast.
    """
    weight = F.sum("weight") if "weight" in gene_sets.columns else F.count(F.lit(1)).cast("double")
    return dealt(gene_sets, "gene").groupBy("pathway", "gene").agg(F.count(F.lit(1)).alias("times"), weight.alias("weight"))


def set_sizes(samples: DataFrame, var: DataFrame, gene_sets: DataFrame, min_genes: int = 5) -> DataFrame:
    """(sample_id, pathway, n_genes, total_weight, scored) for every set and sample; reads no counts.

    A set without any member present is listed with 0 genes.
    """
    panels = dealt(var.select("sample_id", "gene"), "gene").distinct()
    present = panels.join(set_weights(gene_sets).hint("merge"), "gene").groupBy("sample_id", "pathway").agg(
        F.sum("times").alias("n_genes"), F.sum("weight").alias("total_weight"))
    return (
        with_each(samples.select("sample_id").distinct(), gene_sets, "pathway")
        .join(present, ["sample_id", "pathway"], "left")
        .na.fill({"n_genes": 0, "total_weight": 1.0})
        .withColumn("scored", F.col("n_genes") >= F.lit(min_genes)))


def packed_scores(
    spots: DataFrame, x: DataFrame, gene_sets: DataFrame, sizes: DataFrame
) -> DataFrame:
    """``spots`` plus ``s``, an array of (pathway, score) in name order with all sets of the catalogue.

    The sets of a gene are attached to its moments first, so counts are shuffled twice: by (sample, gene) to meet
    both at once, and by spot to be summed. The complete result has one row per spot. Sets that are not scored hold 0.
    """
    n_spots = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"))
    weights = set_weights(gene_sets)
    moments = gene_moments(x, n_spots)
    # genes without counts have mean 0 and need no row here
    shift = moments.join(weights.hint("merge"), "gene").groupBy("sample_id", "pathway").agg(
        F.sum(F.col("weight") * F.col("mu") / F.col("sigma")).alias("shift"))
    sets = sizes.join(shift, ["sample_id", "pathway"], "left").groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "pathway", "scored", F.coalesce("shift", F.lit(0.0)).alias("shift"), "total_weight"))).alias("sets"))
    sets_of_gene = weights.groupBy("gene").agg(F.collect_list(F.struct("pathway", "weight")).alias("of"))
    scaled = moments.join(sets_of_gene.hint("merge"), "gene").select("sample_id", "gene", "sigma", "of")
    part = (
        x.join(scaled, ["sample_id", "gene"])
        .select(*SPOT, (F.col("x") / F.col("sigma")).alias("xs"), F.inline("of"))
        .repartition(*SPOT)  # serves both groupings below
        .groupBy(*SPOT, "pathway").agg(F.sum(F.col("xs") * F.col("weight")).alias("part"))
        .groupBy(*SPOT).agg(F.collect_list(F.struct("pathway", F.lit(False).alias("zero"), "part")).alias("parts")))

    def every_set(merged):
        # a sum stands before the zero of its set; the first entry of each set counts
        first = F.filter(merged, lambda e, i: (i == 0) | (F.get(merged, i - 1)["pathway"] != e.pathway))
        return F.transform(first, lambda e: e.part)

    zeros = F.transform("sets", lambda e: F.struct(e.pathway.alias("pathway"), F.lit(True).alias("zero"), F.lit(0.0).alias("part")))
    merged = F.sort_array(F.concat(F.coalesce("parts", F.array().cast("array<struct<pathway:string,zero:boolean,part:double>>")), zeros))
    sums = F.transform(F.array(merged), every_set)[0]  # sorted once for all sets

    def score(e, got):
        return F.struct(e.pathway.alias("pathway"), F.when(
            e.scored, (got - e.shift) / e.total_weight).otherwise(0.0).alias("score"))

    return spots.join(part, SPOT, "left").join(sets, "sample_id").select(
        *spots.columns, F.zip_with("sets", sums, score).alias("s"))


def unpacked(packed: DataFrame) -> DataFrame:
    return packed.select(*SPOT, F.explode("s").alias("e")).select(*SPOT, "e.pathway", "e.score")


def score_pathways(
    spots: DataFrame, x: DataFrame, var: DataFrame, gene_sets: DataFrame, min_genes: int = 5
) -> tuple[DataFrame, DataFrame]:
    """Scores per (spot, pathway) and the set sizes per sample.

    Sets with fewer than ``min_genes`` members present score 0 everywhere and are not counted as scored.
    """
    sizes = set_sizes(spots, var, gene_sets, min_genes)
    scores = unpacked(packed_scores(spots.select(*SPOT), x, gene_sets, sizes))
    return scores, sizes.select("sample_id", "pathway", "n_genes", "scored")


def scored_counts(per_sample: DataFrame) -> DataFrame:
    return per_sample.groupBy("sample_id").agg(
        F.count_if("scored").alias("n_scored"), F.count_if(~F.col("scored")).alias("n_unscored"))


def pathway_ranges(scores: DataFrame) -> DataFrame:
    """Min, mean and max per (sample, pathway); all-zero columns are left out."""
    return (
        scores.groupBy("sample_id", "pathway")
        .agg(F.min("score").alias("min_score"), F.avg("score").alias("mean_score"),
             F.max("score").alias("max_score"), F.max(F.abs(F.col("score"))).alias("__top"))
        .filter(F.col("__top") > 0).drop("__top"))
