"""Queries WIN-* and TOP-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.aggregates import GENE_DEV, GENE_MORANS, raw_values, report
from spotlake.catalog.bindings import Bindings
from spotlake.catalog.joins import _PSEUDO, gene_table
from spotlake.catalog.registry import query
from spotlake.operators import align, coordinates, genesets, index, knn, metrics, moran, ranking, registry, runs
from spotlake.plans.vocabulary import build_vocabulary


@query("win_01_gene_ranks", "SELECT * FROM d_ranks", r="total_counts morans_i", i="expr_rank moran_rank", d_ranks=_PSEUDO)
def _(b: Bindings):
    return ranking.gene_ranks(gene_table(b))


@query("win_02_hybrid_order", "SELECT gene, 0.7::DOUBLE * expr_rank + 0.3::DOUBLE * moran_rank AS hybrid FROM d_ranks", r="hybrid", d_ranks=_PSEUDO)
def _(b: Bindings):
    return ranking.hybrid_order(ranking.gene_ranks(gene_table(b)), 0.3).select("gene", "hybrid")


@query("win_03_gene_zscores", """SELECT sample_id, barcode, gene, (count - avg(count) OVER w) / (stddev_pop(count) OVER w + 1e-8::DOUBLE) AS z FROM b_expr
 WINDOW w AS (PARTITION BY sample_id, gene)""", r="z")
def _(b: Bindings):
    return metrics.zscores(b.expr, ["sample_id", "gene"], "count").select("sample_id", "barcode", "gene", "z")


@query("win_04_moving_average", """SELECT run_name, metric, epoch, value, avg(value) OVER (PARTITION BY run_name, metric ORDER BY epoch ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS smoothed
 FROM d_cells WHERE value IS NOT NULL""", r="value smoothed")
def _(b: Bindings):
    return runs.moving_average(runs.latest_cells(b.metrics_long), 5).select("run_name", "metric", "epoch", "value", "smoothed")


@query("win_05_coordinate_gaps", """SELECT sample_id, axis, v, v - lag(v) OVER (PARTITION BY sample_id, axis ORDER BY v) AS gap FROM (
 SELECT DISTINCT sample_id, 'x' AS axis, x AS v FROM b_features UNION ALL SELECT DISTINCT sample_id, 'y', y FROM b_features)""", r="v gap")
def _(b: Bindings):
    return coordinates.coordinate_gaps(b.features)


def losses(b: Bindings):
    return runs.latest_cells(b.metrics_long.filter("metric = 'click'")).select(
        "run_name", "epoch", F.col("value").alias("val_loss"))


@query("win_06_best_so_far", """SELECT run_name, epoch, val_loss, best_before, best_before IS NULL OR val_loss < best_before AS is_best FROM (
 SELECT *, min(val_loss) OVER (PARTITION BY run_name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM d_losses)""",
       r="val_loss best_before")
def _(b: Bindings):
    return runs.best_so_far(losses(b))


# Without min_delta the fold equals a window: the epochs since the last strict improvement.
EARLY_STOP = """SELECT run_name, min(epoch) FILTER (WHERE wait >= 3) AS stop_epoch FROM (
 SELECT run_name, epoch, row_number() OVER (PARTITION BY run_name, g ORDER BY epoch) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS wait FROM (
  SELECT *, sum(CASE WHEN best IS NULL OR val_loss < best THEN 1 ELSE 0 END) OVER (PARTITION BY run_name ORDER BY epoch) AS g FROM (
   SELECT *, min(val_loss) OVER (PARTITION BY run_name ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM d_losses))) GROUP BY 1"""


@query("win_07_early_stop", EARLY_STOP)
def _(b: Bindings):
    return runs.early_stop(losses(b), 3).select("run_name", "stop_epoch")


@query("win_08_slide_index", "SELECT sample_id, barcode, row_number() OVER (PARTITION BY sample_id ORDER BY barcode) - 1 AS idx FROM b_obs", i="idx")
def _(b: Bindings):
    return index.position(b.obs.select("sample_id", "barcode"), ["sample_id"], [F.col("barcode")], "idx")


@query("win_09_neighbour_rank", "SELECT sample_id, barcode, neighbor, rank FROM d_edges WHERE rank <= 3", i="rank")
def _(b: Bindings):
    return knn.knn_edges(b.obs, 3).select("sample_id", "barcode", "neighbor", "rank")


@query("top_01_vocabulary", """SELECT gene, priority, row_number() OVER (ORDER BY priority DESC, h, gene) - 1 AS pos FROM (
 SELECT gene, 0.7::DOUBLE * expr_rank + 0.3::DOUBLE * moran_rank AS h, gene IN (SELECT gene FROM b_gene_sets WHERE pathway = 'HALLMARK_TYPE_SMALL') AS priority FROM d_ranks)
 QUALIFY priority OR row_number() OVER (ORDER BY priority DESC, h, gene) <= 500""", i="pos", d_ranks=_PSEUDO)
def _(b: Bindings):
    ordered = ranking.hybrid_order(ranking.gene_ranks(gene_table(b)), 0.3)
    priority = genesets.set_symbols(b.gene_sets, F.col("pathway") == "HALLMARK_TYPE_SMALL")
    return ranking.vocabulary(ordered, priority, 500).select("gene", "priority", "pos")


@query("top_02_top_genes_per_sample", """SELECT sample_id, gene, total_counts, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total_counts DESC, gene) AS r
 FROM (SELECT sample_id, gene, sum(count) AS total_counts FROM b_expr GROUP BY 1, 2)) WHERE r <= 50""", r="total_counts", i="rank")
def _(b: Bindings):
    return ranking.top_genes_per_sample(b.expr, 50)


@query("top_03_worst_samples", "SELECT sample_id, kept_share, total - kept AS filtered FROM d_report ORDER BY kept_share, sample_id LIMIT 15",
       r="kept_share", i="filtered")
def _(b: Bindings):
    from spotlake.operators.qc import worst_samples

    return worst_samples(report(b)).select("sample_id", "kept_share", (F.col("total") - F.col("kept")).alias("filtered"))


@query("top_04_first_samples", "SELECT sample_id FROM b_samples WHERE species = 'Homo sapiens' ORDER BY sample_id LIMIT 7")
def _(b: Bindings):
    return registry.sample_ids(b.samples, b.samples, max_samples=7)


@query("top_05_top_variables", f"""SELECT sample_id, gene, r AS rank FROM (SELECT sample_id, gene, row_number() OVER (PARTITION BY sample_id ORDER BY round(morans_i, 9) DESC, gene) AS r
 FROM ({GENE_MORANS})) WHERE r <= 10""", i="rank", d_dev=GENE_DEV)
def _(b: Bindings):
    return ranking.top_variables(moran.gene_morans(b.obs, raw_values(b), b.var, 6), 10).select("sample_id", "gene", "rank")


@query("top_06_sorted_artifacts", """SELECT run_name, epoch, count(*) AS n FROM (SELECT run_name, CAST(regexp_extract(path, '_epoch_([0-9]+)[.]png$', 1) AS INTEGER) AS epoch
 FROM b_artifacts WHERE regexp_matches(path, '_epoch_[0-9]+[.]png$')) GROUP BY 1, 2 ORDER BY epoch DESC, run_name DESC""", i="n")
def _(b: Bindings):
    return runs.sort_artifacts(runs.parse_artifacts(b.artifacts).groupBy("run_name", "epoch").agg(F.count(F.lit(1)).alias("n")))


@query("top_07_first_six_pathways", """SELECT row_number() OVER (ORDER BY pathway) - 1 AS pos, replace(pathway, 'HALLMARK_', '') AS name, pathway
 FROM (SELECT DISTINCT pathway FROM b_gene_sets) ORDER BY pathway LIMIT 6""", i="pos")
def _(b: Bindings):
    names = b.gene_sets.agg(F.array_sort(F.collect_set("pathway")).alias("n")).select(F.posexplode("n").alias("pos", "pathway"))
    return align.requested_names(names, None)


@query("top_08_last_rows", """SELECT run_name, epoch, click, view, purchase FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC) AS r FROM d_wide)
 WHERE r = 1""", r="click view purchase")
def _(b: Bindings):
    names = ["click", "view", "purchase"]
    return runs.last_rows(runs.wide(runs.latest_cells(b.metrics_long), names), names)


@query("top_09_first_names", "SELECT DISTINCT gene FROM b_var ORDER BY gene LIMIT 50")
def _(b: Bindings):
    return ranking.first_names(b.var, "gene", 50)


@query("plan_02_vocabulary", f"""SELECT gene, total_counts, morans_i, priority, row_number() OVER (ORDER BY priority DESC, h, gene) - 1 AS pos FROM (
 SELECT *, 0.5::DOUBLE * er + 0.5::DOUBLE * mr AS h FROM (
  SELECT gene, total_counts, m AS morans_i, gene IN (SELECT gene FROM b_gene_sets WHERE pathway = 'HALLMARK_TYPE_LARGE') AS priority,
   row_number() OVER (ORDER BY total_counts DESC, gene) - 1 AS er, row_number() OVER (ORDER BY round(m, 9) DESC, gene) - 1 AS mr
  FROM d_totals JOIN (SELECT gene, avg(morans_i) AS m FROM ({GENE_MORANS}) GROUP BY 1) USING (gene)))
 QUALIFY priority OR row_number() OVER (ORDER BY priority DESC, h, gene) <= 1000""", r="total_counts morans_i", i="pos", d_dev=GENE_DEV)
def _(b: Bindings):
    priority = genesets.set_symbols(b.gene_sets, F.col("pathway") == "HALLMARK_TYPE_LARGE")
    return build_vocabulary(b.obs, b.var, b.expr, priority, 1000, 0.5)
