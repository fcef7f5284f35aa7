"""Queries AGG-*."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.bindings import LIMITS, Bindings
from spotlake.catalog.filters import kept_counts, passed
from spotlake.catalog.registry import query
from spotlake.functions import aggregates as A
from spotlake.operators import genesets, metrics, moran, pooling, qc, ranking, registry, runs, scoring, splitting


def raw_values(b: Bindings):
    return b.expr.select("sample_id", "barcode", "gene", F.col("count").alias("x"))


def score_tables(b: Bindings):
    return scoring.score_pathways(passed(b), scoring.normalise(kept_counts(b)), b.var, b.gene_sets, LIMITS.min_set_genes)


@query("agg_01_gene_totals", "SELECT gene, total_counts FROM d_totals", r="total_counts")
def _(b: Bindings):
    return ranking.gene_totals(b.expr)


@query("agg_02_spot_metrics", "SELECT sample_id, barcode, umis, n_genes, mt_counts, mt_frac FROM d_spot_qc",
       r="umis mt_counts mt_frac", i="n_genes")
def _(b: Bindings):
    return qc.spot_metrics(b.obs, b.expr)


@query("agg_03_library_size", "SELECT sample_id, barcode, sum(count) AS library FROM b_expr GROUP BY 1, 2", r="library")
def _(b: Bindings):
    return qc.library_size(b.expr)


@query("agg_04_gene_moments", "SELECT sample_id, gene, mu, sigma FROM d_moments JOIN (SELECT DISTINCT sample_id, gene FROM d_x) USING (sample_id, gene)",
       r="mu sigma")
def _(b: Bindings):
    n = passed(b).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"))
    return scoring.gene_moments(scoring.normalise(kept_counts(b)), n)


@query("agg_05_pathway_scores", "SELECT sample_id, barcode, pathway, score FROM d_scores", r="score")
def _(b: Bindings):
    return score_tables(b)[0]


@query("agg_05_last_symbols", """SELECT c_nationkey AS sample_id, c_custkey AS barcode, 'G' || (l_partkey // 2) AS gene, sum(l_quantity) AS count
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE CASE WHEN c_nationkey % 5 = 4 THEN l_partkey % 2 = 0 ELSE l_partkey % 2 = 1 OR l_partkey + 1 NOT IN (SELECT p_partkey FROM part) END GROUP BY 1, 2, 3""", r="count")
def _(b: Bindings):
    """Panels where two neighbouring parts share a symbol: the later row of the slide's panel counts."""
    def symbol(part: str):
        return F.concat(F.lit("G"), F.floor(F.col(part) / 2).cast("string")).alias("gene")

    panel = b.on_every_slide(b.genes.select("p_partkey"))
    in_panel = "NOT (sample_id % 5 = 4 AND pos % 2 = 1)"
    var = panel.select("sample_id", symbol("p_partkey"), F.col("p_partkey").alias("pos")).filter(in_panel)
    expr = b._items.select(
        F.col("c_nationkey").alias("sample_id"), F.col("c_custkey").alias("barcode"), symbol("l_partkey"), F.col("l_partkey").alias("pos"),
        F.col("l_quantity").alias("count")).filter(in_panel)
    return scoring.last_symbols(expr, var).groupBy("sample_id", "barcode", "gene").agg(F.sum("count").alias("count"))


@query("agg_06_scored_pathways", """SELECT sample_id, count(*) FILTER (WHERE n_genes >= 40) AS n_scored, count(*) FILTER (WHERE n_genes < 40) AS n_unscored
 FROM d_pairs GROUP BY 1""", i="n_scored n_unscored")
def _(b: Bindings):
    _, per_sample = scoring.score_pathways(passed(b), scoring.normalise(kept_counts(b)), b.var, b.gene_sets, 40)
    return scoring.scored_counts(per_sample)


def _moran_sql(values: str, keys: str) -> str:
    """Dense definition: deviations of every spot, zeros included, summed over all edges."""
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", ")[1:]) or "true"
    return f"""SELECT {', '.join('z.' + c for c in keys.split(', '))}, CASE WHEN n < 7 OR ss < 1e-12 THEN 0 ELSE coalesce(num, 0) / 6 / ss END AS morans_i
 FROM (SELECT {keys}, count(*) AS n, sum(dev * dev) AS ss FROM d_dev GROUP BY {keys}) z
 LEFT JOIN (SELECT {', '.join('a.' + c for c in keys.split(', '))}, sum(a.dev * b.dev) AS num FROM d_edges e
  JOIN d_dev a ON a.sample_id = e.sample_id AND a.barcode = e.barcode
  JOIN d_dev b ON b.sample_id = e.sample_id AND b.barcode = e.neighbor AND {on} GROUP BY ALL) s USING ({keys})"""


@query("agg_07_morans_one_variable", _moran_sql("", "sample_id"), r="morans_i",
       d_dev="SELECT sample_id, barcode, umis - avg(umis) OVER (PARTITION BY sample_id) AS dev FROM d_spot_qc")
def _(b: Bindings):
    points = b.obs.join(qc.spot_metrics(b.obs, b.expr).select("sample_id", "barcode", "umis"), ["sample_id", "barcode"])
    return moran.value_morans(points, "umis", 6)


GENE_DEV = """SELECT sample_id, barcode, gene, v - avg(v) OVER (PARTITION BY sample_id, gene) AS dev FROM (
 SELECT o.sample_id, o.barcode, v.gene, coalesce(e.count, 0) AS v FROM b_obs o JOIN b_var v USING (sample_id)
 LEFT JOIN b_expr e ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.gene = v.gene)"""
GENE_MORANS = _moran_sql("", "sample_id, gene")


@query("agg_08_morans_all_genes", GENE_MORANS, r="morans_i", d_dev=GENE_DEV)
def _(b: Bindings):
    return moran.gene_morans(b.obs, raw_values(b), b.var, 6)


@query("agg_09_pathway_morans", "SELECT sample_id, pathway, greatest(morans_i, 0) AS morans_i FROM (" + _moran_sql("", "sample_id, pathway") + ")",
       r="morans_i", d_dev="SELECT sample_id, barcode, pathway, target - avg(target) OVER (PARTITION BY sample_id, pathway) AS dev FROM b_spot_predictions")
def _(b: Bindings):
    scores = b.spot_predictions.select("sample_id", "barcode", "pathway", F.col("target").alias("score"))
    return moran.pathway_morans(b.obs, scores, 6)


@query("agg_10_mean_gene_morans", f"SELECT gene, avg(morans_i) AS morans_i FROM ({GENE_MORANS}) GROUP BY 1", r="morans_i", d_dev=GENE_DEV)
def _(b: Bindings):
    return moran.mean_gene_morans(moran.gene_morans(b.obs, raw_values(b), b.var, 6))


COHERENCE = """SELECT sample_id, CASE WHEN stddev_pop(t) > 1e-12 AND stddev_pop(p) > 1e-12
 THEN covar_pop(t, p) / (stddev_pop(t) * stddev_pop(p)) ELSE 0 END AS coherence FROM (
 SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY round(t, 9) DESC, pathway) AS r FROM (
  SELECT z.sample_id, z.pathway, CASE WHEN n < 7 OR st < 1e-12 THEN 0 ELSE nt / 6 / st END AS t, CASE WHEN n < 7 OR sp < 1e-12 THEN 0 ELSE np / 6 / sp END AS p
  FROM (SELECT sample_id, pathway, count(*) AS n, sum(dt * dt) AS st, sum(dp * dp) AS sp FROM d_dev GROUP BY 1, 2) z
  JOIN (SELECT a.sample_id, a.pathway, sum(a.dt * b.dt) AS nt, sum(a.dp * b.dp) AS np FROM d_edges e
   JOIN d_dev a ON a.sample_id = e.sample_id AND a.barcode = e.barcode
   JOIN d_dev b ON b.sample_id = e.sample_id AND b.barcode = e.neighbor AND a.pathway = b.pathway GROUP BY 1, 2) s USING (sample_id, pathway)))
 WHERE r <= 4 GROUP BY 1"""
DEV2 = """SELECT sample_id, barcode, pathway, target - avg(target) OVER (PARTITION BY sample_id, pathway) AS dt,
 pred - avg(pred) OVER (PARTITION BY sample_id, pathway) AS dp FROM b_spot_predictions"""


@query("agg_11_spatial_coherence", COHERENCE, r="coherence", d_dev=DEV2)
def _(b: Bindings):
    return moran.spatial_coherence(b.obs, b.spot_predictions, 6, 4)


def report(b: Bindings):
    return qc.qc_report(b.obs, b.expr, LIMITS.min_umis, LIMITS.min_genes, LIMITS.max_mt)


@query("agg_12_qc_report", "SELECT * FROM d_report", r="kept_share", i="total kept low_umi low_gene high_mt")
def _(b: Bindings):
    return report(b)


@query("agg_13_qc_summary", """SELECT avg(kept_share) AS mean_share, min(kept_share) AS min_share, max(kept_share) AS max_share, count(*) AS n_samples FROM d_report""",
       r="mean_share min_share max_share", i="n_samples")
def _(b: Bindings):
    return qc.qc_summary(report(b))


@query("agg_14_expression_statistics", """SELECT sample_id, sum(m) AS n_nonzero, sum(s) / sum(m) AS nonzero_mean, max(hi) AS nonzero_max, min(lo) AS nonzero_min,
 1 - sum(m) / sum(n)::DOUBLE AS sparsity, min(mean) AS gene_mean_min, max(mean) AS gene_mean_max, min(var) AS gene_var_min, max(var) AS gene_var_max,
 log10(max(var) / (min(var) + 1e-8::DOUBLE)) AS log_var_ratio FROM (SELECT o.sample_id, v.gene, count(*) AS n, count(e.count) AS m, coalesce(sum(e.count), 0) AS s, max(e.count) AS hi, min(e.count) AS lo,
  avg(coalesce(e.count, 0)) AS mean, var_pop(coalesce(e.count, 0)) AS var FROM b_obs o JOIN b_var v USING (sample_id)
  LEFT JOIN b_expr e ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.gene = v.gene GROUP BY 1, 2) GROUP BY 1""",
       r="nonzero_mean nonzero_max nonzero_min sparsity gene_mean_min gene_mean_max gene_var_min gene_var_max log_var_ratio", i="n_nonzero")
def _(b: Bindings):
    # the ratio is about 1e10 where some gene never occurs, so its logarithm is compared
    stats = qc.expression_statistics(b.obs, b.var, b.expr)
    return stats.withColumn("log_var_ratio", F.log10("var_ratio")).drop("var_ratio")


@query("agg_15_category_counts", "SELECT organ, species, count(*) AS n FROM b_samples GROUP BY 1, 2", i="n")
def _(b: Bindings):
    return registry.category_counts(b.samples, "organ", "species")


@query("agg_16_pathway_ranges", """SELECT sample_id, pathway, min(score) AS min_score, avg(score) AS mean_score, max(score) AS max_score FROM d_scores
 GROUP BY 1, 2 HAVING max(abs(score)) > 0""", r="min_score mean_score max_score")
def _(b: Bindings):
    return scoring.pathway_ranges(score_tables(b)[0])


@query("agg_17_collection_coverage", """SELECT count(*) AS n_genes, count(s.gene) AS n_covered, count(s.gene) * 100.0::DOUBLE / count(*) AS pct_covered
 FROM b_genes g LEFT JOIN (SELECT DISTINCT gene FROM b_gene_sets) s USING (gene)""", r="pct_covered", i="n_genes n_covered")
def _(b: Bindings):
    return genesets.coverage(b.gene_sets, b.genes)


@query("agg_17_matched_per_set", """SELECT pathway, count(*) FILTER (WHERE gene IN (SELECT gene FROM b_var)) AS n_matched, count(*) AS n_genes
 FROM b_gene_sets GROUP BY 1""", i="n_matched n_genes")
def _(b: Bindings):
    return genesets.matched_per_set(b.gene_sets, b.var)


@query("agg_18_sample_coverage", """SELECT sample_id, count(*) AS n_found, (SELECT count(*) FROM b_genes) AS n_wanted, count(*) / (SELECT count(*) FROM b_genes)::DOUBLE AS coverage
 FROM b_var GROUP BY 1""", r="coverage", i="n_found n_wanted")
def _(b: Bindings):
    return genesets.sample_coverage(b.gene_sets, b.var)


@query("agg_19_masked_mse", "SELECT avg((pred - target) ** 2) AS mse FROM b_masked WHERE NOT mask", r="mse")
def _(b: Bindings):
    return metrics.masked_mse(b.masked)


def set_weights(b: Bindings):
    return b.t("lineitem").groupBy(F.col("l_returnflag").alias("pathway")).agg(F.avg("l_discount").alias("weight"))


W_SQL = "SELECT l_returnflag AS pathway, avg(l_discount) AS weight FROM lineitem GROUP BY 1"


@query("agg_20_weighted_mse", "SELECT sum(weight * (pred - target) ** 2) / sum(weight) AS weighted_mse FROM b_masked JOIN d_w USING (pathway) WHERE NOT mask",
       r="weighted_mse", d_w=W_SQL)
def _(b: Bindings):
    return metrics.weighted_mse(b.masked, set_weights(b))


@query("agg_21_pcc_loss", "SELECT 1 - avg(pcc) AS pcc_loss FROM d_slide_pcc", r="pcc_loss")
def _(b: Bindings):
    return metrics.pcc_loss(b.predictions)


@query("agg_22_composite_loss", """SELECT mse, pcc_loss, mse + 0.5::DOUBLE * pcc_loss AS loss FROM (SELECT sum(weight * (pred - target) ** 2) / sum(weight) AS mse
 FROM b_predictions JOIN d_w USING (pathway)), (SELECT 1 - avg(pcc) AS pcc_loss FROM d_slide_pcc)""", r="mse pcc_loss loss", d_w=W_SQL)
def _(b: Bindings):
    return metrics.composite_loss(b.predictions, 0.5, set_weights(b))


@query("agg_23_huber_poisson", """SELECT avg(CASE WHEN abs(pred - target) <= 1 THEN (pred - target) ** 2 / 2 ELSE abs(pred - target) - 0.5::DOUBLE END) AS huber,
 avg(exp(pred) - target * pred) AS poisson_nll FROM b_predictions""", r="huber poisson_nll")
def _(b: Bindings):
    return metrics.robust_losses(b.predictions)


@query("agg_24_mae", "SELECT avg(abs(pred - target)) AS mae FROM b_masked WHERE NOT mask", r="mae")
def _(b: Bindings):
    return metrics.mean_absolute_error(b.masked)


VAL = """SELECT sample_id, avg(pcc) AS val_pcc FROM d_slide_pcc WHERE n >= 2 AND target_std > 1e-6 AND NOT isnan(pcc) GROUP BY 1"""


@query("agg_25_validation_pcc", VAL, r="val_pcc")
def _(b: Bindings):
    return metrics.validation_pcc(b.predictions)


VARIANCE = """SELECT sample_id, avg(v) AS pred_variance FROM (SELECT sample_id, pathway, var_samp(pred) AS v FROM b_predictions GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1"""


@query("agg_26_prediction_variance", VARIANCE, r="pred_variance")
def _(b: Bindings):
    return metrics.prediction_variance(b.predictions)


@query("agg_27_run_summary", """SELECT s.run_name, best_loss, best_epoch, epochs_completed, last_epoch, l.view AS last_view FROM d_summary s
 JOIN d_wide l ON l.run_name = s.run_name AND l.epoch = s.last_epoch""", r="best_loss last_view", i="best_epoch epochs_completed last_epoch",
       d_summary="""SELECT run_name, count(*) AS epochs_completed, min(click) AS best_loss,
 arg_min(epoch, (click, epoch)) FILTER (WHERE click IS NOT NULL) AS best_epoch, max(epoch) AS last_epoch FROM d_wide GROUP BY 1""")
def _(b: Bindings):
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    return runs.run_summary(table, "click").select(
        "run_name", "best_loss", "best_epoch", "epochs_completed", F.col("last.epoch").alias("last_epoch"),
        F.col("last.view").alias("last_view"))


ATT = """SELECT sample_id, covar_pop(attention, t) / (stddev_pop(attention) * stddev_pop(t)) AS attn_corr FROM b_attention JOIN (
 SELECT sample_id, barcode, sum(target) AS t FROM b_predictions GROUP BY 1, 2) USING (sample_id, barcode) GROUP BY 1
 HAVING stddev_pop(attention) > 0 AND stddev_pop(t) > 0"""


@query("agg_28_attention_correlation", ATT, r="attn_corr")
def _(b: Bindings):
    return metrics.attention_correlation(b.attention, b.predictions)


@query("agg_29_bag_target", "SELECT sample_id, pathway, avg(target) AS bag_target FROM b_masked WHERE NOT mask GROUP BY 1, 2", r="bag_target")
def _(b: Bindings):
    return metrics.bag_target(b.masked)


@query("agg_30_mean_weights", """SELECT pathway, avg(m) AS weight FROM (SELECT sample_id, pathway, max(target) AS m FROM b_predictions GROUP BY 1, 2) GROUP BY 1""", r="weight")
def _(b: Bindings):
    return metrics.mean_weights(b.predictions.groupBy("sample_id", "pathway").agg(F.max("target").alias("morans_i")))


@query("agg_31_attention_pooling", """SELECT sample_id, pos, sum(e * f) / sum(e) AS value FROM (SELECT sample_id, exp(s - max(s) OVER (PARTITION BY sample_id)) AS e,
 unnest(features)::DOUBLE AS f, generate_subscripts(features, 1) - 1 AS pos FROM (SELECT sample_id, features, features[3]::DOUBLE AS s FROM b_features)) GROUP BY 1, 2""",
       r="value", i="pos")
def _(b: Bindings):
    scores = b.features.select("sample_id", "barcode", F.col("features")[2].cast("double").alias("score"))
    return pooling.attention_pool(b.features, scores).select("sample_id", F.posexplode("features").alias("pos", "value"))


@query("agg_31_attention_weights", """SELECT sample_id, barcode, exp(s) / sum(exp(s)) OVER (PARTITION BY sample_id) AS weight FROM (
 SELECT sample_id, barcode, features[3]::DOUBLE AS s FROM b_features)""", r="weight")
def _(b: Bindings):
    scores = b.features.select("sample_id", "barcode", F.col("features")[2].cast("double").alias("score"))
    return pooling.softmax_weights(scores).select("sample_id", "barcode", "weight")


@query("agg_32_colour_range", """SELECT pathway, least(min(pred), min(target)) AS v_min, greatest(max(pred), max(target)) AS v_max FROM b_predictions GROUP BY 1""", r="v_min v_max")
def _(b: Bindings):
    return metrics.colour_range(b.predictions)


@query("agg_33_registry_options", """SELECT 'organ' AS field, organ AS value, count(*) AS n_samples FROM b_samples GROUP BY 2
 UNION ALL SELECT 'disease_state', disease_state, count(*) FROM b_samples GROUP BY 2 UNION ALL SELECT 'st_technology', st_technology, count(*) FROM b_samples GROUP BY 2
 UNION ALL SELECT 'species', species, count(*) FROM b_samples GROUP BY 2""", i="n_samples")
def _(b: Bindings):
    return registry.options(b.samples)


@query("agg_34_artifact_options", """SELECT DISTINCT regexp_extract(path, '([^/]*)_epoch_([0-9]+)[.]png$', 1) AS sample,
 CAST(regexp_extract(path, '([^/]*)_epoch_([0-9]+)[.]png$', 2) AS INTEGER) AS epoch FROM b_artifacts WHERE regexp_matches(path, '[^/]*_epoch_[0-9]+[.]png$')""")
def _(b: Bindings):
    return runs.artifact_options(runs.parse_artifacts(b.artifacts))


@query("agg_35_split_statistics", """SELECT split, count(*) AS n, 0 AS n_leaking FROM d_split GROUP BY 1""", i="n n_leaking",
       d_groups="""SELECT g, row_number() OVER (ORDER BY h, g) - 1 AS pos, count(*) OVER () AS n FROM (
 SELECT g, CAST('0x' || substr(md5('42:' || g), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT coalesce(patient, id) AS g FROM b_samples))""",
       d_split="""SELECT id, CASE WHEN pos >= ceil(0.5::DOUBLE * n) THEN 'train' WHEN pos >= ceil(0.5::DOUBLE * n) - ceil(0.4::DOUBLE * ceil(0.5::DOUBLE * n)) THEN 'test' ELSE 'val' END AS split
 FROM b_samples JOIN d_groups ON coalesce(patient, id) = g""")
def _(b: Bindings):
    split = splitting.patient_split(b.samples, 0.3, 0.2)
    leaking = splitting.leaking_patients(split).agg(F.count(F.lit(1))).scalar()
    return splitting.split_counts(split).withColumn("n_leaking", leaking)


@query("agg_36_batch_summary", """SELECT avg(pred) AS pred_mean, max(pred) AS pred_max, min(pred) AS pred_min, avg(target) AS target_mean, max(target) AS target_max,
 min(target) AS target_min FROM b_predictions""", r="pred_mean pred_max pred_min target_mean target_max target_min")
def _(b: Bindings):
    return metrics.batch_summary(b.predictions)


@query("agg_37_zscores", """SELECT sample_id, barcode, pathway, (target - avg(target) OVER w) / (stddev_pop(target) OVER w + 1e-8::DOUBLE) AS z FROM b_spot_predictions
 WINDOW w AS (PARTITION BY sample_id, pathway)""", r="z")
def _(b: Bindings):
    return metrics.zscores(b.spot_predictions, ["sample_id", "pathway"], "target").select("sample_id", "barcode", "pathway", "z")


# UDF-06 and UDF-07: open scoring backend and reusable aggregate expressions

@query("udf_06_weighted_gene_sets", """SELECT sample_id, barcode, pathway, sum(w * (coalesce(x, 0) - mu) / sigma) / sum(w) AS score FROM (
 SELECT p.sample_id, p.barcode, s.pathway, s.gene, s.w, m.mu, m.sigma, d_x.x FROM d_passed p JOIN b_var v USING (sample_id)
 JOIN (SELECT pathway, gene, 1 + len(gene) / 10.0::DOUBLE AS w FROM b_gene_sets) s ON s.gene = v.gene
 JOIN d_moments m ON m.sample_id = p.sample_id AND m.gene = v.gene
 LEFT JOIN d_x ON d_x.sample_id = p.sample_id AND d_x.barcode = p.barcode AND d_x.gene = v.gene) GROUP BY 1, 2, 3""", r="score")
def _(b: Bindings):
    sets = b.gene_sets.withColumn("weight", 1 + F.length("gene") / 10.0)
    return scoring.score_pathways(passed(b), scoring.normalise(kept_counts(b)), b.var, sets, LIMITS.min_set_genes)[0]


@query("udf_07_aggregate_expressions", """SELECT pathway, count(*) * covar_pop(pred, target) / (sqrt(count(*) * var_pop(pred) + 1e-8::DOUBLE) * sqrt(count(*) * var_pop(target) + 1e-8::DOUBLE)) AS pcc,
 sum(target * (pred - target) ** 2) / sum(target) AS weighted_mse, avg(abs(pred - target)) AS mae FROM b_predictions GROUP BY 1""", r="pcc weighted_mse mae")
def _(b: Bindings):
    p, t = F.col("pred"), F.col("target")
    return b.predictions.groupBy("pathway").agg(
        A.pcc(p, t).alias("pcc"), A.weighted_mse(p, t, t).alias("weighted_mse"), A.mae(p, t).alias("mae"))
