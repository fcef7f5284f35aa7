"""Queries PLAN-*: the composite entry points."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.aggregates import ATT, COHERENCE, DEV2, VARIANCE
from spotlake.catalog.bindings import LIMITS, Bindings
from spotlake.catalog.joins import _GROUPS, _TYPE, type_scores
from spotlake.catalog.registry import query
from spotlake.catalog.sources import _CHOSEN
from spotlake.plans import studies
from spotlake.plans.activities import pathway_activities
from spotlake.plans.evaluation import evaluate_overall, evaluate_slides
from spotlake.session import work_path
from spotlake.sources import expression, listing, tables

PASSED_EDGES = """SELECT sample_id, i AS barcode, j AS neighbor FROM (SELECT a.sample_id, a.barcode AS i, b.barcode AS j,
 row_number() OVER (PARTITION BY a.sample_id, a.barcode ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.barcode) AS rank
 FROM d_passed a JOIN d_passed b ON a.sample_id = b.sample_id AND a.barcode <> b.barcode) WHERE rank <= 6"""
SCORE_DEV = """SELECT sample_id, barcode, pathway, score, score - avg(score) OVER (PARTITION BY sample_id, pathway) AS dev FROM d_scores JOIN d_enough USING (sample_id)"""
SCORE_MORANS = """SELECT z.sample_id, z.pathway, greatest(CASE WHEN n < 7 OR ss < 1e-12 THEN 0 ELSE coalesce(num, 0) / 6 / ss END, 0) AS morans_i
 FROM (SELECT sample_id, pathway, count(*) AS n, sum(dev * dev) AS ss FROM d_dev GROUP BY 1, 2) z LEFT JOIN (
  SELECT a.sample_id, a.pathway, sum(a.dev * b.dev) AS num FROM d_pedges e JOIN d_dev a ON a.sample_id = e.sample_id AND a.barcode = e.barcode
  JOIN d_dev b ON b.sample_id = e.sample_id AND b.barcode = e.neighbor AND b.pathway = a.pathway GROUP BY 1, 2) s USING (sample_id, pathway)"""


def activities(b: Bindings, with_morans: bool = True):
    return pathway_activities(b.obs, b.var, b.expr, b.gene_sets, LIMITS, with_morans)


@query("plan_01_pathway_activities", """SELECT sample_id, barcode, pathway, score, morans_i FROM d_dev JOIN d_mor USING (sample_id, pathway)""",
       r="score morans_i", d_pedges=PASSED_EDGES, d_dev=SCORE_DEV, d_mor=SCORE_MORANS)
def _(b: Bindings):
    a = activities(b)
    return a.scores.join(a.morans, ["sample_id", "pathway"]).select("sample_id", "barcode", "pathway", "score", "morans_i")


@query("plan_01_activity_attributes", """SELECT sample_id, before AS n_spots_before_qc, after AS n_spots_after_qc, 500.0 AS qc_min_umis, 20.0 AS qc_min_genes,
 0.25 AS qc_max_mt, n_scored AS n_scored_pathways FROM (SELECT sample_id, count(*) AS before FROM b_obs GROUP BY 1)
 JOIN (SELECT sample_id, count(*) AS after FROM d_passed GROUP BY 1) USING (sample_id)
 JOIN (SELECT sample_id, count(*) FILTER (WHERE n_genes >= 5) AS n_scored FROM d_pairs GROUP BY 1) USING (sample_id) WHERE n_scored >= 25""",
       r="qc_min_umis qc_min_genes qc_max_mt", i="n_spots_before_qc n_spots_after_qc n_scored_pathways")
def _(b: Bindings):
    return activities(b, False).attrs


@query("plan_03_training_selection", """SELECT sample_id, id, CASE WHEN pos < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split
 FROM b_samples JOIN d_groups ON coalesce(patient, id) = g WHERE species = 'Homo sapiens' AND sample_id IN (SELECT label FROM embeddings)""", d_groups=_GROUPS)
def _(b: Bindings):
    return studies.training_selection(b.samples, b.obs, b.features)


@query("plan_03_training_rows", """SELECT sample_id, split, pathway, count(*) AS n, sum(score) AS total, sum(len(features)) AS n_values FROM b_features
 JOIN d_type USING (sample_id, barcode) JOIN b_samples USING (sample_id) JOIN d_split USING (id) GROUP BY 1, 2, 3""", r="total", i="n n_values",
       d_type=_TYPE, d_groups=_GROUPS, d_split="""SELECT id, CASE WHEN pos < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split
 FROM b_samples JOIN d_groups ON coalesce(patient, id) = g WHERE species = 'Homo sapiens' AND sample_id IN (SELECT label FROM embeddings)""")
def _(b: Bindings):
    selection = studies.training_selection(b.samples, b.obs, b.features)
    rows = studies.training_rows(selection, b.features, type_scores(b), b.obs)
    return rows.groupBy("sample_id", "split", "pathway").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"), F.sum(F.size("features")).alias("n_values"))


SPOT_PCC = """SELECT sample_id, pathway, count(*) AS n, stddev_samp(target) AS target_std,
 count(*) * covar_pop(pred, target) / (sqrt(count(*) * var_pop(pred) + 1e-8::DOUBLE) * sqrt(count(*) * var_pop(target) + 1e-8::DOUBLE)) AS pcc
 FROM b_spot_predictions GROUP BY 1, 2"""
SLIDES = f"""SELECT sample_id, mse, mae, pcc_loss, val_pcc, pred_variance, coherence, attn_corr
 FROM (SELECT sample_id, avg((pred - target) ** 2) AS mse, avg(abs(pred - target)) AS mae FROM b_spot_predictions GROUP BY 1)
 LEFT JOIN (SELECT sample_id, 1 - avg(pcc) AS pcc_loss, avg(pcc) FILTER (WHERE n >= 2 AND target_std > 1e-6 AND NOT isnan(pcc)) AS val_pcc FROM d_spcc GROUP BY 1) USING (sample_id)
 LEFT JOIN ({VARIANCE.replace('b_predictions', 'b_spot_predictions')}) USING (sample_id)
 LEFT JOIN ({COHERENCE.replace('r <= 4', 'r <= 50')}) USING (sample_id)
 LEFT JOIN ({ATT.replace('b_predictions', 'b_spot_predictions').replace('b_attention', 'd_attention')}) USING (sample_id)"""
ATTENTION = "SELECT sample_id, barcode, x + (barcode % 11) AS attention FROM b_obs"


def slides(b: Bindings):
    attention = b.obs.select("sample_id", "barcode", (F.col("x") + F.col("barcode") % 11).alias("attention"))
    return evaluate_slides(b.spot_predictions, b.obs, attention, LIMITS.k)


@query("plan_04_evaluation_slides", SLIDES, r="mse mae pcc_loss val_pcc pred_variance coherence attn_corr",
       d_spcc=SPOT_PCC, d_dev=DEV2, d_attention=ATTENTION)
def _(b: Bindings):
    return slides(b)


@query("plan_04_evaluation_overall", f"""SELECT avg(mse) AS mse, avg(mae) AS mae, avg(pcc_loss) AS pcc_loss, avg(val_pcc) AS val_pcc, avg(pred_variance) AS pred_variance,
 avg(coherence) FILTER (WHERE coherence <> 0) AS coherence, avg(attn_corr) AS attn_corr, count(*) AS n_slides FROM ({SLIDES})""",
       r="mse mae pcc_loss val_pcc pred_variance coherence attn_corr", i="n_slides", d_spcc=SPOT_PCC, d_dev=DEV2, d_attention=ATTENTION)
def _(b: Bindings):
    return evaluate_overall(slides(b))


@query("plan_05_qc_audit", """SELECT sample_id, total, kept, kept_share, kept_share <= (SELECT kept_share FROM d_report ORDER BY kept_share, sample_id LIMIT 1 OFFSET 14)
 AS is_outlier, (SELECT avg(kept_share) FROM d_report) AS mean_share FROM d_report""", r="kept_share mean_share", i="total kept")
def _(b: Bindings):
    report, summary, worst = studies.qc_audit(b.obs, b.expr, LIMITS.min_umis, LIMITS.min_genes, LIMITS.max_mt)
    border = worst.agg(F.max("kept_share")).scalar()
    return report.select("sample_id", "total", "kept", "kept_share", (F.col("kept_share") <= border).alias("is_outlier"),
                         summary.select("mean_share").scalar().alias("mean_share"))


@query("plan_06_run_comparison", """SELECT s.run_name, s.epoch, s.metric, s.smoothed, w.click, w.view, w.purchase, l.last_epoch FROM (
 SELECT run_name, epoch, metric, avg(value) OVER (PARTITION BY run_name, metric ORDER BY epoch ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS smoothed FROM d_cells WHERE value IS NOT NULL) s
 JOIN d_wide w USING (run_name, epoch) JOIN (SELECT run_name, max(epoch) AS last_epoch FROM d_wide GROUP BY 1) l USING (run_name)""", r="smoothed click view purchase", i="last_epoch")
def _(b: Bindings):
    curves, cards, table = studies.compare_runs(b.metrics_long, ["click", "view", "purchase"], 3)
    return (
        curves.select("run_name", "epoch", "metric", "smoothed")
        .join(table.select("run_name", "epoch", "click", "view", "purchase"), ["run_name", "epoch"])
        .join(cards.select("run_name", F.col("epoch").alias("last_epoch")), "run_name"))


_TOPN = """SELECT sample_id, gene FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, gene) AS r
 FROM (SELECT sample_id, gene, sum(count) AS c FROM b_expr GROUP BY 1, 2)) WHERE r <= 400"""


def _availability_sql() -> str:
    parts = []
    for scope, keep in (("all", "b_samples"), ("Visium", "(SELECT * FROM b_samples WHERE contains(st_technology, 'Visium'))")):
        for basis, table in (("panel", "b_var"), ("top", "d_topn")):
            lists = f"SELECT gene, count(*) AS n FROM {table} JOIN {keep} k USING (sample_id) GROUP BY 1"
            parts.append(f"SELECT '{scope}' AS scope, '{basis}' AS basis, 'in_all' AS rule, count(*) AS n_genes FROM ({lists}) WHERE n = (SELECT count(*) FROM {keep} k)")
            parts.append(f"SELECT '{scope}', '{basis}', 'in_any', count(*) FROM ({lists})")
    return " UNION ALL ".join(parts)


@query("plan_07_gene_availability", _availability_sql(), i="n_genes", d_topn=_TOPN)
def _(b: Bindings):
    return studies.gene_availability(b.samples, b.var, b.expr, "Visium", 400)


@query("plan_08_sample_card", """SELECT s.sample_id, s.id, o.n AS n_spots, v.n AS n_genes, v.n AS n_found, v.n / (SELECT count(*) FROM b_genes)::DOUBLE AS coverage,
 c.image_key, c.scalef, s.sample_id IN (SELECT label FROM embeddings) AS has_features FROM b_samples s
 LEFT JOIN (SELECT sample_id, count(*) AS n FROM b_obs GROUP BY 1) o USING (sample_id)
 LEFT JOIN (SELECT sample_id, count(*) AS n FROM b_var GROUP BY 1) v USING (sample_id) LEFT JOIN d_chosen c USING (sample_id)""",
       r="coverage scalef", i="n_spots n_genes n_found", d_chosen=_CHOSEN)
def _(b: Bindings):
    return card(b)


def card(b: Bindings):
    return studies.sample_card(b.samples, b.obs, b.var, b.gene_sets, b.features,
                               expression.choose_image(b.images, b.scalefactors))


@query("plan_08_full_sample_card", """SELECT s.sample_id, s.id, o.n AS n_spots, i.images, f.scalefactors,
 concat_ws(',', CASE WHEN s.sample_id IN (SELECT label FROM embeddings) THEN 'features' END, CASE WHEN v.n IS NOT NULL THEN 'genes' END,
  CASE WHEN o.n IS NOT NULL THEN 'spots' END) AS files FROM b_samples s
 LEFT JOIN (SELECT sample_id, count(*) AS n FROM b_obs GROUP BY 1) o USING (sample_id) LEFT JOIN (SELECT sample_id, count(*) AS n FROM b_var GROUP BY 1) v USING (sample_id)
 LEFT JOIN (SELECT sample_id, string_agg(image_key || ':' || h || 'x' || w, ',' ORDER BY image_key) AS images FROM b_images GROUP BY 1) i USING (sample_id)
 LEFT JOIN (SELECT sample_id, string_agg(key || ':' || CAST(round(value * 1000) AS BIGINT), ',' ORDER BY key) AS scalefactors FROM b_scalefactors GROUP BY 1) f USING (sample_id)""",
       i="n_spots")
def _(b: Bindings):
    """The kinds of files come from a listing of the folder that the tables are written to."""
    root = work_path(b.spark, "samples")
    for kind, table in (("features", b.features), ("spots", b.obs), ("genes", b.var)):
        # dealt by sample, in a few parts each, for a few files of each sample
        tables.write_by_sample(table.hint("rebalance", "sample_id"), f"{root}/{kind}")
    listed = listing.sample_files(listing.commit_listing(b.spark, root, work_path(b.spark, "listing")))
    files = listed.withColumn("sample_id", F.col("sample_id").cast(b.samples.schema["sample_id"].dataType))
    full = studies.full_sample_card(card(b), b.images, b.scalefactors, files)
    shown = {"images": lambda e: F.concat(e.image_key, F.lit(":"), e.h, F.lit("x"), e.w),
             "scalefactors": lambda e: F.concat(e.key, F.lit(":"), F.round(e.value * 1000).cast("bigint")), "files": lambda e: F.when(e.size > 0, e.kind)}
    return full.select("sample_id", "id", "n_spots", *[F.array_join(F.transform(c, f), ",").alias(c) for c, f in shown.items()])
