"""Queries FIL-*: predicates and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.bindings import LIMITS, Bindings
from spotlake.catalog.registry import query
from spotlake.catalog.sources import _CHOSEN
from spotlake.functions.scalars import is_mt_prefix, is_mt_substring
from spotlake.operators import align, coordinates, genesets, metrics, moran, qc, registry, runs, scoring
from spotlake.plans.activities import pathway_activities
from spotlake.sources import expression

COLS = "sample_id, id, organ, disease_state, st_technology, species, patient"


@query("fil_01_registry_filter", f"""SELECT {COLS} FROM b_samples WHERE lower(organ) = 'bowel' AND lower(disease_state) = 'cancer'""")
def _(b: Bindings):
    return registry.filter_samples(b.samples, organ="BOWEL", disease_state="Cancer", st_technology=None)


@query("fil_02_selection_precedence", """SELECT 'filters' AS rule, id FROM b_samples WHERE lower(st_technology) = 'visium' AND lower(species) = 'homo sapiens'
 UNION ALL SELECT 'id', id FROM b_samples WHERE id = 'S3' UNION ALL SELECT 'all', id FROM b_samples
 UNION ALL (SELECT 'limit', id FROM b_samples WHERE lower(organ) = 'breast' ORDER BY sample_id LIMIT 2)""")
def _(b: Bindings):
    s = b.samples
    parts = {
        "filters": registry.select_samples(s, st_technology="visium", species="Homo Sapiens"),
        "id": registry.select_samples(s, sample="S3", organ="Lung"),
        "all": registry.select_samples(s, take_all=True, organ="Lung"),
        "limit": registry.select_samples(s, organ="Breast", limit=2),
        "none": registry.select_samples(s),
    }
    out = None
    for rule, df in parts.items():
        part = df.select(F.lit(rule).alias("rule"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("fil_03_human_only", f"SELECT {COLS} FROM b_samples WHERE species = 'Homo sapiens'")
def _(b: Bindings):
    return registry.human_only(b.samples)


@query("fil_04_fallback_to_all", """SELECT 'missing' AS organ, sample_id FROM b_samples UNION ALL
 SELECT 'Lung', sample_id FROM b_samples WHERE organ = 'Lung'""")
def _(b: Bindings):
    s = b.samples
    none = registry.with_fallback(registry.by_organ(s, "Brain"), s).select(F.lit("missing").alias("organ"), "sample_id")
    some = registry.with_fallback(registry.by_organ(s, "Lung"), s).select(F.lit("Lung").alias("organ"), "sample_id")
    return none.unionByName(some)


@query("fil_05_organ_alias", f"SELECT {COLS} FROM b_samples WHERE organ = 'Bowel'")
def _(b: Bindings):
    return registry.by_organ(b.samples, "Colorectal")


@query("fil_06_technology_contains", f"SELECT {COLS} FROM b_samples WHERE contains(st_technology, 'Visium') AND lower(organ) = 'bowel'")
def _(b: Bindings):
    return registry.by_technology(b.samples, "Visium", "Bowel")


@query("fil_07_available_only", f"SELECT {COLS} FROM b_samples WHERE sample_id IN (SELECT label FROM embeddings)")
def _(b: Bindings):
    return registry.available_only(b.samples, b.features)


@query("fil_08_explicit_ids", """SELECT 'found' AS state, id FROM b_samples WHERE id IN (SELECT 'S' || s_nationkey * 2 FROM supplier)
 UNION ALL SELECT DISTINCT 'failed', 'S' || s_nationkey * 2 FROM supplier WHERE 'S' || s_nationkey * 2 NOT IN (SELECT id FROM b_samples)""")
def _(b: Bindings):
    wanted = b.t("supplier").select(F.concat(F.lit("S"), (F.col("s_nationkey") * 2).cast("string")).alias("id"))
    found, failed = registry.explicit_ids(b.samples, wanted)
    return found.select(F.lit("found").alias("state"), "id").unionByName(failed.select(F.lit("failed").alias("state"), "id"))


@query("fil_09_mt_prefix", """SELECT gene, regexp_matches(lower(gene), '^(mt-|mt:|mt_|grcm38_mt-|hs_mt-)') AS is_mt FROM (
 SELECT gene FROM b_genes UNION ALL SELECT 'grcm38_' || gene FROM b_genes UNION ALL SELECT 'X' || gene FROM b_genes)""")
def _(b: Bindings):
    g = b.genes
    names = g.select("gene").unionByName(g.select(F.concat(F.lit("grcm38_"), "gene").alias("gene"))).unionByName(
        g.select(F.concat(F.lit("X"), "gene").alias("gene")))
    return names.select("gene", is_mt_prefix(F.col("gene")).alias("is_mt"))


@query("fil_10_mt_substring", """SELECT gene, contains(lower(gene), 'mt-') OR contains(lower(gene), 'mt:') AS is_mt FROM (
 SELECT gene FROM b_genes UNION ALL SELECT 'X' || gene FROM b_genes)""")
def _(b: Bindings):
    names = b.genes.select("gene").unionByName(b.genes.select(F.concat(F.lit("X"), "gene").alias("gene")))
    return names.select("gene", is_mt_substring(F.col("gene")).alias("is_mt"))


def passed(b: Bindings):
    return qc.passing_spots(b.obs, b.expr, LIMITS.min_umis, LIMITS.min_genes, LIMITS.max_mt)


def kept_counts(b: Bindings):
    return qc.passing_counts(b.expr, LIMITS.min_umis, LIMITS.min_genes, LIMITS.max_mt)


@query("fil_11_spot_qc", "SELECT sample_id, barcode, x, y FROM d_passed", r="x y")
def _(b: Bindings):
    return passed(b)


@query("fil_11_counts_after_qc", "SELECT sample_id, barcode, gene, count, umis AS library FROM b_expr JOIN d_passed USING (sample_id, barcode)",
       r="count library")
def _(b: Bindings):
    return kept_counts(b)


@query("fil_12_empty_samples", """SELECT DISTINCT sample_id FROM b_obs WHERE sample_id NOT IN (SELECT sample_id FROM d_spot_qc WHERE umis >= 2500)""")
def _(b: Bindings):
    return qc.empty_samples(b.obs, qc.passing_spots(b.obs, b.expr, 2500, None, None))


@query("fil_13_min_pathways", """SELECT sample_id, count(*) FILTER (WHERE n_genes >= 40) AS n_scored FROM d_pairs GROUP BY 1
 HAVING count(*) FILTER (WHERE n_genes >= 40) >= 25""", i="n_scored")
def _(b: Bindings):
    _, per_sample = scoring.score_pathways(passed(b), scoring.normalise(kept_counts(b)), b.var, b.gene_sets, 40)
    return scoring.scored_counts(per_sample).filter(F.col("n_scored") >= 25).select("sample_id", "n_scored")


@query("fil_13_rejected_samples", """SELECT DISTINCT sample_id, 'too few scorable pathways' AS reason FROM d_pairs GROUP BY 1
 HAVING count(*) FILTER (WHERE n_genes >= 40) < 25""")
def _(b: Bindings):
    from dataclasses import replace

    strict = replace(LIMITS, min_set_genes=40)
    return pathway_activities(b.obs, b.var, b.expr, b.gene_sets, strict, with_morans=False).rejected


@query("fil_14_named_sets", """SELECT collection, pathway, gene FROM b_gene_sets
 WHERE pathway IN (SELECT DISTINCT 'HALLMARK_TYPE_' || p_type FROM part WHERE p_size > 25)""")
def _(b: Bindings):
    names = b.t("part").filter("p_size > 25").select(F.concat(F.lit("HALLMARK_TYPE_"), "p_type").alias("pathway"))
    return genesets.named_sets(b.gene_sets, names).select("collection", "pathway", "gene")


@query("fil_15_valid_patches", """SELECT o.sample_id, o.barcode, d.barcode IS NOT NULL AS valid FROM b_obs o
 LEFT JOIN d_passed d ON d.sample_id = o.sample_id AND d.barcode = o.barcode""")
def _(b: Bindings):
    return align.valid_patches(b.obs.select("sample_id", "barcode"), passed(b))


@query("fil_16_active_pathways", "SELECT sample_id, pathway, n, pcc FROM d_slide_pcc WHERE n >= 2 AND target_std > 1e-6 AND NOT isnan(pcc)",
       r="pcc", i="n")
def _(b: Bindings):
    return metrics.active_pathways(b.predictions).select("sample_id", "pathway", "n", "pcc")


@query("fil_17_too_few_spots", """SELECT sample_id, CASE WHEN count(*) < 61 THEN 0.0 ELSE 1.0 END AS has_statistic FROM b_obs GROUP BY 1""",
       r="has_statistic")
def _(b: Bindings):
    """Slides with fewer than k + 1 = 61 spots have statistic 0 for every k = 60 graph."""
    stats = moran.value_morans(b.obs.withColumn("v", F.col("y")), "v", 60)
    return stats.select("sample_id", F.when(F.col("morans_i") == 0, 0.0).otherwise(1.0).alias("has_statistic"))


@query("fil_18_canvas_check", """SELECT o.sample_id, min(x * scalef) >= -224 AND max(x * scalef) <= any_value(w) + 224
 AND min(y * scalef) >= -224 AND max(y * scalef) <= any_value(h) + 224 AS in_canvas FROM b_obs o JOIN d_chosen USING (sample_id) GROUP BY 1""",
       d_chosen=_CHOSEN)
def _(b: Bindings):
    return coordinates.canvas_check(b.obs, expression.choose_image(b.images, b.scalefactors))


@query("fil_19_selected_runs", """SELECT run_name, epoch, metric, value FROM d_cells WHERE run_name IN ('run_1', 'run_5', 'run_9')""", r="value")
def _(b: Bindings):
    return runs.latest_cells(runs.only_runs(b.metrics_long, ["run_1", "run_5", "run_9"]))
