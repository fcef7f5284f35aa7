"""Queries FN-*: projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.bindings import Bindings
from spotlake.catalog.filters import kept_counts
from spotlake.catalog.registry import query
from spotlake.catalog.sources import _CHOSEN
from spotlake.functions import scalars as S
from spotlake.operators import align, coordinates, knn, moran, pooling, registry, runs, scoring
from spotlake.sources import expression


@query("fn_01_log_normalise", "SELECT sample_id, barcode, gene, x FROM d_x", r="x")
def _(b: Bindings):
    return scoring.normalise(kept_counts(b))


@query("fn_02_back_transform", """SELECT sample_id, barcode, pathway, exp(pred) - 1 AS pred, exp(target) - 1 AS target FROM b_spot_predictions""",
       r="pred target")
def _(b: Bindings):
    return b.spot_predictions.withColumns({c: S.back_transformed(F.col(c)) for c in ("pred", "target")})


@query("fn_03_short_name", "SELECT DISTINCT pathway, replace(pathway, 'HALLMARK_', '') AS name FROM b_gene_sets")
def _(b: Bindings):
    return b.gene_sets.select("pathway", S.short_name(F.col("pathway")).alias("name")).distinct()


def _names(b: Bindings):
    names = b.gene_sets.agg(F.array_sort(F.collect_set("pathway")).alias("n"))
    return names.select(F.posexplode("n").alias("pos", "pathway"))


@query("fn_04_requested_names", """SELECT n_nationkey AS pos, 'TYPE_' || p_type AS name, 'HALLMARK_TYPE_' || p_type AS pathway
 FROM nation JOIN (SELECT DISTINCT p_type FROM part) ON p_type = CASE n_nationkey WHEN 0 THEN 'PROMO' WHEN 1 THEN 'SMALL' WHEN 2 THEN 'LARGE' END""")
def _(b: Bindings):
    k = F.col("n_nationkey")
    requested = b.t("nation").select(k.alias("pos"), F.when(k == 0, "TYPE_PROMO").when(
        k == 1, "HALLMARK_TYPE_SMALL").when(k == 2, "TYPE_LARGE").otherwise("TYPE_UNKNOWN").alias("pathway"))
    return align.requested_names(_names(b), requested)


@query("fn_05_grid_normalise", """SELECT o.sample_id, barcode, CASE WHEN step >= 2 THEN round_even(x / step, 0) ELSE x END AS x,
 CASE WHEN step >= 2 THEN round_even(y / step, 0) ELSE y END AS y FROM b_obs o LEFT JOIN (
 SELECT sample_id, min(gap) FILTER (WHERE gap > 0.5) AS step FROM (
  SELECT sample_id, v - lag(v) OVER (PARTITION BY sample_id, axis ORDER BY v) AS gap FROM (
   SELECT DISTINCT sample_id, 'x' AS axis, x AS v FROM b_obs UNION ALL SELECT DISTINCT sample_id, 'y', y FROM b_obs)) GROUP BY 1) s
 ON s.sample_id = o.sample_id""", r="x y")
def _(b: Bindings):
    return coordinates.normalise_grid(b.obs)


@query("fn_06_dihedral", """SELECT sample_id, barcode, op,
 CASE op WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN -x WHEN 3 THEN -y WHEN 4 THEN -x WHEN 5 THEN x WHEN 6 THEN y ELSE -y END AS dx,
 CASE op WHEN 0 THEN y WHEN 1 THEN -x WHEN 2 THEN -y WHEN 3 THEN x WHEN 4 THEN y WHEN 5 THEN -y WHEN 6 THEN x ELSE -x END AS dy
 FROM b_features, (SELECT unnest(generate_series(0, 7)) AS op)""", r="dx dy", i="op")
def _(b: Bindings):
    return coordinates.all_dihedral(b.features)


@query("fn_07_relative_coordinates", """SELECT e.sample_id, e.barcode, neighbor, rank, n.x - c.x AS rel_x, n.y - c.y AS rel_y FROM (
  SELECT sample_id, barcode, neighbor, rank FROM d_fedges UNION ALL SELECT sample_id, barcode, barcode, 0 FROM b_features) e
 JOIN b_features c ON c.sample_id = e.sample_id AND c.barcode = e.barcode
 JOIN b_features n ON n.sample_id = e.sample_id AND n.barcode = e.neighbor""", r="rel_x rel_y", i="rank")
def _(b: Bindings):
    return coordinates.relative_to_centre(knn.neighbour_sequence(b.features, 6), b.features)


@query("fn_08_centred_coordinates", """SELECT sample_id, barcode, (x - mx) / s AS x, (y - my) / s AS y FROM b_features JOIN (
 SELECT sample_id, mx, my, greatest(max(abs(x - mx)), max(abs(y - my)), 1.0::DOUBLE) AS s FROM b_features
 JOIN (SELECT sample_id, avg(x) AS mx, avg(y) AS my FROM b_features GROUP BY 1) USING (sample_id) GROUP BY 1, 2, 3) USING (sample_id)""", r="x y")
def _(b: Bindings):
    return coordinates.centred(b.features)


@query("fn_09_image_space", "SELECT sample_id, barcode, x * scalef AS x, y * scalef AS y FROM b_obs JOIN d_chosen USING (sample_id)",
       r="x y", d_chosen=_CHOSEN)
def _(b: Bindings):
    return coordinates.to_image_space(b.obs, expression.choose_image(b.images, b.scalefactors))


_VECTORS = """SELECT 'P' || label AS pathway, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY 1"""


def pathway_vectors(b: Bindings):
    return b.features.groupBy(F.concat(F.lit("P"), F.col("sample_id").cast("string")).alias("pathway")).agg(
        F.min_by("features", "barcode").alias("vector"))


_COS = "list_dot_product(a, v) / (greatest(sqrt(list_dot_product(a, a)), 1e-12) * greatest(sqrt(list_dot_product(v, v)), 1e-12))"


@query("fn_10_cosine_scores", f"""SELECT sample_id, barcode, pathway, {_COS} AS similarity
 FROM (SELECT sample_id, barcode, features::DOUBLE[] AS a FROM b_features), d_vec""", r="similarity", d_vec=_VECTORS)
def _(b: Bindings):
    return pooling.pathway_similarity(b.features, pathway_vectors(b))


@query("fn_10_cosine_pooled", f"""SELECT sample_id, pathway, {_COS} AS similarity FROM (
 SELECT sample_id, list(m ORDER BY pos) AS a FROM (SELECT sample_id, pos, avg(f::DOUBLE) AS m FROM (
  SELECT sample_id, unnest(features) AS f, generate_subscripts(features, 1) AS pos FROM b_features) GROUP BY 1, 2) GROUP BY 1), d_vec""",
       r="similarity", d_vec=_VECTORS)
def _(b: Bindings):
    return pooling.pathway_similarity(pooling.mean_pool(b.features), pathway_vectors(b))


@query("fn_10_most_similar", f"""SELECT sample_id, barcode, pathway, similarity, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY sample_id, barcode ORDER BY similarity DESC, pathway) AS rank FROM (
  SELECT sample_id, barcode, pathway, round({_COS}, 12) AS similarity FROM (SELECT sample_id, barcode, features::DOUBLE[] AS a FROM b_features), d_vec))
 WHERE rank <= 3""", r="similarity", i="rank", d_vec=_VECTORS)
def _(b: Bindings):
    return pooling.most_similar(b.features, pathway_vectors(b), 3)


@query("fn_11_clip_at_zero", "SELECT event_id, greatest(value - 50, 0) AS clipped FROM events", r="clipped")
def _(b: Bindings):
    return b.t("events").select("event_id", S.clipped_at_zero(F.col("value") - 50).alias("clipped"))


@query("fn_12_decode_utf8", "SELECT doc_id, text FROM documents")
def _(b: Bindings):
    raw = b.t("documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return raw.select("doc_id", S.utf8(F.col("bytes")).alias("text"))


@query("fn_13_membership_scale", """SELECT p.pathway, g.gene, CASE WHEN s.gene IS NULL THEN 0.0 ELSE 2.5 END AS value
 FROM (SELECT DISTINCT pathway FROM b_gene_sets) p CROSS JOIN b_genes g
 LEFT JOIN b_gene_sets s ON s.pathway = p.pathway AND s.gene = g.gene""", r="value")
def _(b: Bindings):
    return align.membership(b.gene_sets, b.genes, 2.5)


@query("fn_14_log_rounding", "SELECT run_name, epoch, round(click, 4) AS click, round(view, 1) AS view, purchase FROM d_wide", r="click view purchase")
def _(b: Bindings):
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    return runs.log_rounded(table, {"click": 4, "view": 1})


@query("fn_15_trace_label", """SELECT DISTINCT run_name, metric, run_name || ' (' || upper(metric[1]) || lower(metric[2:]) || ' Loss)' AS label FROM b_metrics_long""")
def _(b: Bindings):
    titled = S.trace_label(F.col("run_name"), F.concat("metric", F.lit("_loss")), F.lit(True))
    return b.metrics_long.select("run_name", "metric", titled.alias("label")).distinct()


@query("fn_16_elapsed_fields", """SELECT run_name, round(date_diff('microsecond', min(ts), max(ts)) / 1000000.0::DOUBLE, 1) AS runtime_seconds,
 count(DISTINCT epoch) AS epochs_completed FROM b_metrics_long GROUP BY 1""", r="runtime_seconds", i="epochs_completed")
def _(b: Bindings):
    return runs.elapsed_fields(b.metrics_long)


@query("fn_17_requested_files", """SELECT DISTINCT path FROM b_artifacts WHERE EXISTS (SELECT 1 FROM b_samples s WHERE organ = 'Lung'
  AND (split_part(path, '/', -1) LIKE s.id || '.%' OR starts_with(split_part(path, '/', -1), s.id || '_'))) OR path LIKE '%overview1%'""")
def _(b: Bindings):
    return registry.requested_files(registry.by_organ(b.samples, "Lung"), b.artifacts, ("%overview1%",))
