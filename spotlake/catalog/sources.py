"""Queries SRC-*: scans and sinks. Files are written to the shared work folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.bindings import LIMITS, Bindings
from spotlake.catalog.registry import query
from spotlake.operators import align, runs
from spotlake.plans.activities import pathway_activities
from spotlake.plans.vocabulary import build_vocabulary
from spotlake.session import work_path
from spotlake.sources import expression, genesets, listing, tables
from spotlake.sources import runs as run_files


@query("src_01_registry_scan", """SELECT id, organ, disease_state, st_technology, species,
 CAST(NULL AS VARCHAR) AS preservation_method, patient FROM b_samples""")
def _(b: Bindings):
    path = work_path(b.spark, "registry")
    b.samples.select("id", "organ", "disease_state", "st_technology", "species",
                     F.lit(None).cast("string").alias("preservation_method"), "patient").write.option(
        "header", True).csv(path)
    return tables.read_registry(b.spark, path)


def _csr_blocks(b: Bindings):
    """Row blocks of 16 spots with their own gene list; every array is bounded by the block."""
    cells = b.expr.withColumn("block", F.floor(F.col("barcode") / 16))
    rows = cells.groupBy("sample_id", "block", "barcode").agg(
        F.array_sort(F.collect_list(F.struct("gene", "count"))).alias("c"))
    blocks = rows.groupBy("sample_id", "block").agg(
        F.array_sort(F.collect_list(F.struct("barcode", "c"))).alias("rows"))
    every = F.flatten(F.transform("rows", lambda r: r.c))
    blocks = blocks.select(
        "sample_id", F.transform("rows", lambda r: r.barcode).alias("barcodes"),
        F.array_sort(F.array_distinct(F.transform(every, lambda c: c.gene))).alias("genes"),
        F.transform(every, lambda c: c["count"]).alias("data"), every.alias("every"),
        F.transform("rows", lambda r: F.size(r.c)).alias("sizes"))
    return blocks.select(
        "sample_id", "barcodes", "genes", "data",
        F.transform("every", lambda c: (F.array_position("genes", c.gene) - 1).cast("int")).alias("indices"),
        F.transform(F.sequence(F.lit(0), F.size("sizes")), lambda n: F.when(n > 0, F.aggregate(
            F.slice("sizes", F.lit(1), n), F.lit(0), lambda a, v: a + v)).otherwise(0)).alias("indptr"))


@query("src_02_csr_scan", "SELECT sample_id, barcode, gene, count FROM b_expr WHERE count <> 0", r="count")
def _(b: Bindings):
    return expression.from_csr(_csr_blocks(b))


@query("src_03_dense_scan", """SELECT sample_id, barcode, p_type AS gene, sum(count) AS count FROM b_expr JOIN b_genes USING (gene)
 GROUP BY 1, 2, 3 HAVING sum(count) <> 0""", r="count")
def _(b: Bindings):
    types = b.genes.select("p_type").distinct()
    names = types.agg(F.array_sort(F.collect_set("p_type")).alias("n"))
    sums = b.expr.join(b.genes.select("gene", "p_type"), "gene").groupBy("sample_id", "barcode").agg(
        F.collect_list(F.struct("p_type", "count")).alias("c"))
    rows = sums.withColumn("n", names.scalar()).select("sample_id", "barcode", F.transform("n", lambda t: F.aggregate(
        F.filter("c", lambda e: e.p_type == t), F.lit(0.0), lambda a, e: a + e["count"])).alias("values"))
    index = b.samples.select("sample_id", F.posexplode(names.scalar()).alias("gene_pos", "gene"))
    return expression.from_dense(rows, index)


@query("src_04_metadata_scan", """SELECT o.sample_id, n_spots, coalesce(n_genes, 0) AS n_genes, images, scalefactors
 FROM (SELECT sample_id, count(*) AS n_spots FROM b_obs GROUP BY 1) o
 LEFT JOIN (SELECT sample_id, count(*) AS n_genes FROM b_var GROUP BY 1) v USING (sample_id)
 LEFT JOIN (SELECT sample_id, string_agg(image_key || ':' || h || 'x' || w, ',' ORDER BY image_key) AS images FROM b_images GROUP BY 1) i USING (sample_id)
 LEFT JOIN (SELECT sample_id, string_agg(key || '=' || printf('%.4f', value), ',' ORDER BY key) AS scalefactors FROM b_scalefactors GROUP BY 1) s USING (sample_id)""",
       i="n_spots n_genes")
def _(b: Bindings):
    return expression.metadata(b.obs, b.var, b.images, b.scalefactors)


_CHOSEN = """SELECT i.sample_id, i.image_key, h, w, arg_min(key, (CASE WHEN key = 'tissue_' || i.image_key || '_scalef' THEN 0
 WHEN contains(key, i.image_key) AND contains(key, 'scalef') THEN 1 ELSE 2 END, key)) AS scale_key,
 arg_min(value, (CASE WHEN key = 'tissue_' || i.image_key || '_scalef' THEN 0
 WHEN contains(key, i.image_key) AND contains(key, 'scalef') THEN 1 ELSE 2 END, key)) AS scalef
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY CASE WHEN image_key = 'downscaled_fullres' THEN 0 ELSE 1 END, image_key) AS r
  FROM b_images) WHERE r = 1) i JOIN b_scalefactors s USING (sample_id) GROUP BY 1, 2, 3, 4"""


@query("src_05_image_choice", "SELECT * FROM d_chosen", i="h w", r="scalef", d_chosen=_CHOSEN)
def _(b: Bindings):
    return expression.choose_image(b.images, b.scalefactors)


def patches(b: Bindings):
    """One 4 x 4 RGB patch per spot; the 48 bytes are three md5 digests of the spot id."""
    digest = F.concat(*[F.md5(F.concat(F.lit(f"{i}:"), F.col("barcode").cast("string"))) for i in range(3)])
    return b.obs.select("sample_id", "barcode", "x", "y", F.unhex(digest).alias("img"), F.lit(4).alias("h"),
                        F.lit(4).alias("w"), F.lit(3).alias("c"))


@query("src_06_patch_scan", "SELECT sample_id, count(*) AS n_patches, count(*) * 48 AS n_bytes FROM b_obs GROUP BY 1",
       i="n_patches n_bytes")
def _(b: Bindings):
    path = work_path(b.spark, "patches")
    tables.write_by_sample(patches(b), path)
    return tables.read_table(b.spark, path, "patches").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_patches"), F.sum(F.length("img")).alias("n_bytes"))


@query("src_07_feature_scan", """SELECT sample_id, barcode, x, y, len(features) AS width, list_sum(features::DOUBLE[]) AS total
 FROM b_features""", r="x y total", i="width")
def _(b: Bindings):
    path = work_path(b.spark, "features")
    tables.write_by_sample(b.features, path)
    return tables.read_table(b.spark, path, "features").select(
        "sample_id", "barcode", "x", "y", F.size("features").alias("width"),
        F.aggregate("features", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


@query("src_08_gmt_scan", "SELECT pathway, gene FROM b_gene_sets")
def _(b: Bindings):
    path = work_path(b.spark, "gmt")
    genesets.gmt_text(b.gene_sets).write.text(path)
    return genesets.read_gmt(b.spark, path, "all").select("pathway", "gene")


@query("src_09_activity_sink", """SELECT sample_id, count(*) AS n_rows, sum(score) AS total FROM d_scores
 JOIN d_enough USING (sample_id) GROUP BY 1""", r="total", i="n_rows")
def _(b: Bindings):
    root = work_path(b.spark, "activities")
    a = pathway_activities(b.obs, b.var, b.expr, b.gene_sets, LIMITS, with_morans=False)
    tables.write_activities(a.scores, None, a.attrs, root)
    scores, _ = tables.read_activities(b.spark, root)
    return scores.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("score").alias("total"))


@query("src_10_activity_scan", """SELECT pathway, barcode % 2 AS part, count(*) AS n, count(*) FILTER (WHERE barcode % 2 = 1) AS n_weight
 FROM (SELECT l_returnflag AS pathway, l_orderkey AS barcode FROM lineitem) GROUP BY 1, 2""", i="part n n_weight")
def _(b: Bindings):
    """Two generations of files: the older one lacks the weight column, which reads as NULL."""
    path = work_path(b.spark, "generations")
    rows = b.t("lineitem").select(F.col("l_returnflag").alias("pathway"), F.col("l_orderkey").alias("barcode"))
    rows.filter("barcode % 2 = 0").write.parquet(f"{path}/activities/part=0")
    rows.filter("barcode % 2 = 1").withColumn("morans_i", F.lit(0.5)).write.parquet(f"{path}/activities/part=1")
    both, _ = tables.read_activities(b.spark, path)
    return tables.with_optional(both, "morans_i", "double").groupBy("pathway", "part").agg(
        F.count(F.lit(1)).alias("n"), F.count("morans_i").alias("n_weight"))


@query("src_11_skip_finished", "SELECT sample_id, id FROM b_samples WHERE sample_id NOT IN (SELECT label FROM embeddings)")
def _(b: Bindings):
    return tables.pending(b.samples, b.features).select("sample_id", "id")


@query("src_12_sample_discovery", "SELECT DISTINCT 'sample_id=' || sample_id AS folder FROM b_obs")
def _(b: Bindings):
    path = work_path(b.spark, "discover")
    b.obs.write.partitionBy("sample_id").parquet(path)
    return tables.sample_folders(b.spark, path, ".parquet")


@query("src_13_vocabulary_sink", """SELECT gene, total_counts FROM (SELECT *, row_number() OVER (ORDER BY total_counts DESC, gene) AS r FROM d_totals)
 WHERE r <= 100""", r="total_counts")
def _(b: Bindings):
    root = work_path(b.spark, "vocabulary")
    tables.write_vocabulary(build_vocabulary(b.obs, b.var, b.expr, num_genes=100), root)
    genes = b.spark.read.schema("pos BIGINT, gene STRING").json(f"{root}/genes")
    stats = b.spark.read.schema("gene STRING, total_counts DOUBLE, morans_i DOUBLE").option("header", True).csv(f"{root}/stats")
    return genes.join(stats, "gene").select("gene", "total_counts")


@query("src_14_metrics_upsert", """WITH c AS (SELECT run_name, epoch, metric, arg_max(value, (ts, event_id)) AS value, 1 AS part FROM b_metrics_long
  WHERE hour(ts) < 12 GROUP BY 1, 2, 3), n AS (SELECT run_name, epoch, metric, arg_max(value, (ts, event_id)) AS value FROM b_metrics_long
  WHERE hour(ts) >= 12 GROUP BY 1, 2, 3)
 SELECT run_name, epoch, metric, value FROM c WHERE (run_name, epoch) NOT IN (SELECT (run_name, epoch) FROM n)
 UNION ALL SELECT * FROM n""", r="value")
def _(b: Bindings):
    late = F.hour("ts") >= 12
    return runs.upsert(runs.latest_cells(b.metrics_long.filter(~late)), runs.latest_cells(b.metrics_long.filter(late)))


@query("src_15_metrics_scan", "SELECT run_name, epoch, metric, value FROM d_cells", r="value")
def _(b: Bindings):
    """Even runs are stored as tables, odd runs only as CSV logs."""
    root = work_path(b.spark, "runs")
    cells = runs.latest_cells(b.metrics_long)
    even = F.substring_index("run_name", "_", -1).cast("bigint") % 2 == 0
    run_files.by_run(cells.filter(even)).write.partitionBy("run_name").parquet(f"{root}/table")
    run_files.by_run(cells.filter(~even)).write.partitionBy("run_name").option("header", True).csv(f"{root}/log")
    return run_files.read_run_metrics(b.spark, root)


_SUMMARY = """SELECT run_name, count(*) AS epochs_completed, min(click) AS best_loss,
 arg_min(epoch, (click, epoch)) FILTER (WHERE click IS NOT NULL) AS best_epoch, max(epoch) AS last_epoch FROM d_wide GROUP BY 1"""


@query("src_16_summary_json", """SELECT run_name, epochs_completed, round(best_loss, 6) AS best_val_loss, last_epoch, 12.3 AS runtime_seconds
 FROM d_summary""", r="best_val_loss runtime_seconds", i="epochs_completed last_epoch", d_summary=_SUMMARY)
def _(b: Bindings):
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    config = table.select("run_name").distinct().select(
        "run_name", F.struct(F.lit(6).alias("k")).alias("config"), F.lit(12.34).alias("runtime_seconds"))
    docs = runs.summary_json(runs.run_summary(table, "click"), config, F.lit("2024-01-01T00:00:00"))
    return docs.select("run_name", F.from_json(
        "doc", "epochs_completed BIGINT, best_val_loss DOUBLE, final_epoch STRUCT<epoch: INT>, runtime_seconds DOUBLE").alias("d")
    ).select("run_name", "d.epochs_completed", "d.best_val_loss", F.col("d.final_epoch.epoch").alias("last_epoch"),
             "d.runtime_seconds")


@query("src_17_collect_summaries", "SELECT run_name, best_loss AS best_val_loss, epochs_completed FROM d_summary",
       r="best_val_loss", i="epochs_completed", d_summary=_SUMMARY)
def _(b: Bindings):
    path = work_path(b.spark, "summaries")
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    runs.run_summary(table, "click").select(
        "run_name", F.col("best_loss").alias("best_val_loss"), "epochs_completed").write.json(path)
    return run_files.collect_summaries(b.spark, path, "run_name STRING, best_val_loss DOUBLE, epochs_completed BIGINT")


@query("src_18_export_runs", """WITH e AS (SELECT run_name, epoch, click, view, NULL::DOUBLE AS purchase FROM d_wide UNION ALL SELECT run_name, epoch, NULL, NULL, purchase FROM d_wide)
 SELECT 'all' AS part, * FROM e UNION ALL SELECT 'chosen', * FROM e WHERE run_name IN ('run_1', 'run_2', 'run_3', 'run_5', 'run_8')""", r="click view purchase")
def _(b: Bindings):
    """Two tables with different columns, as one export of all runs and one of chosen runs."""
    path = work_path(b.spark, "export")
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    halves = [table.select("run_name", "epoch", "click", "view"), table.select("run_name", "epoch", "purchase")]
    run_files.write_csv(run_files.export_runs(halves), f"{path}/part=all")
    run_files.write_csv(run_files.export_runs(halves, [f"run_{n}" for n in (1, 2, 3, 5, 8)]), f"{path}/part=chosen")
    return b.spark.read.schema(
        "run_name STRING, epoch INT, click DOUBLE, view DOUBLE, purchase DOUBLE, part STRING").option("header", True).csv(path)


@query("src_19_csv_to_table", "SELECT run_name, count(*) AS n, sum(value) AS total FROM d_cells GROUP BY 1", r="total", i="n")
def _(b: Bindings):
    root = work_path(b.spark, "convert")
    run_files.write_shared_log(runs.latest_cells(b.metrics_long), root)
    run_files.csv_to_table(b.spark, root)
    return run_files.read_run_metrics(b.spark, root).groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


_ART = """SELECT run_name, split_part(path, '/', -1) AS filename, regexp_extract(path, '([^/]*)_epoch_([0-9]+)[.]png$', 1) AS sample,
 CAST(regexp_extract(path, '([^/]*)_epoch_([0-9]+)[.]png$', 2) AS INTEGER) AS epoch, modificationTime AS mtime FROM b_artifacts
 WHERE regexp_matches(path, '[^/]*_epoch_[0-9]+[.]png$')"""


@query("src_20_artifact_listing", "SELECT run_name, filename, sample, epoch, strftime(mtime, '%Y-%m-%d %H:%M:%S') AS mtime FROM d_art", d_art=_ART)
def _(b: Bindings):
    parsed = runs.sort_artifacts(runs.parse_artifacts(b.artifacts))
    return parsed.withColumn("mtime", F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"))


@query("src_20_listed_artifacts", """SELECT DISTINCT 'run_' || (user_id % 8) AS run_name, 'S' || (event_id % 5) || '_epoch_' || month(ts) || '.png' AS filename,
 'S' || (event_id % 5) AS sample, month(ts)::INTEGER AS epoch, true AS stored FROM events WHERE event_id % 11 <> 0""")
def _(b: Bindings):
    """Every event is written to the artefact of its run, sample and month; a listing of the folder tells what there is."""
    root = work_path(b.spark, "artifacts")
    name = F.when(F.col("event_id") % 11 == 0, F.lit("overview.png")).otherwise(F.concat(
        F.lit("S"), (F.col("event_id") % 5).cast("string"), F.lit("_epoch_"), F.month("ts").cast("string"), F.lit(".png")))
    b.t("events").select("value", F.concat(F.lit("run_"), (F.col("user_id") % 8).cast("string")).alias("run_name"), name.alias("artifact")).repartition(
        "run_name", "artifact").write.partitionBy("run_name", "artifact").parquet(root)
    found = listing.listed_artifacts(listing.commit_listing(b.spark, root, work_path(b.spark, "listing")))
    stored = found.where("size > 0 AND modificationTime IS NOT NULL")
    return runs.sort_artifacts(runs.parse_artifacts(stored)).select("run_name", "filename", "sample", "epoch", F.lit(True).alias("stored"))


@query("src_21_run_discovery", """SELECT DISTINCT 'run_name=' || run_name AS run_name FROM b_metrics_long
 UNION SELECT 'single'""")
def _(b: Bindings):
    root = work_path(b.spark, "runroot")
    run_files.by_run(b.metrics_long.select("run_name", "epoch")).write.partitionBy("run_name").parquet(root)
    return run_files.discover_runs(b.spark, root, "/results/single", "*.parquet")


@query("src_22_injected_predictions", """SELECT o.sample_id, o.barcode, o.x, o.y, max(pred) FILTER (WHERE pathway = 'ECONOMY') AS ECONOMY,
 max(pred) FILTER (WHERE pathway = 'LARGE') AS LARGE, max(pred) FILTER (WHERE pathway = 'MEDIUM') AS MEDIUM, max(pred) FILTER (WHERE pathway = 'PROMO') AS PROMO,
 max(pred) FILTER (WHERE pathway = 'SMALL') AS SMALL, max(pred) FILTER (WHERE pathway = 'STANDARD') AS STANDARD
 FROM b_obs o JOIN b_spot_predictions p USING (sample_id, barcode) GROUP BY 1, 2, 3, 4""",
       r="ECONOMY LARGE MEDIUM PROMO SMALL STANDARD")
def _(b: Bindings):
    scores = b.spot_predictions.select("sample_id", "barcode", "pathway", F.col("pred").alias("score"))
    return align.injected_table(b.obs, scores, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])


@query("src_23_feature_location", "SELECT count(*) AS n, 'he_features_vit' AS folder FROM embeddings", i="n")
def _(b: Bindings):
    root = work_path(b.spark, "data")
    tables.write_by_sample(b.features, f"{root}/patches/he_features_vit")
    path = tables.resolve_feature_dir(b.spark, root, "vit")
    return b.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).withColumn("folder", F.lit(path.rsplit("/", 1)[-1]))
