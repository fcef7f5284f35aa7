"""The driver tables seen as domain tables: DataFrames for Spark and, independently, CTE texts for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators.index import position_by_number
from spotlake.plans.activities import Thresholds
from spotlake.session import dealt

LIMITS = Thresholds(min_umis=500, min_genes=20, max_mt=0.25, min_set_genes=5, min_pathways=25, k=6)


class Bindings:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        k, r = F.col("n_nationkey"), F.col("n_regionkey")
        return self.t("nation").select(
            k.alias("sample_id"), F.concat(F.lit("S"), k.cast("string")).alias("id"),
            F.when(r == 0, "Bowel").when(r == 1, "Breast").when(r == 2, "Kidney").when(r == 3, "Lung")
            .otherwise("bowel").alias("organ"),
            F.when(k % 2 == 0, "Cancer").otherwise("Healthy").alias("disease_state"),
            F.when(k % 3 == 0, "Visium").when(k % 3 == 1, "Visium HD").otherwise("Xenium").alias("st_technology"),
            F.when(k % 4 == 3, "Mus musculus").otherwise("Homo sapiens").alias("species"),
            F.when(k % 5 == 4, F.lit(None)).otherwise(F.concat(F.lit("P"), (k % 7).cast("string"))).alias("patient"))

    @cached_property
    def obs(self) -> DataFrame:
        placed = position_by_number(
            self.t("customer").select(F.col("c_nationkey").alias("sample_id"), F.col("c_custkey").alias("barcode")),
            ["sample_id"], "barcode", "i")
        row, col = F.floor(F.col("i") / 8), F.col("i") % 8
        return placed.select(
            "sample_id", "barcode",
            (col * 256 + F.when(row % 2 == 1, 128).otherwise(0)).cast("double").alias("x"),
            (row * 256).cast("double").alias("y"))

    @cached_property
    def genes(self) -> DataFrame:
        return self.t("part").select(
            "p_partkey", F.concat(F.when(F.col("p_type") == "PROMO", "MT-").otherwise("G"),
                                  F.col("p_partkey").cast("string")).alias("gene"), "p_brand", "p_type")

    @cached_property
    def var(self) -> DataFrame:
        # the two panels differ by odd parts; a part row is expanded to the slides of its panels
        return self.on_every_slide(self.genes).filter(
            ~((F.col("sample_id") % 5 == 4) & (F.col("p_partkey") % 2 == 1))).select("sample_id", "gene")

    def on_every_slide(self, parts: DataFrame) -> DataFrame:
        """``parts`` (with p_partkey) once per slide.

        The rows are dealt out before they multiply, since the file of the parts is small and would be one task. Spark's size
        estimate of a cross join counts the copies, that of an exploded array does not and leads to broadcasts of the panel.
        """
        slides = self.t("nation").select(F.col("n_nationkey").alias("sample_id")).where("sample_id IS NOT NULL")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return parts.repartition(tasks, "p_partkey").crossJoin(F.broadcast(slides))

    @cached_property
    def _items(self) -> DataFrame:
        # The files of orders, customers and parts are much smaller than their rows, and Spark goes by the file when it chooses
        # a broadcast. They grow with the data, so they are dealt out and merged: the driver never holds one of them.
        orders = dealt(self.t("orders").select("o_orderkey", "o_custkey"), "o_orderkey").hint("merge")
        customers = dealt(self.t("customer").select("c_custkey", "c_nationkey"), "c_custkey").hint("merge")
        return self.t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            customers, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def expr(self) -> DataFrame:
        cells = self._items.filter(~((F.col("c_nationkey") % 5 == 4) & (F.col("l_partkey") % 2 == 1))).groupBy(
            F.col("c_nationkey").alias("sample_id"), F.col("c_custkey").alias("barcode"), "l_partkey").agg(
            F.sum("l_quantity").alias("count"))
        return cells.join(dealt(self.genes, "p_partkey").hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
            "sample_id", "barcode", "gene", "count")

    @cached_property
    def gene_sets(self) -> DataFrame:
        brands = self.genes.select(F.lit("brands").alias("collection"), F.concat(
            F.lit("HALLMARK_"), F.upper(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("pathway"), "gene")
        types = self.genes.select(F.lit("types").alias("collection"), F.concat(
            F.lit("HALLMARK_TYPE_"), "p_type").alias("pathway"), "gene")
        return brands.unionByName(types)

    @cached_property
    def features(self) -> DataFrame:
        e = F.col("embedding")
        return self.t("embeddings").select(
            F.col("label").alias("sample_id"), F.col("vec_id").alias("barcode"), (e[0].cast("double") * 1000).alias("x"),
            (e[1].cast("double") * 1000).alias("y"), e.alias("features"))

    @cached_property
    def predictions(self) -> DataFrame:
        return self._items.select(
            F.col("c_nationkey").alias("sample_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("barcode"),
            F.col("l_returnflag").alias("pathway"), (F.col("l_extendedprice") / 10000).alias("pred"),
            (F.col("l_quantity") / 5).alias("target"))

    @cached_property
    def masked(self) -> DataFrame:
        """Predictions where every tenth position counts as padding."""
        return self.predictions.withColumn("mask", F.col("barcode") % 10 == 7)

    @cached_property
    def spot_predictions(self) -> DataFrame:
        """Complete predictions: every spot has one row per gene type."""
        per_type = self.expr.join(dealt(self.genes.select("gene", "p_type"), "gene").hint("merge"), "gene").groupBy(
            "sample_id", "barcode", F.col("p_type").alias("pathway")).agg(F.sum("count").alias("s"))
        types = self.genes.agg(F.array_sort(F.collect_set("p_type"))).scalar()
        full = self.obs.select("sample_id", "barcode", F.explode(types).alias("pathway")).join(
            per_type, ["sample_id", "barcode", "pathway"], "left")
        target = F.log1p(F.coalesce("s", F.lit(0.0)))
        return full.select("sample_id", "barcode", "pathway",
                           (target * 0.8 + (F.col("barcode") % 7) * 0.1).alias("pred"), target.alias("target"))

    @cached_property
    def attention(self) -> DataFrame:
        return self._items.groupBy(
            F.col("c_nationkey").alias("sample_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("barcode")
        ).agg(F.avg("l_discount").alias("attention"))

    @cached_property
    def metrics_long(self) -> DataFrame:
        return self.t("events").select(
            F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_name"), F.dayofmonth("ts").alias("epoch"),
            F.col("event_type").alias("metric"), "value", "ts", "event_id")

    @cached_property
    def images(self) -> DataFrame:
        k = F.col("n_nationkey")
        keys = F.array_compact(F.array(F.lit("hires"), F.lit("lowres"), F.when(k % 4 == 0, F.lit("downscaled_fullres"))))
        return self.t("nation").select(k.alias("sample_id"), F.explode(keys).alias("image_key")).withColumn(
            "h", F.when(F.col("image_key") == "lowres", 600).otherwise(2000 + F.col("sample_id") * 10)).withColumn(
            "w", F.col("h") + 50)

    @cached_property
    def scalefactors(self) -> DataFrame:
        k = F.col("n_nationkey")
        keys = F.array_compact(F.array(
            F.when(k % 2 == 0, F.lit("tissue_hires_scalef")), F.when(k % 3 == 0, F.lit("hires_alt_scalef")),
            F.lit("spot_diameter"), F.when(k % 8 == 0, F.lit("tissue_downscaled_fullres_scalef"))))
        return self.t("nation").select(k.alias("sample_id"), F.explode(keys).alias("key")).withColumn(
            "value", F.length("key") / 100.0 + F.col("sample_id") / 1000.0)

    @cached_property
    def artifacts(self) -> DataFrame:
        e = F.col("event_id").cast("string")
        name = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("overview"), e)).when(
            F.col("event_id") % 10 == 1, F.concat(F.lit("S1_epoch_x"), e)).otherwise(F.concat(
                F.lit("S"), (F.col("event_id") % 25).cast("string"), F.lit("_epoch_"), F.dayofmonth("ts").cast("string")))
        run = F.concat(F.lit("run_"), F.col("user_id").cast("string"))
        return self.t("events").select(
            F.concat(F.lit("runs/"), run, F.lit("/"), name, F.lit(".png")).alias("path"), run.alias("run_name"),
            F.col("ts").alias("modificationTime"))


# The same tables for the oracle. Order matters: later texts use earlier ones.
CTES: dict[str, str] = {
    "b_samples": """SELECT n_nationkey AS sample_id, 'S' || n_nationkey AS id,
 CASE n_regionkey WHEN 0 THEN 'Bowel' WHEN 1 THEN 'Breast' WHEN 2 THEN 'Kidney' WHEN 3 THEN 'Lung' ELSE 'bowel' END AS organ,
 CASE WHEN n_nationkey % 2 = 0 THEN 'Cancer' ELSE 'Healthy' END AS disease_state,
 CASE n_nationkey % 3 WHEN 0 THEN 'Visium' WHEN 1 THEN 'Visium HD' ELSE 'Xenium' END AS st_technology,
 CASE WHEN n_nationkey % 4 = 3 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS species,
 CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'P' || (n_nationkey % 7) END AS patient FROM nation""",
    "b_obs": """SELECT sample_id, barcode,
 CAST(256 * (i % 8) + CASE WHEN (i // 8) % 2 = 1 THEN 128 ELSE 0 END AS DOUBLE) AS x, CAST(256 * (i // 8) AS DOUBLE) AS y
 FROM (SELECT c_nationkey AS sample_id, c_custkey AS barcode,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer)""",
    "b_genes": """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'MT-' ELSE 'G' END || p_partkey AS gene, p_brand, p_type FROM part""",
    "b_var": """SELECT n_nationkey AS sample_id, gene FROM nation CROSS JOIN b_genes WHERE NOT (n_nationkey % 5 = 4 AND p_partkey % 2 = 1)""",
    "b_expr": """SELECT c_nationkey AS sample_id, c_custkey AS barcode, gene, SUM(l_quantity) AS count
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN b_genes ON l_partkey = p_partkey
 WHERE NOT (c_nationkey % 5 = 4 AND p_partkey % 2 = 1) GROUP BY 1, 2, 3""",
    "b_gene_sets": """SELECT 'brands' AS collection, 'HALLMARK_' || upper(replace(p_brand, '#', '_')) AS pathway, gene FROM b_genes
 UNION ALL SELECT 'types', 'HALLMARK_TYPE_' || p_type, gene FROM b_genes""",
    "b_features": """SELECT label AS sample_id, vec_id AS barcode, CAST(embedding[1] AS DOUBLE) * 1000 AS x,
 CAST(embedding[2] AS DOUBLE) * 1000 AS y, embedding AS features FROM embeddings""",
    "b_predictions": """SELECT c_nationkey AS sample_id, l_orderkey * 10 + l_linenumber AS barcode, l_returnflag AS pathway,
 l_extendedprice / 10000 AS pred, l_quantity / 5 AS target
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "b_masked": "SELECT *, barcode % 10 = 7 AS mask FROM b_predictions",
    "b_spot_predictions": """SELECT sample_id, barcode, pathway, 0.8::DOUBLE * target + (barcode % 7) * 0.1::DOUBLE AS pred, target FROM (
 SELECT o.sample_id, o.barcode, t.pathway, ln(1 + coalesce(s, 0)) AS target
 FROM b_obs o CROSS JOIN (SELECT DISTINCT p_type AS pathway FROM b_genes) t
 LEFT JOIN (SELECT sample_id, barcode, p_type AS pathway, sum(count) AS s FROM b_expr JOIN b_genes USING (gene) GROUP BY ALL) e
 ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.pathway = t.pathway)""",
    "b_attention": """SELECT c_nationkey AS sample_id, l_orderkey * 10 + l_linenumber AS barcode, avg(l_discount) AS attention
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "b_metrics_long": """SELECT 'run_' || user_id AS run_name, CAST(day(ts) AS INTEGER) AS epoch, event_type AS metric, value, ts, event_id FROM events""",
    "b_images": """SELECT sample_id, image_key, h, h + 50 AS w FROM (SELECT n_nationkey AS sample_id, image_key,
 CASE WHEN image_key = 'lowres' THEN 600 ELSE 2000 + n_nationkey * 10 END AS h
 FROM nation CROSS JOIN (VALUES ('hires'), ('lowres'), ('downscaled_fullres')) k(image_key)
 WHERE image_key <> 'downscaled_fullres' OR n_nationkey % 4 = 0)""",
    "b_scalefactors": """SELECT n_nationkey AS sample_id, key, length(key) / 100.0::DOUBLE + n_nationkey / 1000.0::DOUBLE AS value
 FROM nation CROSS JOIN (VALUES ('tissue_hires_scalef', 2), ('hires_alt_scalef', 3), ('spot_diameter', 1),
 ('tissue_downscaled_fullres_scalef', 8)) k(key, m) WHERE n_nationkey % m = 0""",
    "b_artifacts": """SELECT 'runs/run_' || user_id || '/' || CASE WHEN event_id % 10 = 0 THEN 'overview' || event_id
 WHEN event_id % 10 = 1 THEN 'S1_epoch_x' || event_id ELSE 'S' || (event_id % 25) || '_epoch_' || day(ts) END || '.png' AS path,
 'run_' || user_id AS run_name, ts AS modificationTime FROM events""",
    # derived tables shared by several oracles
    "d_spot_qc": """SELECT o.sample_id, o.barcode, o.x, o.y, coalesce(umis, 0) AS umis, coalesce(n_genes, 0) AS n_genes,
 coalesce(mt, 0) AS mt_counts, coalesce(mt, 0) / (coalesce(umis, 0) + 1e-9::DOUBLE) AS mt_frac
 FROM b_obs o LEFT JOIN (SELECT sample_id, barcode, sum(count) AS umis, count(*) FILTER (WHERE count > 0) AS n_genes,
  sum(CASE WHEN regexp_matches(lower(gene), '^(mt-|mt:|mt_|grcm38_mt-|hs_mt-)') THEN count ELSE 0 END) AS mt
  FROM b_expr GROUP BY 1, 2) e USING (sample_id, barcode)""",
    "d_passed": "SELECT * FROM d_spot_qc WHERE umis >= 500 AND n_genes >= 20 AND mt_frac <= 0.25::DOUBLE",
    "d_x": """SELECT sample_id, barcode, gene, ln(1 + count / greatest(umis, 1.0::DOUBLE) * 10000) AS x
 FROM b_expr JOIN d_passed USING (sample_id, barcode)""",
    "d_moments": """SELECT sample_id, gene, avg(v) AS mu, CASE WHEN var_pop(v) > 0 THEN stddev_pop(v) ELSE 1 END AS sigma FROM (
 SELECT p.sample_id, p.barcode, v.gene, coalesce(d_x.x, 0) AS v FROM d_passed p JOIN b_var v USING (sample_id)
 LEFT JOIN d_x ON d_x.sample_id = p.sample_id AND d_x.barcode = p.barcode AND d_x.gene = v.gene) GROUP BY 1, 2""",
    "d_members": """SELECT v.sample_id, s.pathway, count(*) AS n_genes, sum(mu / sigma) AS shift
 FROM b_var v JOIN b_gene_sets s USING (gene) JOIN d_moments m USING (sample_id, gene) GROUP BY 1, 2""",
    "d_pairs": """SELECT p.sample_id, s.pathway, coalesce(n_genes, 0) AS n_genes, coalesce(shift, 0) AS shift
 FROM (SELECT DISTINCT sample_id FROM d_passed) p CROSS JOIN (SELECT DISTINCT pathway FROM b_gene_sets) s
 LEFT JOIN d_members m ON m.sample_id = p.sample_id AND m.pathway = s.pathway""",
    "d_scores": """SELECT p.sample_id, p.barcode, q.pathway,
 CASE WHEN q.n_genes >= 5 THEN (coalesce(z.part, 0) - q.shift) / q.n_genes ELSE 0 END AS score
 FROM d_passed p JOIN d_pairs q USING (sample_id)
 LEFT JOIN (SELECT d_x.sample_id, d_x.barcode, s.pathway, sum(x / sigma) AS part FROM d_x JOIN d_moments USING (sample_id, gene)
  JOIN b_gene_sets s USING (gene) GROUP BY 1, 2, 3) z
 ON z.sample_id = p.sample_id AND z.barcode = p.barcode AND z.pathway = q.pathway""",
    "d_enough": "SELECT sample_id FROM d_pairs GROUP BY 1 HAVING count(*) FILTER (WHERE n_genes >= 5) >= 25",
    "d_report": """SELECT sample_id, count(*) AS total,
 count(*) FILTER (WHERE umis >= 500 AND n_genes >= 20 AND mt_b <= 0.25::DOUBLE) AS kept, count(*) FILTER (WHERE umis < 500) AS low_umi,
 count(*) FILTER (WHERE n_genes < 20) AS low_gene, count(*) FILTER (WHERE mt_b > 0.25::DOUBLE) AS high_mt,
 count(*) FILTER (WHERE umis >= 500 AND n_genes >= 20 AND mt_b <= 0.25::DOUBLE) / count(*)::DOUBLE AS kept_share
 FROM (SELECT q.*, coalesce(b.mt, 0) / (q.umis + 1e-9::DOUBLE) AS mt_b FROM d_spot_qc q LEFT JOIN (
  SELECT sample_id, barcode, sum(count) AS mt FROM b_expr WHERE contains(lower(gene), 'mt-') OR contains(lower(gene), 'mt:')
  GROUP BY 1, 2) b USING (sample_id, barcode)) GROUP BY 1""",
    "d_edges": """SELECT sample_id, i AS barcode, j AS neighbor, d2, rank FROM (SELECT a.sample_id, a.barcode AS i, b.barcode AS j,
 (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
 row_number() OVER (PARTITION BY a.sample_id, a.barcode ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.barcode) AS rank
 FROM b_obs a JOIN b_obs b ON a.sample_id = b.sample_id AND a.barcode <> b.barcode) WHERE rank <= 6""",
    "d_fedges": """SELECT sample_id, i AS barcode, j AS neighbor, d2, rank FROM (SELECT a.sample_id, a.barcode AS i, b.barcode AS j,
 (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2,
 row_number() OVER (PARTITION BY a.sample_id, a.barcode ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.barcode) AS rank
 FROM b_features a JOIN b_features b ON a.sample_id = b.sample_id AND a.barcode <> b.barcode) WHERE rank <= 6""",
    "d_cells": """SELECT run_name, epoch, metric, arg_max(value, (ts, event_id)) AS value FROM b_metrics_long GROUP BY 1, 2, 3""",
    "d_wide": """SELECT run_name, epoch, max(value) FILTER (WHERE metric = 'click') AS click, max(value) FILTER (WHERE metric = 'view') AS view,
 max(value) FILTER (WHERE metric = 'purchase') AS purchase FROM d_cells GROUP BY 1, 2""",
    "d_losses": "SELECT run_name, epoch, value AS val_loss FROM d_cells WHERE metric = 'click'",
    "d_totals": "SELECT gene, sum(count) AS total_counts FROM b_expr GROUP BY 1",
    "d_slide_pcc": """SELECT sample_id, pathway, count(*) AS n, stddev_samp(target) AS target_std,
 count(*) * covar_pop(pred, target) / (sqrt(count(*) * var_pop(pred) + 1e-8::DOUBLE) * sqrt(count(*) * var_pop(target) + 1e-8::DOUBLE)) AS pcc
 FROM b_predictions GROUP BY 1, 2""",
}


def oracle(body: str, **extra: str) -> str:
    """``body`` with the CTEs it needs, in order; ``extra`` adds local CTEs."""
    texts = {**CTES, **extra}
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in texts:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(texts[name])
    parts = [f"{n} AS MATERIALIZED ({texts[n]})" for n in texts if n in need]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
