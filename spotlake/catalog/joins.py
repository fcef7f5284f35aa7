"""Queries JOIN-* and SET-*."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from spotlake.catalog.bindings import Bindings
from spotlake.catalog.filters import passed
from spotlake.catalog.registry import query
from spotlake.operators import align, genesets, knn, ranking, splitting


def type_scores(b: Bindings):
    """A small activity table: log counts per spot and gene type, spots without counts left out."""
    return b.expr.join(b.genes.select("gene", "p_type"), "gene").groupBy(
        "sample_id", "barcode", F.col("p_type").alias("pathway")).agg(F.log1p(F.sum("count")).alias("score"))


_TYPE = """SELECT sample_id, barcode, p_type AS pathway, ln(1 + sum(count)) AS score FROM b_expr JOIN b_genes USING (gene) GROUP BY 1, 2, 3"""
_WEIGHTS = """SELECT sample_id, pathway, max(score) / 10 AS morans_i FROM d_type WHERE pathway <> 'PROMO' GROUP BY 1, 2"""


def type_weights(b: Bindings):
    return type_scores(b).filter("pathway <> 'PROMO'").groupBy("sample_id", "pathway").agg(
        (F.max("score") / 10).alias("morans_i"))


@query("join_01_align_activities", """SELECT o.sample_id, o.barcode, t.pathway, coalesce(score, 0) AS score, d.barcode IS NOT NULL AS valid
 FROM b_obs o CROSS JOIN (SELECT DISTINCT pathway FROM d_type) t
 LEFT JOIN d_type e ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.pathway = t.pathway AND e.barcode % 3 <> 0
 LEFT JOIN (SELECT DISTINCT sample_id, barcode FROM d_type WHERE barcode % 3 <> 0) d ON d.sample_id = o.sample_id AND d.barcode = o.barcode""",
       r="score", d_type=_TYPE)
def _(b: Bindings):
    # a third of the spots has no stored activities; every stored row occurs twice and the later one counts
    stored = type_scores(b).filter("barcode % 3 <> 0")
    twice = stored.withColumn("score", F.lit(-1.0)).withColumn("line", F.lit(0)).unionByName(
        stored.withColumn("line", F.lit(1)))
    return align.align_activities(b.obs.select("sample_id", "barcode"), twice, "line")


@query("join_02_expression_gene_sets", """SELECT sample_id, pathway, count(*) AS n, sum(count) AS total FROM b_expr JOIN b_gene_sets USING (gene)
 GROUP BY 1, 2""", r="total", i="n")
def _(b: Bindings):
    return b.expr.join(b.gene_sets.select("pathway", "gene"), "gene").groupBy("sample_id", "pathway").agg(
        F.count(F.lit(1)).alias("n"), F.sum("count").alias("total"))


@query("join_03_requested_pathways", """SELECT o.sample_id, o.barcode, r.pos, r.pathway, coalesce(score, 0) AS score, coalesce(morans_i, 0) AS weight
 FROM b_obs o CROSS JOIN (VALUES (0, 'SMALL'), (1, 'UNKNOWN'), (2, 'PROMO')) r(pos, pathway)
 LEFT JOIN d_type e ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.pathway = r.pathway
 LEFT JOIN d_weights w ON w.sample_id = o.sample_id AND w.pathway = r.pathway""", r="score weight", i="pos", d_type=_TYPE, d_weights=_WEIGHTS)
def _(b: Bindings):
    k = F.col("r_regionkey")
    requested = b.t("region").filter(k < 3).select(k.alias("pos"), F.when(k == 0, "SMALL").when(
        k == 1, "UNKNOWN").otherwise("PROMO").alias("pathway"))
    return align.project_requested(b.obs, type_scores(b), type_weights(b), requested)


@query("join_04_knn_edges", "SELECT sample_id, barcode, neighbor, d2, rank, 1 / 6.0::DOUBLE AS w FROM d_edges", r="d2 w", i="rank")
def _(b: Bindings):
    return knn.weighted_edges(knn.knn_edges(b.obs, 6), 6)


@query("join_04_knn_features", "SELECT sample_id, barcode, neighbor, d2, rank FROM d_fedges", r="d2", i="rank")
def _(b: Bindings):
    """Irregular coordinates, forced through the leaf join that serves slides of any size."""
    return knn.knn_edges(b.features, 6, slide_size=0)


@query("join_05_knn_subset", """SELECT q.sample_id, q.barcode, s.rank, coalesce(e.neighbor, q.barcode) AS neighbor
 FROM d_passed q CROSS JOIN (SELECT unnest(generate_series(1, 6)) AS rank) s
 LEFT JOIN d_edges e ON e.sample_id = q.sample_id AND e.barcode = q.barcode AND e.rank = s.rank""", i="rank")
def _(b: Bindings):
    seq = knn.neighbour_sequence(b.obs, 6, passed(b))
    return seq.filter(F.col("rank") > 0).select("sample_id", "barcode", "rank", "neighbor")


@query("join_06_knn_sequence", """SELECT o.sample_id, o.barcode, s.rank, coalesce(e.neighbor, o.barcode) AS neighbor,
 s.rank > 0 AND e.neighbor IS NULL AS padded FROM b_features o CROSS JOIN (SELECT unnest(generate_series(0, 6)) AS rank) s
 LEFT JOIN d_fedges e ON e.sample_id = o.sample_id AND e.barcode = o.barcode AND e.rank = s.rank""", i="rank")
def _(b: Bindings):
    return knn.neighbour_sequence(b.features, 6)


@query("join_07_global_context", """SELECT o.sample_id, o.barcode AS centre, s.slot, p.barcode FROM b_obs o
 CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS slot) s
 JOIN (SELECT sample_id, count(*) AS n FROM b_obs GROUP BY 1) c ON c.sample_id = o.sample_id
 JOIN (SELECT sample_id, barcode, row_number() OVER (PARTITION BY sample_id ORDER BY barcode) - 1 AS idx FROM b_obs) p
 ON p.sample_id = o.sample_id AND p.idx = CAST('0x' || substr(md5('42:' || o.sample_id || ':' || o.barcode || ':' || s.slot), 1, 8) AS BIGINT) % n""",
       i="slot")
def _(b: Bindings):
    return align.context_spots(b.obs, b.obs, 4)


@query("join_09_membership", """SELECT p.pathway, g.gene, CASE WHEN s.gene IS NULL THEN 0.0 ELSE 1.0 END AS value
 FROM (SELECT DISTINCT pathway FROM b_gene_sets) p CROSS JOIN b_genes g
 LEFT JOIN b_gene_sets s ON s.pathway = p.pathway AND s.gene = g.gene""", r="value")
def _(b: Bindings):
    return align.membership(b.gene_sets, b.genes)


@query("join_10_semi_anti", """SELECT sample_id, sample_id IN (SELECT label FROM embeddings) AS has_features FROM b_samples""")
def _(b: Bindings):
    have = b.samples.join(b.features.select("sample_id").distinct(), "sample_id", "left_semi")
    lack = b.samples.join(b.features.select("sample_id").distinct(), "sample_id", "left_anti")
    return have.select("sample_id", F.lit(True).alias("has_features")).unionByName(
        lack.select("sample_id", F.lit(False).alias("has_features")))


@query("join_11_attach_weights", "SELECT o.sample_id, o.barcode, pathway, morans_i FROM b_obs o LEFT JOIN (SELECT * FROM d_weights WHERE sample_id <> 3) w USING (sample_id)",
       r="morans_i", d_type=_TYPE, d_weights=_WEIGHTS)
def _(b: Bindings):
    """One slide has no weights and keeps its spots."""
    return align.attach_weights(b.obs.select("sample_id", "barcode"), type_weights(b).filter("sample_id <> 3"))


_PSEUDO = """SELECT gene, total_counts, avg_count AS morans_i, row_number() OVER (ORDER BY total_counts DESC, gene) - 1 AS expr_rank,
 row_number() OVER (ORDER BY round(avg_count, 9) DESC, gene) - 1 AS moran_rank FROM (SELECT gene, sum(count) AS total_counts, avg(count) AS avg_count FROM b_expr GROUP BY 1)"""


def gene_table(b: Bindings):
    """Gene totals with the mean count in the place of a second score."""
    return b.expr.groupBy("gene").agg(F.sum("count").alias("total_counts"), F.avg("count").alias("morans_i"))


@query("join_12_two_ranks", "SELECT gene, expr_rank, moran_rank FROM d_ranks", i="expr_rank moran_rank", d_ranks=_PSEUDO)
def _(b: Bindings):
    return ranking.gene_ranks(gene_table(b)).select("gene", "expr_rank", "moran_rank")


_GROUPS = """SELECT g, row_number() OVER (ORDER BY h, g) - 1 AS pos, count(*) OVER () AS n FROM (
 SELECT g, CAST('0x' || substr(md5('42:' || g), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT coalesce(patient, id) AS g FROM b_samples))"""


@query("join_13_split_available", """SELECT id, g AS patient_group, CASE WHEN pos < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split
 FROM b_samples JOIN d_groups ON coalesce(patient, id) = g WHERE sample_id IN (SELECT label FROM embeddings)""", d_groups=_GROUPS)
def _(b: Bindings):
    have = b.samples.join(b.features.select("sample_id").distinct(), "sample_id", "left_semi")
    return splitting.restrict_split(splitting.patient_split(b.samples, 0.2), have)


# ---------------------------------------------------------------- set operations

_TOP = """SELECT sample_id, gene, total_counts, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total_counts DESC, gene) AS r
 FROM (SELECT sample_id, gene, sum(count) AS total_counts FROM b_expr GROUP BY 1, 2)) WHERE r <= 400"""


@query("set_01_top_genes_in_all_or_any", """SELECT gene, count(*) = 25 AS in_all FROM d_top GROUP BY 1""", d_top=_TOP)
def _(b: Bindings):
    top = ranking.top_genes_per_sample(b.expr, 400)
    every = genesets.in_all(top).withColumn("in_all", F.lit(True))
    return genesets.in_any(top).join(every, "gene", "left").na.fill({"in_all": False})


@query("set_02_panel_genes_in_all", """SELECT scope, gene FROM (SELECT 'all' AS scope, gene FROM b_var GROUP BY gene HAVING count(*) = 25
 UNION ALL SELECT 'Visium', gene FROM b_var JOIN b_samples USING (sample_id) WHERE contains(st_technology, 'Visium') GROUP BY gene
 HAVING count(*) = (SELECT count(*) FROM b_samples WHERE contains(st_technology, 'Visium')))""")
def _(b: Bindings):
    visium = b.samples.filter(F.col("st_technology").contains("Visium")).select("sample_id")
    part = genesets.in_all(b.var.join(visium, "sample_id", "left_semi"))
    return genesets.in_all(b.var).select(F.lit("all").alias("scope"), "gene").unionByName(
        part.select(F.lit("Visium").alias("scope"), "gene"))


@query("set_03_concatenate", "SELECT organ, count(*) AS n FROM b_obs JOIN b_samples USING (sample_id) GROUP BY 1", i="n")
def _(b: Bindings):
    spots = b.obs.join(b.samples.select("sample_id", "organ"), "sample_id")
    parts = [spots.filter(F.col("organ") == organ) for organ in ("Bowel", "bowel", "Breast", "Kidney", "Lung")]
    return reduce(lambda a, c: a.unionByName(c), parts).groupBy("organ").agg(F.count(F.lit(1)).alias("n"))


def _collections(b: Bindings):
    """Brand sets from two collections: every brand set occurs again in a second collection with fewer genes."""
    first = b.gene_sets.filter("collection = 'brands'").withColumn("pos", F.lit(0))
    again = first.filter(F.length("gene") % 2 == 0).withColumn("pos", F.lit(1))
    return first.unionByName(again).unionByName(b.gene_sets.filter("collection = 'types'").withColumn("pos", F.lit(2)))


@query("set_04_merge_first_wins", "SELECT pathway, gene FROM b_gene_sets")
def _(b: Bindings):
    return genesets.merge_first(_collections(b)).select("pathway", "gene")


@query("set_05_merge_last_wins", """SELECT pathway, gene FROM b_gene_sets WHERE collection = 'types' OR len(gene) % 2 = 0
 OR pathway NOT IN (SELECT pathway FROM b_gene_sets WHERE collection = 'brands' AND len(gene) % 2 = 0)""")
def _(b: Bindings):
    return genesets.merge_last(_collections(b)).select("pathway", "gene")


@query("set_06_missing_and_extra", """SELECT 'missing' AS side, sample_id FROM b_samples WHERE sample_id NOT IN (SELECT label FROM embeddings)
 UNION ALL SELECT DISTINCT 'extra', label FROM embeddings WHERE label NOT IN (SELECT sample_id FROM b_samples WHERE species = 'Homo sapiens')""")
def _(b: Bindings):
    human = b.samples.filter("species = 'Homo sapiens'")
    missing = genesets.difference(b.samples, b.features, "sample_id")
    extra = genesets.difference(b.features, human, "sample_id")
    return missing.select(F.lit("missing").alias("side"), "sample_id").unionByName(
        extra.select(F.lit("extra").alias("side"), "sample_id"))


@query("set_07_overlap", "SELECT gene FROM b_var INTERSECT SELECT gene FROM b_gene_sets")
def _(b: Bindings):
    return genesets.overlap(b.var, b.gene_sets, "gene")


