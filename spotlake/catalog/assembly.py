"""Queries PREP-* and UDF-*: splits, dropout, pooling, model hooks.

JOIN-08, PREP-03, PREP-05 and PREP-06 are held back, see the README.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spotlake.catalog.bindings import Bindings
from spotlake.catalog.registry import query
from spotlake.catalog.sources import patches
from spotlake.operators import inference, knn, metrics, pooling, splitting
from spotlake.schemas import validate

GROUPS = """SELECT g, row_number() OVER (ORDER BY h, g) - 1 AS pos, count(*) OVER () AS n FROM (
 SELECT g, CAST('0x' || substr(md5('42:' || g), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT coalesce(patient, id) AS g FROM b_samples))"""


@query("prep_01_patient_split", """SELECT id, g AS patient_group, CASE WHEN pos >= ceil(0.5::DOUBLE * n) THEN 'train'
 WHEN pos >= ceil(0.5::DOUBLE * n) - ceil(0.4::DOUBLE * ceil(0.5::DOUBLE * n)) THEN 'test' ELSE 'val' END AS split
 FROM b_samples JOIN d_groups ON coalesce(patient, id) = g""", d_groups=GROUPS)
def _(b: Bindings):
    return splitting.patient_split(b.samples, 0.3, 0.2)


@query("prep_01_patient_split_customers", """SELECT id, CASE WHEN pos < ceil(0.2::DOUBLE * n) THEN 'val' ELSE 'train' END AS split FROM (
 SELECT c_custkey AS id, g, row_number() OVER (ORDER BY h, g) - 1 AS dummy FROM (SELECT c_custkey, 'N' || c_mktsegment || c_custkey % 97 AS g,
 0 AS h FROM customer)) JOIN d_groups USING (g)""",
       d_groups="""SELECT g, row_number() OVER (ORDER BY h, g) - 1 AS pos, count(*) OVER () AS n FROM (
 SELECT g, CAST('0x' || substr(md5('7:' || g), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT 'N' || c_mktsegment || c_custkey % 97 AS g FROM customer))""")
def _(b: Bindings):
    """The same split on a registry that grows with the data: patients are groups of customers."""
    c = F.col("c_custkey")
    registry = b.t("customer").select(c.alias("id"), F.concat(
        F.lit("N"), "c_mktsegment", (c % 97).cast("string")).alias("patient"))
    return splitting.patient_split(registry, 0.2, seed=7).select("id", "split")


@query("prep_02_random_split", """SELECT barcode AS id, CASE WHEN pos < floor(n * (1.0::DOUBLE - 0.25::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM (
 SELECT barcode, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || barcode), 1, 8) AS BIGINT), barcode) - 1 AS pos, count(*) OVER () AS n FROM b_obs)""")
def _(b: Bindings):
    return splitting.random_split(b.obs.select(F.col("barcode").alias("id")), 0.25)


@query("prep_04_neighbour_dropout", """SELECT sample_id, barcode, rank, drop AND rank > 0 AS dropped, CASE WHEN drop AND rank > 0 THEN 0 ELSE total END AS total FROM (
 SELECT s.sample_id, s.barcode, s.rank, f.total, row_number() OVER (PARTITION BY s.sample_id, s.barcode, s.rank = 0
   ORDER BY CAST('0x' || substr(md5('42:' || s.sample_id || ':' || s.barcode || ':' || s.rank), 1, 8) AS BIGINT), s.rank)
   <= CAST('0x' || substr(md5('42:' || s.sample_id || ':' || s.barcode), 1, 8) AS BIGINT) % 3 AS drop
 FROM (SELECT sample_id, barcode, rank, neighbor FROM d_fedges UNION ALL SELECT sample_id, barcode, 0, barcode FROM b_features) s
 JOIN (SELECT sample_id, barcode, list_sum(features::DOUBLE[]) AS total FROM b_features) f
 ON f.sample_id = s.sample_id AND f.barcode = s.neighbor)""", r="total", i="rank")
def _(b: Bindings):
    seq = knn.neighbour_sequence(b.features, 6)
    vectors = b.features.select("sample_id", F.col("barcode").alias("neighbor"), "features")
    dropped = splitting.neighbour_dropout(seq.join(vectors, ["sample_id", "neighbor"]), 6)
    return dropped.select("sample_id", "barcode", "rank", "dropped", F.aggregate(
        "features", F.lit(0.0), lambda a, v: a + v.cast("double")).alias("total"))


@query("prep_07_valid_spots", "SELECT sample_id, pathway, count(*) AS n, sum(pred) AS total FROM b_masked WHERE NOT mask GROUP BY 1, 2", r="total", i="n")
def _(b: Bindings):
    return metrics.valid_rows(b.masked).groupBy("sample_id", "pathway").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total"))


@query("prep_08_mean_pool", """SELECT sample_id, pos, avg(f) AS value FROM (SELECT sample_id, unnest(features)::DOUBLE AS f,
 generate_subscripts(features, 1) - 1 AS pos FROM b_features) GROUP BY 1, 2""", r="value", i="pos")
def _(b: Bindings):
    return pooling.mean_pool(b.features).select("sample_id", F.posexplode("features").alias("pos", "value"))


def channel_model():
    """Stand-in backbone: mean and maximum per channel."""
    return lambda batch: np.concatenate([batch.mean(axis=(2, 3)), batch.max(axis=(2, 3))], axis=1)


_PIXELS = """SELECT sample_id, barcode, ch, i % 4 AS x, i // 4 AS y, CAST('0x' || substr(m, i * 6 + ch * 2 + 1, 2) AS INTEGER)::DOUBLE / 255 AS v FROM (
 SELECT sample_id, barcode, md5('0:' || barcode) || md5('1:' || barcode) || md5('2:' || barcode) AS m FROM b_obs),
 (SELECT unnest(generate_series(0, 15)) AS i), (SELECT unnest(generate_series(0, 2)) AS ch)"""
_NORMED = "(v - [0.485::DOUBLE, 0.456::DOUBLE, 0.406::DOUBLE][ch + 1]) / [0.229::DOUBLE, 0.224::DOUBLE, 0.225::DOUBLE][ch + 1]"


@query("udf_01_feature_extraction", f"""SELECT sample_id, barcode, ch + 3 * k AS pos, round(CASE k WHEN 0 THEN mean ELSE most END, 3) AS value FROM (
 SELECT sample_id, barcode, ch, avg({_NORMED}) AS mean, max({_NORMED}) AS most FROM d_pixels GROUP BY 1, 2, 3), (SELECT unnest([0, 1]) AS k)""",
       i="pos", d_pixels=_PIXELS)
def _(b: Bindings):
    out = inference.extract_features(patches(b), channel_model, 64)
    return out.select("sample_id", "barcode", F.posexplode("features").alias("pos", "value")).select(
        "sample_id", "barcode", "pos", F.round(F.col("value").cast("double"), 3).alias("value"))


def halves_model():
    """Stand-in head: sums of the first, second half and of all features."""
    return lambda x, _: np.stack([x[:, :32].sum(1), x[:, 32:].sum(1), x.sum(1)], axis=1)


_HALVES = """SELECT sample_id, barcode, list_sum(f[1:32]) AS a, list_sum(f[33:64]) AS b, list_sum(f) AS c FROM (
 SELECT sample_id, barcode, features::DOUBLE[] AS f FROM b_features)"""
_DENSE = """SELECT sample_id, barcode, 'low' AS pathway, a AS score FROM d_halves UNION ALL SELECT sample_id, barcode, 'high', b FROM d_halves
 UNION ALL SELECT sample_id, barcode, 'all', c FROM d_halves"""


@query("udf_02_dense_scoring", "SELECT * FROM d_dense", r="score", d_halves=_HALVES, d_dense=_DENSE)
def _(b: Bindings):
    return inference.score_spots(b.features, halves_model, ["low", "high", "all"], 64)


@query("udf_02_slide_scoring", "SELECT sample_id, pathway, avg(score) AS score FROM d_dense GROUP BY 1, 2", r="score", d_halves=_HALVES, d_dense=_DENSE)
def _(b: Bindings):
    return inference.score_slides(inference.score_spots(b.features, halves_model, ["low", "high", "all"], 64))


def centred_model():
    """Stand-in head that needs the whole slide: sums of the halves, less their mean over all spots."""
    def run(x, _):
        halves = np.stack([x[:, :32].sum(1), x[:, 32:].sum(1)], axis=1)
        return halves - halves.mean(0)
    return run


def spread_model():
    """Stand-in head with one answer for a slide: the variance of each half, and the mean distance from the centre."""
    def run(x, xy):
        halves = np.stack([x[:, :32].sum(1), x[:, 32:].sum(1)], axis=1)
        return np.append(halves.var(0), np.hypot(*(xy - xy.mean(0)).T).mean())[None]
    return run


@query("udf_02_whole_slide_dense", """SELECT sample_id, barcode, 'low' AS pathway, a - avg(a) OVER (PARTITION BY sample_id) AS score FROM d_halves
 UNION ALL SELECT sample_id, barcode, 'high', b - avg(b) OVER (PARTITION BY sample_id) FROM d_halves""", r="score", d_halves=_HALVES)
def _(b: Bindings):
    return inference.score_whole_slides(b.features, centred_model, ["low", "high"], 64)


@query("udf_02_whole_slide_global", """SELECT sample_id, pathway, CASE pathway WHEN 'low' THEN low WHEN 'high' THEN high ELSE spread END AS score FROM (
 SELECT sample_id, var_pop(a) AS low, var_pop(b) AS high FROM d_halves GROUP BY 1) JOIN (SELECT sample_id, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS spread FROM (
 SELECT sample_id, x, y, avg(x) OVER (PARTITION BY sample_id) AS mx, avg(y) OVER (PARTITION BY sample_id) AS my FROM b_features) GROUP BY 1) USING (sample_id),
 (SELECT unnest(['low', 'high', 'spread']) AS pathway)""", r="score", d_halves=_HALVES)
def _(b: Bindings):
    return inference.score_whole_slides(b.features, spread_model, ["low", "high", "spread"], 64, dense=False)


@query("udf_03_patch_scoring", "SELECT sample_id, barcode, a AS low, c AS whole FROM d_halves", r="low whole", d_halves=_HALVES)
def _(b: Bindings):
    s = inference.score_patches(b.features, halves_model)
    return s.select("sample_id", "barcode", F.col("scores")[0].alias("low"), F.col("scores")[2].alias("whole"))


def pixel_model():
    """Stand-in backbone: every pixel, channel by channel, row by row."""
    return lambda batch: batch.reshape(len(batch), -1)


# The eight symmetries of a 4 x 4 patch, written out for each number.
_MOVED = """SELECT sample_id, barcode, op, ch, v, CASE op WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 3 - x WHEN 3 THEN 3 - y WHEN 4 THEN 3 - x WHEN 5 THEN x WHEN 6 THEN y ELSE 3 - y END AS x,
 CASE op WHEN 0 THEN y WHEN 1 THEN 3 - x WHEN 2 THEN 3 - y WHEN 3 THEN x WHEN 4 THEN y WHEN 5 THEN 3 - y WHEN 6 THEN x ELSE 3 - x END AS y
 FROM (SELECT *, barcode % 8 AS op FROM d_pixels)"""


@query("udf_04_patch_preprocessing", f"""SELECT sample_id, barcode, op, ch * 16 + y * 4 + x AS pos, round({_NORMED}, 3) AS value FROM d_moved""",
       i="op pos", d_pixels=_PIXELS, d_moved=_MOVED)
def _(b: Bindings):
    moved = patches(b).withColumn("op", F.col("barcode") % 8)
    out = inference.extract_features(moved, pixel_model)
    return out.select("sample_id", "barcode", (F.col("barcode") % 8).alias("op"), F.posexplode("features").alias("pos", "value")).select(
        "sample_id", "barcode", "op", "pos", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("udf_05_contract", "SELECT sample_id, count(*) AS n FROM b_obs GROUP BY 1", i="n")
def _(b: Bindings):
    for kind, df in (("var", b.var), ("expr", b.expr), ("gene_sets", b.gene_sets), ("features", b.features),
                     ("predictions", b.predictions), ("metrics", b.metrics_long), ("samples", b.samples)):
        validate(df, kind)
    return validate(b.obs, "obs").groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
