import pytest
from pyspark.sql import functions as F

from spotlake import schemas
from spotlake.operators import align, coordinates
from spotlake.session import work_path
from spotlake.sources import expression, genesets, tables


def test_gmt_rules(spark):
    path = work_path(spark, "gmt")
    lines = ["\tA\tdesc\tg1\tg2\t ", "B\tonly", "A\tlater\tg3", "C\td\tg1\tg1", ""]
    spark.createDataFrame([("\n".join(lines),)], "value STRING").coalesce(1).write.text(path)
    got = sorted((r.pathway, r.gene) for r in genesets.read_gmt(spark, path, "x").collect())
    assert got == [("A", "g3"), ("C", "g1"), ("C", "g1")]


def test_csr_and_dense(spark):
    block = spark.createDataFrame(
        [(0, ["s1", "s2", "s3"], ["gA", "gB"], [1.0, 2.0, 0.0, 5.0], [0, 1, 0, 1], [0, 2, 2, 4])],
        "sample_id INT, barcodes ARRAY<STRING>, genes ARRAY<STRING>, data ARRAY<DOUBLE>, indices ARRAY<INT>, indptr ARRAY<INT>")
    want = [("s1", "gA", 1.0), ("s1", "gB", 2.0), ("s3", "gB", 5.0)]
    assert sorted((r.barcode, r.gene, r["count"]) for r in expression.from_csr(block).collect()) == want
    rows = spark.createDataFrame([(0, "s1", [1.0, 2.0]), (0, "s2", [0.0, 0.0]), (0, "s3", [0.0, 5.0])],
                                 "sample_id INT, barcode STRING, values ARRAY<DOUBLE>")
    genes = spark.createDataFrame([(0, 0, "gA"), (0, 1, "gB")], "sample_id INT, gene_pos INT, gene STRING")
    assert sorted((r.barcode, r.gene, r["count"]) for r in expression.from_dense(rows, genes).collect()) == want


def test_image_choice(spark):
    images = spark.createDataFrame([(0, "hires", 10, 10), (1, "lowres", 5, 5), (2, "hires", 9, 9), (2, "downscaled_fullres", 7, 7)],
                                   "sample_id INT, image_key STRING, h INT, w INT")
    factors = spark.createDataFrame([(0, "tissue_hires_scalef", 0.5), (0, "a", 9.0), (1, "x_lowres_scalef", 0.1), (1, "b", 2.0),
                                     (2, "z", 3.0), (2, "y", 4.0)], "sample_id INT, key STRING, value DOUBLE")
    got = {r.sample_id: (r.image_key, r.scalef) for r in expression.choose_image(images, factors).collect()}
    assert got == {0: ("hires", 0.5), 1: ("lowres", 0.1), 2: ("downscaled_fullres", 4.0)}


def test_activity_round_trip_and_skip(spark):
    root = work_path(spark, "acts")
    scores = spark.createDataFrame([(s, b, p, float(b)) for s in (0, 1) for b in range(5) for p in "ab"],
                                   "sample_id INT, barcode INT, pathway STRING, score DOUBLE")
    attrs = spark.createDataFrame([(0, 5), (1, 5)], "sample_id INT, n_spots_after_qc INT")
    tables.write_activities(scores, None, attrs, root)
    back, morans = tables.read_activities(spark, root)
    assert morans is None and back.count() == 20
    morans = spark.createDataFrame([(0, "a", 0.1)], "sample_id INT, pathway STRING, morans_i DOUBLE")
    tables.write_activities(scores.filter("sample_id = 0"), morans, attrs.filter("sample_id = 0"), root, overwrite=True)
    back, morans = tables.read_activities(spark, root)
    assert back.count() == 20 and morans.count() == 1  # sample 1 stays, sample 0 is replaced
    todo = spark.createDataFrame([(0,), (7,)], "sample_id INT")
    assert [r.sample_id for r in tables.pending(todo, back).collect()] == [7]
    assert tables.pending(todo, back, overwrite=True).count() == 2


def test_feature_folder(spark):
    with pytest.raises(FileNotFoundError):
        tables.resolve_feature_dir(spark, "/nowhere", "vit")
    assert tables.candidate_feature_dirs("/d", "vit") == ["/d/he_features_vit", "/d/patches/he_features_vit"]
    assert tables.candidate_feature_dirs("/d", explicit="/e") == ["/e"]


def test_contract(spark):
    good = spark.createDataFrame([(0, 1, 0.0, 0.0)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    assert schemas.validate(good, "obs") is good
    with pytest.raises(ValueError):
        schemas.validate(good.drop("x"), "obs")
    with pytest.raises(TypeError):
        schemas.validate(good.withColumn("x", F.lit("a")), "obs")
    with pytest.raises(KeyError):
        schemas.validate(good, "unknown")


def test_injected_table_checks(spark):
    obs = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    preds = spark.createDataFrame([(0, b, p, 0.5 * b) for b in (1, 2) for p in ("pathway_0", "pathway_1")],
                                  "sample_id INT, barcode INT, pathway STRING, score DOUBLE")
    out = align.injected_table(obs, preds, align.default_names(2))
    assert out.columns == ["sample_id", "barcode", "x", "y", "pathway_0", "pathway_1"] and out.count() == 2
    bad = {
        "spot without": preds.filter("barcode = 1"), "prediction without": preds.withColumn("barcode", F.col("barcode") + 1),
        "missing or repeated": preds.filter("NOT (barcode = 1 AND pathway = 'pathway_1')"), "unknown pathway": preds.replace("pathway_1", "other", ["pathway"]),
    }
    for message, rows in bad.items():
        with pytest.raises(Exception, match=message):
            align.injected_table(obs, rows, align.default_names(2)).collect()
    with pytest.raises(Exception, match="missing or repeated"):
        align.injected_table(obs, preds.union(preds.limit(1)), align.default_names(2)).collect()
    with pytest.raises(Exception, match="missing or repeated"):
        align.injected_table(obs, preds, align.default_names(3)).collect()


def test_nothing_is_lost_without_weights_or_factors(spark):
    spots = spark.createDataFrame([(0, 1, 2.0, 4.0), (1, 1, 2.0, 4.0)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    weights = spark.createDataFrame([(0, "p", 0.5)], "sample_id INT, pathway STRING, morans_i DOUBLE")
    assert sorted((r.sample_id, r.morans_i) for r in align.attach_weights(spots, weights).collect()) == [(0, 0.5), (1, None)]
    images = spark.createDataFrame([(0, "hires", 10, 10), (1, "hires", 5, 5)], "sample_id INT, image_key STRING, h INT, w INT")
    factors = spark.createDataFrame([(0, "tissue_hires_scalef", 1234.5)], "sample_id INT, key STRING, value DOUBLE")
    chosen = expression.choose_image(images, factors)
    assert sorted((r.sample_id, r.scalef) for r in chosen.collect()) == [(0, 1234.5), (1, None)]
    assert sorted((r.sample_id, r.x) for r in coordinates.to_image_space(spots, chosen).collect()) == [(0, 2469.0), (1, None)]
    card = expression.metadata(spots, spots.select("sample_id", F.lit("g").alias("gene")), images, factors).collect()
    assert {r.sample_id: r.scalefactors for r in card} == {0: "tissue_hires_scalef=1234.5000", 1: None}
