import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.functions.coords import dihedral
from spotlake.operators import inference, pooling, splitting


def test_pixels_and_points_move_alike(spark):
    points = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1)]
    df = spark.createDataFrame([(x, y) for x, y in points], "x INT, y INT").select(
        "x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("op"))
    dx, dy = dihedral(F.col("x"), F.col("y"), F.col("op"))
    for r in df.select("x", "y", "op", dx.alias("dx"), dy.alias("dy")).collect():
        img = np.zeros((1, 3, 3))
        img[0, r.y + 1, r.x + 1] = 1
        assert inference.turn(img, r.op)[0, r.dy + 1, r.dx + 1] == 1, (r.op, r.x, r.y)


def test_preprocess_normalises():
    img = np.full((2, 2, 3), 255, dtype=np.uint8)
    out = inference.preprocess(img)
    assert out.shape == (3, 2, 2) and out[0, 0, 0] == pytest.approx((1 - 0.485) / 0.229)


@pytest.fixture(scope="module")
def features(spark):
    rows = [(s, b, float(b), 0.0, [float(b + i + s) for i in range(4)]) for s in (0, 1) for b in range(6)]
    return spark.createDataFrame(rows, "sample_id INT, barcode INT, x DOUBLE, y DOUBLE, features ARRAY<FLOAT>").cache()


def test_scoring_hooks(features):
    model = lambda: (lambda x, xy: np.stack([x.sum(1), xy[:, 0]], axis=1))
    dense = inference.score_spots(features, model, ["sum", "x"], 4)
    got = {(r.sample_id, r.barcode, r.pathway): r.score for r in dense.collect()}
    assert got[1, 2, "sum"] == 18 and got[1, 2, "x"] == 2 and len(got) == 24
    slide = {(r.sample_id, r.pathway): r.score for r in inference.score_slides(dense).collect()}
    assert slide[0, "x"] == 2.5
    with pytest.raises(Exception, match="expected feature vectors of length 5, found 4"):
        inference.score_spots(features, model, ["sum", "x"], 5).collect()
    with pytest.raises(ValueError):
        inference.score_spots(features.drop("x"), model, ["sum", "x"], 4)


def test_whole_slides(features):
    """A dense and a global model that see all spots of a slide at once, in the order of barcodes."""
    centred = inference.score_whole_slides(features.repartition(5), lambda: (lambda x, xy: x[:, :2] - x[:, :2].mean(0) + xy[:1, :1]), ["a", "b"], 4)
    got = {(r.sample_id, r.barcode, r.pathway): r.score for r in centred.collect()}
    assert got == {(s, b, p): b - 2.5 for s in (0, 1) for b in range(6) for p in "ab"}
    for answer in (lambda x, xy: x.sum(0)[None, :1], lambda x, xy: x.sum(0)[:1]):
        slide = inference.score_whole_slides(features, lambda: answer, ["all"], 4, dense=False)  # noqa: B023
        assert {r.sample_id: r.score for r in slide.collect()} == {0: 15, 1: 21}
    one = lambda: (lambda x, xy: x[:, :1])
    with pytest.raises(Exception, match="slide 0 has more than 5 spots: 6|slide 1 has more than 5 spots: 6"):
        inference.score_whole_slides(features, one, ["a"], 4, max_spots=5).collect()
    with pytest.raises(Exception, match="expected scores of shape"):
        inference.score_whole_slides(features, one, ["a"], 4, dense=False).collect()
    with pytest.raises(Exception, match="expected feature vectors of length 5, found 4"):
        inference.score_whole_slides(features, one, ["a"], 5).collect()
    with pytest.raises(ValueError):
        inference.score_whole_slides(features.drop("y"), one, ["a"], 4)


def test_feature_extraction(spark):
    img = bytes(range(12))
    df = spark.createDataFrame([(0, i, 0.0, 0.0, img, 2, 2, 3) for i in range(5)],
                               "sample_id INT, barcode INT, x DOUBLE, y DOUBLE, img BINARY, h INT, w INT, c INT")
    out = inference.extract_features(df, lambda: (lambda b: b.reshape(len(b), -1)), 2).collect()
    moved = inference.extract_features(df.selectExpr("*", "barcode % 8 AS op"), lambda: (lambda b: b.reshape(len(b), -1)), 2).collect()
    for r in moved:
        assert r.features == pytest.approx(inference.preprocess(inference.decode_patches([img], 2, 2, 3)[0], r.barcode % 8).ravel(), abs=1e-5)
    assert len(out) == 5 and out[0].features == pytest.approx(inference.preprocess(inference.decode_patches([img], 2, 2, 3)[0]).ravel(), abs=1e-5)


def test_dropout_never_touches_the_centre(spark, features):
    seq = features.select("sample_id", "barcode", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"), "features")
    out = splitting.neighbour_dropout(seq, 2).collect()
    assert not any(r.dropped for r in out if r["rank"] == 0)
    dropped = [r for r in out if r.dropped]
    assert dropped and all(set(r.features) == {0.0} for r in dropped)
    assert not any(r.dropped for r in splitting.neighbour_dropout(seq, 1).collect())


def test_pooling(features):
    mean = {r.sample_id: r.features for r in pooling.mean_pool(features).collect()}
    assert mean[0] == [2.5, 3.5, 4.5, 5.5]
    flat = features.select("sample_id", "barcode", F.lit(1.0).alias("score"))
    att = {r.sample_id: r.features for r in pooling.attention_pool(features, flat).collect()}
    assert att[1] == pytest.approx([3.5, 4.5, 5.5, 6.5])
