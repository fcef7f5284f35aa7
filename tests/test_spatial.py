import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import coordinates, moran
from spotlake.operators.knn import knn_edges


@pytest.mark.parametrize("value, k, low, high", [
    ("if(x < 5, 10.0D, 0.0D)", 6, 0.5, 1.0),
    ("(x + y) % 2", 4, -1.0, -0.3),
    ("x", 6, 0.3, 1.0),
    ("5.0D", 6, 0.0, 0.0),
])
def test_known_patterns(grid10, value, k, low, high):
    got = moran.value_morans(grid10.withColumn("v", F.expr(value)), "v", k).first().morans_i
    assert low <= got <= high


def test_pathways_are_clipped_and_ordered(grid10):
    three = F.array(
        F.struct(F.lit("gradient").alias("pathway"), F.col("x").alias("score")),
        F.struct(F.lit("noise").alias("pathway"), F.pmod(F.xxhash64("barcode"), F.lit(100)).cast("double").alias("score")),
        F.struct(F.lit("constant").alias("pathway"), F.lit(3.0).alias("score")))
    scores = grid10.select("sample_id", "barcode", F.explode(three).alias("e")).select("sample_id", "barcode", "e.*")
    got = {r.pathway: r.morans_i for r in moran.pathway_morans(grid10, scores).collect()}
    assert got["gradient"] > 0.5 and 0 <= got["noise"] < 0.3 and got["constant"] == 0


def test_too_few_spots_give_zero(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0), (0, 2, 1.0, 0.0, 2.0), (0, 3, 0.0, 1.0, 5.0)],
                               "sample_id INT, barcode INT, x DOUBLE, y DOUBLE, v DOUBLE")
    assert moran.value_morans(df, "v", 6).first().morans_i == 0


def test_sparse_equals_dense_definition(spark, grid10):
    rng = np.random.default_rng(5)
    dense = rng.poisson(0.4, (100, 6)).astype(float)
    dense[:, 4] = 0
    dense[:, 5] = 7
    cells = [(0, int(i), f"g{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    values = spark.createDataFrame(cells, "sample_id INT, barcode BIGINT, gene STRING, x DOUBLE")
    var = spark.createDataFrame([(0, f"g{j}") for j in range(6)], "sample_id INT, gene STRING")
    got = {r.gene: r.morans_i for r in moran.gene_morans(grid10, values, var, 6).collect()}
    edges = [(r.barcode, r.neighbor) for r in knn_edges(grid10, 6).collect()]
    z = dense - dense.mean(0)
    for j in range(6):
        ss = (z[:, j] ** 2).sum()
        want = 0 if ss < 1e-12 else sum(z[a, j] * z[b, j] for a, b in edges) / 6 / ss
        assert got[f"g{j}"] == pytest.approx(want, abs=1e-12)


def test_coherence_of_identical_predictions(spark, grid10):
    x, y = F.col("x"), F.col("y")
    values = [x, (x + y) % 3, y * y, F.pmod(F.xxhash64("barcode"), F.lit(50))]
    rows = F.array(*[F.struct(F.lit(f"p{i}").alias("pathway"), v.cast("double").alias("target")) for i, v in enumerate(values)])
    preds = grid10.select("sample_id", "barcode", F.explode(rows).alias("e")).select(
        "sample_id", "barcode", "e.pathway", "e.target", F.col("e.target").alias("pred"))
    assert moran.spatial_coherence(grid10, preds).first().coherence > 0.99
    flat = preds.withColumn("pred", F.lit(1.0))
    assert moran.spatial_coherence(grid10, flat).first().coherence == 0


@pytest.mark.parametrize("xs, want", [
    ([0, 1.9], [0, 1.9]), ([0, 2.0], [0, 1]), ([0, 0.5, 3.0], [0, 0, 1]), ([0, 0.51, 3.0], [0, 0.51, 3.0]), ([0], [0])])
def test_grid_steps(spark, xs, want):
    df = spark.createDataFrame([(0, i, float(v), 0.0) for i, v in enumerate(xs)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    got = [r.x for r in coordinates.normalise_grid(df).orderBy("barcode").collect()]
    assert got == pytest.approx(want)


def test_gaps_cross_bins(spark):
    xs = [0.0, 10.0, 63.0, 64.0, 700.0, -5.0]
    df = spark.createDataFrame([(0, i, v, 1.0) for i, v in enumerate(xs)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    got = {r.v: r.gap for r in coordinates.coordinate_gaps(df).filter("axis = 'x'").collect()}
    assert got == {-5.0: None, 0.0: 5.0, 10.0: 10.0, 63.0: 53.0, 64.0: 1.0, 700.0: 636.0}
