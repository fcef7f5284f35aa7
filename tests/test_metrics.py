import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotlake.operators import metrics


@pytest.fixture(scope="module")
def loss2d(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=(32, 5))
    pdf = pd.DataFrame([(0, i, f"p{j}", t[i, j] * 0.5 + rng.normal(), t[i, j]) for i in range(32) for j in range(5)],
                       columns=["sample_id", "barcode", "pathway", "pred", "target"])
    return pdf, spark.createDataFrame(pdf).cache()


def one(df):
    return df.first()[0]


def test_pcc_identities(loss2d):
    _, df = loss2d
    t = F.col("target")
    assert one(metrics.pcc_loss(df.withColumn("pred", t))) == pytest.approx(0, abs=1e-6)
    assert one(metrics.pcc_loss(df.withColumn("pred", -t))) == pytest.approx(2, abs=1e-6)
    base = one(metrics.pcc_loss(df))
    assert one(metrics.pcc_loss(df.withColumn("pred", F.col("pred") * 7 + 3))) == pytest.approx(base, abs=1e-6)
    assert one(metrics.pcc_loss(df.withColumn("pred", F.lit(2.0)))) == pytest.approx(1, abs=1e-9)


def test_one_row_per_slide_correlates_across_slides(loss2d):
    pdf, df = loss2d
    each = df.withColumn("sample_id", F.col("barcode"))
    want = 1 - np.mean([np.corrcoef(g.pred, g.target)[0, 1] for _, g in pdf.groupby("pathway")])
    assert one(metrics.pcc_loss(each)) == pytest.approx(want, abs=1e-6)
    assert one(metrics.pcc_loss(each.filter("barcode = 3"))) == 0


def test_weights(loss2d, spark):
    pdf, df = loss2d
    plain = one(metrics.masked_mse(df))
    assert plain == pytest.approx(((pdf.pred - pdf.target) ** 2).mean())
    flat = spark.createDataFrame([(f"p{i}", 2.0) for i in range(5)], "pathway STRING, weight DOUBLE")
    assert one(metrics.weighted_mse(df, flat)) == pytest.approx(plain)
    only = flat.withColumn("weight", F.when(F.col("pathway") == "p1", 1.0).otherwise(0.0))
    sub = pdf[pdf.pathway == "p1"]
    assert one(metrics.weighted_mse(df, only)) == pytest.approx(((sub.pred - sub.target) ** 2).mean())
    assert one(metrics.weighted_mse(df, flat.withColumn("weight", F.lit(0.0)))) is None
    a, b = (metrics.composite_loss(df, x).first() for x in (0.0, 2.0))
    assert a.loss == pytest.approx(plain) and b.loss == pytest.approx(plain + 2 * b.pcc_loss)


def test_padding_is_ignored(loss2d):
    _, df = loss2d
    padded = df.withColumn("mask", F.lit(False)).unionByName(
        df.withColumn("mask", F.lit(True)).withColumn("pred", F.lit(1e6)))
    for f in (metrics.masked_mse, metrics.pcc_loss, metrics.mean_absolute_error):
        assert one(f(padded)) == pytest.approx(one(f(df)))


def test_active_pathways_and_variance(loss2d):
    pdf, df = loss2d
    flat = df.withColumn("target", F.when(F.col("pathway") == "p0", 1.0).otherwise(F.col("target")))
    assert sorted(r.pathway for r in metrics.active_pathways(flat).collect()) == ["p1", "p2", "p3", "p4"]
    want = np.mean([g.pred.var(ddof=1) for _, g in pdf.groupby("pathway")])
    assert one(metrics.prediction_variance(df).select("pred_variance")) == pytest.approx(want)
    single = df.filter("barcode = 0")
    assert metrics.prediction_variance(single).count() == 0 and metrics.validation_pcc(single).count() == 0


def test_zscores(loss2d):
    _, df = loss2d
    z = metrics.zscores(df.withColumn("target", F.when(F.col("pathway") == "p0", 4.0).otherwise(F.col("target"))), ["pathway"], "target")
    s = {r.pathway: r for r in z.groupBy("pathway").agg(F.avg("z").alias("m"), F.stddev_pop("z").alias("s")).collect()}
    assert s["p0"].s == 0 and s["p1"].m == pytest.approx(0, abs=1e-9) and s["p1"].s == pytest.approx(1, abs=1e-6)
