import numpy as np
import pytest
from pyspark.sql import functions as F

from spotlake.operators import qc, scoring
from spotlake.plans.activities import Thresholds, pathway_activities


@pytest.fixture(scope="module")
def slide(spark):
    """12 spots x 8 genes; spot 11 has no counts, gene g7 never occurs, set A lists g0 twice."""
    rng = np.random.default_rng(2)
    dense = rng.poisson(1.0, (12, 8)).astype(float)
    dense[11] = 0
    dense[:, 7] = 0
    cells = [(0, int(i), f"g{j}", float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    obs = spark.createDataFrame([(0, i, float(i % 4), float(i // 4)) for i in range(12)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    expr = spark.createDataFrame(cells, "sample_id INT, barcode INT, gene STRING, count DOUBLE")
    var = spark.createDataFrame([(0, f"g{j}") for j in range(8)], "sample_id INT, gene STRING")
    sets = {"A": ["g0", "g0", "g1", "g7"], "B": ["g2", "g3", "absent"], "C": ["g4"], "D": ["absent"]}
    gs = spark.createDataFrame([("c", p, g) for p, genes in sets.items() for g in genes], "collection STRING, pathway STRING, gene STRING")
    return dense, sets, obs, expr, var, gs


def dense_scores(dense, sets, min_genes):
    x = np.log1p(dense / np.maximum(dense.sum(1, keepdims=True), 1) * 10000)
    sd = x.std(0)
    z = (x - x.mean(0)) / np.where(sd == 0, 1, sd)
    names = {f"g{j}": j for j in range(dense.shape[1])}
    out = {}
    for p, genes in sets.items():
        cols = [names[g] for g in genes if g in names]
        out[p] = z[:, cols].mean(1) if len(cols) >= min_genes else np.zeros(len(z))
    return out


def test_sparse_scores_equal_dense_definition(slide):
    dense, sets, obs, expr, var, gs = slide
    x = scoring.normalise(qc.passing_counts(expr, None, None, None))
    scores, sizes = scoring.score_pathways(obs, x, var, gs, 2)
    got = {(r.pathway, r.barcode): r.score for r in scores.collect()}
    want = dense_scores(dense, sets, 2)
    assert len(got) == 12 * 4
    for p, v in want.items():
        assert [got[p, i] for i in range(12)] == pytest.approx(list(v), abs=1e-9)
    counts = scoring.scored_counts(sizes).first()
    assert (counts.n_scored, counts.n_unscored) == (2, 2)


def test_qc_thresholds_are_optional_and_zero_spots_stay(slide):
    dense, _, obs, expr, _, _ = slide
    m = {r.barcode: r for r in qc.spot_metrics(obs, expr).collect()}
    assert m[11].umis == 0 and m[11].n_genes == 0 and m[11].mt_frac == 0
    assert qc.passing_spots(obs, expr, None, None, None).count() == 12
    assert qc.passing_spots(obs, expr, 1, None, None).count() == 11


def test_rejected_samples_are_listed(slide):
    _, _, obs, expr, var, gs = slide
    few = pathway_activities(obs, var, expr, gs, Thresholds(1, 1, None, 2, 3), with_morans=False)
    assert few.rejected.first().reason == "too few scorable pathways" and few.scores.count() == 0
    none = pathway_activities(obs, var, expr, gs, Thresholds(1e9, 1, None, 2, 1), with_morans=False)
    assert none.rejected.first().reason == "no spot passes quality control"


def test_plan_is_whole_and_moran_is_clipped(slide):
    _, _, obs, expr, var, gs = slide
    a = pathway_activities(obs, var, expr, gs, Thresholds(None, None, None, 2, 1))
    assert a.scores.count() == 48
    morans = {r.pathway: r.morans_i for r in a.morans.collect()}
    assert set(morans) == {"A", "B", "C", "D"} and min(morans.values()) >= 0 and morans["D"] == 0
    assert a.attrs.first().n_spots_after_qc == 12


def test_last_of_two_symbols_counts(spark):
    var = spark.createDataFrame([(0, "a", 0), (0, "b", 1), (0, "a", 2), (1, "a", 0)], "sample_id INT, gene STRING, pos INT")
    rows = [(0, 1, "a", 0, 1.0), (0, 1, "a", 2, 5.0), (0, 2, "a", 0, 7.0), (0, 2, "b", 1, 2.0), (1, 1, "a", 0, 3.0)]
    expr = spark.createDataFrame(rows, "sample_id INT, barcode INT, gene STRING, pos INT, count DOUBLE")
    kept = scoring.last_symbols(expr, var)
    assert sorted((r.sample_id, r.barcode, r.gene, r["count"]) for r in kept.collect()) == [(0, 1, "a", 5.0), (0, 2, "b", 2.0), (1, 1, "a", 3.0)]
    n = spark.createDataFrame([(0, 1), (1, 1)], "sample_id INT, n_spots BIGINT")
    twice = expr.filter("sample_id = 0 AND barcode = 1").withColumn("x", F.col("count"))
    with pytest.raises(Exception, match="several counts in one spot"):
        scoring.gene_moments(twice, n).collect()
