import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spotlake.operators import moran, tiles
from spotlake.operators.knn import knn_edges
from spotlake.session import materialise


@pytest.fixture(scope="module")
def slide(spark):
    """Two slides, one dense in a corner, with stacked points and spots without coordinates."""
    draw = random.Random(7)
    spots = [("a", i, draw.choice([draw.random(), 40 * draw.random()]), float(draw.randrange(30))) for i in range(300)]
    spots += [("a", 300, float("nan"), 1.0), ("a", 301, None, 1.0), ("b", 1, 0.0, 0.0)] + [("b", i, 5.0, 5.0) for i in range(2, 20)]
    values = [(s, i, f"g{g}", float(draw.randrange(1, 9))) for s, i, _, _ in spots for g in range(12) if draw.random() < 0.3]
    values.append(("a", 0, "hole", None))
    df = spark.createDataFrame(spots, "sample_id STRING, barcode INT, x DOUBLE, y DOUBLE")
    return df, spark.createDataFrame(values, "sample_id STRING, barcode INT, gene STRING, x DOUBLE"), values


@pytest.mark.parametrize("size", [7, 64, 1024])
def test_edge_sums_do_not_depend_on_the_tiles(slide, size):
    spots, values, rows = slide
    edges = materialise(knn_edges(spots, 4).select("sample_id", "barcode", "neighbor"))
    placed = materialise(tiles.spot_tiles(spots, size))
    assert placed.groupBy("sample_id", "tile").count().agg(F.max("count")).first()[0] <= size and placed.count() == spots.count()
    x = {(s, i, g): v for s, i, g, v in rows if v is not None}
    cross, lagged = {}, {}
    for e in edges.collect():
        for g in {g for s, i, g in x if (s, i) == (e.sample_id, e.neighbor)}:
            far = x[e.sample_id, e.neighbor, g]
            lagged[e.sample_id, g] = lagged.get((e.sample_id, g), 0) + far
            cross[e.sample_id, g] = cross.get((e.sample_id, g), 0) + far * x.get((e.sample_id, e.barcode, g), 0)
    got = {(r.sample_id, r.gene): r for r in tiles.gene_sums(values, tiles.with_halo(placed, edges)).collect()}
    assert {key: (r.cross, r.lagged) for key, r in got.items() if r.lagged} == {key: (cross[key], lagged[key]) for key in lagged}
    for key, r in got.items():
        stored = [v for (s, _, g), v in x.items() if (s, g) == key]
        assert (r.m, r.mean, r.square_sum) == pytest.approx((len(stored), np.mean(stored), np.var(stored) * len(stored)))


def test_edges_in_blocks(monkeypatch):
    """The same sums, whether edges are expanded together or a few at a time."""
    def columns():
        barcode = pa.chunked_array([pa.array([1, 2, 3, 4])])
        neighbors = pa.chunked_array([pa.array([[2, 3], [4], None, []], pa.list_(pa.int64()))])
        genes = pa.chunked_array([pa.array([["a"], ["a", "b"], ["b"], None], pa.list_(pa.string()))])
        return barcode, neighbors, genes, pa.chunked_array([pa.array([[2.0], [3.0, 5.0], [7.0], None], pa.list_(pa.float64()))])

    for block in (1 << 21, 1):
        monkeypatch.setattr(tiles, "TOGETHER", block)
        found = tiles.tile_sums(*columns())
        assert found["gene"].to_pylist() == ["a", "b"] and found["m"].tolist() == [2, 1] and found["mean"].tolist() == [2.5, 5]
        assert (found["cross"].tolist(), found["lagged"].tolist(), found["square_sum"].tolist()) == ([6, 0], [3, 12], [0.5, 0])


def test_counts_of_unknown_spots_are_left_out(spark, slide):
    spots, values, _ = slide
    more = values.unionByName(spark.createDataFrame([("a", 9999, "g1", 50.0)], values.schema))
    var = values.select("sample_id", "gene").distinct()
    a, b = ({(r.sample_id, r.gene): r.morans_i for r in moran.gene_morans(spots, v, var, 4).collect()} for v in (values, more))
    assert a == pytest.approx(b) and a["a", "hole"] == 0 and np.isfinite([*a.values()]).all()
