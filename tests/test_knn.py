import numpy as np
import pandas as pd
import pytest

from spotlake.operators.knn import knn_edges, neighbour_sequence


def brute(df, k):
    out = set()
    for s, g in df.groupby("sample_id"):
        ids, xy = g.barcode.to_numpy(), g[["x", "y"]].to_numpy()
        for i in range(len(g)):
            d = (xy[i, 0] - xy[:, 0]) ** 2 + (xy[i, 1] - xy[:, 1]) ** 2
            order = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out |= {(int(s), int(ids[i]), int(ids[j]), r + 1) for r, j in enumerate(order)}
    return out


def shapes():
    rng = np.random.default_rng(0)
    line = np.stack([rng.random(120) * 100, np.zeros(120)], 1)
    return {
        "uniform": rng.random((250, 2)) * 1000,
        "dense cluster": np.concatenate([rng.random((100, 2)) * 1000, 500 + rng.random((150, 2)) * 0.01]),
        "one location": np.concatenate([rng.random((100, 2)) * 1000, np.full((120, 2), 7.0)]),
        "lattice with ties": np.array([(i % 8 * 256 + (128 if i // 8 % 2 else 0), i // 8 * 256) for i in range(160)], float),
        "few": np.array([(0, 0), (1, 0), (0, 1)], float),
        "line": line,
        "outliers": np.concatenate([rng.normal(size=(120, 2)), [[1e6, 1e6], [-1e6, 3]]]),
        "duplicates": np.array([(1.0, 1.0)] * 5 + [(2.0, 2.0)] * 3),
        "integer ties": rng.integers(0, 12, (250, 2)).astype(float),
    }


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"sample_id": s, "barcode": rng.permutation(len(xy)) + 100, "x": xy[:, 0], "y": xy[:, 1]})
             for s, xy in enumerate(shapes().values())]
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf).cache()


def edges(df):
    return {(r.sample_id, r.barcode, r.neighbor, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("slide_size", [4096, 100, 0])
def test_exact_on_every_shape(points, slide_size):
    """Whole slides, a mixture, and the leaf join for every slide give the brute-force result."""
    pdf, df = points
    assert edges(knn_edges(df, 6, slide_size=slide_size)) == brute(pdf, 6)


@pytest.mark.parametrize("k", [2, 6])
def test_spots_without_coordinates_neither_ask_nor_answer(spark, k):
    good = [(0, i, float(i * i % 7), float(i)) for i in range(6)] + [(1, i, float(i), 0.5) for i in range(150)]
    bad = [(0, 90, float("nan"), 1.0), (0, 91, None, 1.0), (0, 92, 2.0, float("inf")), (1, 900, float("nan"), float("nan")), (2, 1, None, None)]
    schema = "sample_id INT, barcode INT, x DOUBLE, y DOUBLE"
    want = brute(pd.DataFrame(good, columns=["sample_id", "barcode", "x", "y"]), k)
    for slide_size in (4096, 100, 0):
        assert edges(knn_edges(spark.createDataFrame(good + bad, schema), k, slide_size=slide_size)) == want


def test_cells_are_split_until_they_fit(spark):
    """Clusters inside clusters, each a thousand times smaller: more rounds than any fixed number of them."""
    xy = [(sum(10.0 ** -(3 * d) for d in range(depth)) + j * 10.0 ** -(3 * depth + 1), j * 10.0 ** -(3 * depth)) for depth in range(1, 5) for j in range(40)]
    df = pd.DataFrame([(0, i, x, y) for i, (x, y) in enumerate(xy)], columns=["sample_id", "barcode", "x", "y"])
    assert edges(knn_edges(spark.createDataFrame(df), 3, slide_size=0, leaf_size=8)) == brute(df, 3)


def test_small_leaves(points):
    pdf, df = points
    assert edges(knn_edges(df, 3, slide_size=0, leaf_size=6)) == brute(pdf, 3)


@pytest.mark.parametrize("slide_size", [4096, 0])
def test_query_subset(points, slide_size):
    pdf, df = points
    asked = df.filter("barcode % 3 = 0")
    assert edges(knn_edges(df, 4, asked, slide_size)) == {e for e in brute(pdf, 4) if e[1] % 3 == 0}


def test_string_ids_and_no_self(spark):
    rows = [("a", f"s{i}", float(i), 0.0) for i in range(9)]
    df = spark.createDataFrame(rows, "sample_id STRING, barcode STRING, x DOUBLE, y DOUBLE")
    got = knn_edges(df, 2).collect()
    assert all(r.barcode != r.neighbor for r in got) and len(got) == 18
    assert {r.neighbor for r in got if r.barcode == "s4"} == {"s3", "s5"}


def test_sequence_is_padded_with_the_centre(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 1.0, 0.0)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    rows = sorted((r.barcode, r["rank"], r.neighbor, r.padded) for r in neighbour_sequence(df, 3).collect())
    assert rows[:4] == [(1, 0, 1, False), (1, 1, 2, False), (1, 2, 1, True), (1, 3, 1, True)]
