import math

import pytest

from spotlake.operators import pooling

SPOTS = [(0, 1, [1.0, 2.0, 2.0]), (0, 2, [0.0, 0.0, 0.0]), (0, 3, None), (0, 4, [1.0, None, 2.0]), (1, 1, [3.0, 4.0]),
         (1, 2, []), (1, 3, [float("nan"), 1.0, 1.0]), (None, 4, [-1.0, 0.5, 2.0]), *[(2, i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)]]
PATHS = [("b", [1.0, 2.0, 2.0]), ("a", [2.0, 4.0, 4.0]), ("c", [1.0, 0.0]), ("d", None), (None, [0.0, 1.0, 0.0]), ("b", [5.0, 1.0, 1.0]), ("e", []),
         *[(f"p{i:02}", [1.0, float(i), 2.0]) for i in range(12)]]


@pytest.fixture(scope="module")
def features(spark):
    return spark.createDataFrame(SPOTS, "sample_id INT, barcode BIGINT, features ARRAY<FLOAT>")


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(PATHS, "pathway STRING, vector ARRAY<FLOAT>")


def brute(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    norm = [max(math.sqrt(sum(x * x for x in v)), 1e-12) if not any(map(math.isnan, v)) else math.nan for v in (a, b)]
    return sum(x * y for x, y in zip(a, b, strict=True)) / norm[0] / norm[1]


def shown(rows):
    return sorted((repr(tuple(None if v is None else round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows))


@pytest.mark.parametrize("blocks", [(5, 3), (1000, 1000), (1, 1)])
def test_similarity_in_blocks(features, vectors, blocks):
    out = pooling.pathway_similarity(features, vectors, *blocks).collect()
    assert shown(out) == shown((s, n, p, brute(a, v)) for s, n, a in SPOTS for p, v in PATHS)


@pytest.mark.parametrize("blocks", [(5, 3), (1000, 1000)])
def test_most_similar(features, vectors, blocks):
    want = []
    for s, n, a in SPOTS:
        found = [(round(brute(a, v), 12), p) for p, v in PATHS if brute(a, v) is not None and not math.isnan(brute(a, v))]
        found.sort(key=lambda f: (-f[0], f[1] is not None, f[1] or ""))
        want += [(s, n, p, c, rank) for rank, (c, p) in enumerate(found[:4], 1)]
    assert shown(pooling.most_similar(features, vectors, 4, *blocks).collect()) == shown(want)


def test_empty_sides(features, vectors):
    assert pooling.pathway_similarity(features, vectors.limit(0)).collect() == []
    assert pooling.pathway_similarity(features.limit(0), vectors).collect() == []
    assert pooling.most_similar(features, vectors.limit(0), 3).collect() == []


def test_pooled_vectors_have_no_barcode(features, vectors):
    out = pooling.pathway_similarity(features.drop("barcode").where("sample_id = 2"), vectors)
    assert out.columns == ["sample_id", "pathway", "similarity"]
    assert out.count() == 40 * len(PATHS)
