import random

import pytest
from pyspark.sql import functions as F

from spotlake.operators.index import position, position_by_number


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = [(g, f"k{random.random():.12f}", random.choice([0.5, 1.0, 2.0]), n) for n, g in enumerate([0] * 2500 + [1] * 40 + [2])]
    return data, spark.createDataFrame(data, "g INT, k STRING, v DOUBLE, n BIGINT").cache()


def test_large_groups_equal_plain_sort(rows):
    data, df = rows
    got = {(r.g, r.k): r.pos for r in position(df, ["g"], [-F.col("v"), F.col("k")], "pos").collect()}
    for g in (0, 1, 2):
        want = [k for _, k, _, _ in sorted((r for r in data if r[0] == g), key=lambda r: (-r[2], r[1]))]
        assert [got[g, k] for k in want] == list(range(len(want)))


def test_without_groups(rows):
    data, df = rows
    found = [(r.n, r.pos) for r in position(df, [], [F.col("k")], "pos").orderBy("pos").collect()]
    assert found == [(r[3], i) for i, r in enumerate(sorted(data, key=lambda r: r[1]))]


def test_null_groups_are_groups(spark):
    df = spark.createDataFrame([(None, 3), (None, 1), (1, 2), (None, 2)], "g INT, n INT")
    got = sorted((r.g or 0, r.n, r.pos) for r in position(df, ["g"], [F.col("n")], "pos").collect())
    assert got == [(0, 1, 0), (0, 2, 1), (0, 3, 2), (1, 2, 0)]


def test_by_number(rows):
    data, df = rows
    got = {r.n: r.pos for r in position_by_number(df, ["g"], "n", "pos", width=100).collect()}
    assert [got[n] for n in range(2500)] == list(range(2500)) and got[2500] == 0 and got[2540] == 0
