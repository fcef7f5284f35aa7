import random

import pytest

from spotlake.llm import simhash
from spotlake.llm.components import _components, connected_components
from tests.llm.brute import components, fingerprint, near


def test_fingerprints(tricky_rows):
    for _, text in tricky_rows:
        for k in (3, 5):
            assert simhash.fingerprint(text, k) % (1 << 64) == fingerprint(text, k)


def test_near_duplicates(tricky, tricky_rows):
    out = simhash.near_duplicates(tricky).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=repr) == sorted(near(tricky_rows), key=repr)


def flip(value, bits):
    for b in bits:
        value ^= 1 << b
    return value - (1 << 64) if value >= 1 << 63 else value


@pytest.mark.parametrize("bucket", [0, 3, 64])
def test_links_connect_what_two_bits_connect(spark, bucket):
    """Fingerprints around a few centres, so that buckets fill up; every limit gives the same components."""
    draw = random.Random(bucket + 5)
    centres = [draw.getrandbits(64) for _ in range(4)] + [0, (1 << 64) - 1]
    values = sorted({flip(c, draw.sample(range(64), draw.randrange(5))) for c in centres for _ in range(40)})
    prints = spark.createDataFrame([(v,) for v in values], "fp BIGINT").repartition(3)
    links = simhash.links(prints, bucket)
    if bucket == 64:
        assert all((r.a ^ r.b).bit_count() <= 2 or ((r.a ^ r.b) % (1 << 64)).bit_count() <= 2 for r in links.collect())
    roots = {r.node: r.root for r in connected_components(links).collect()}
    want = components(values, lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 2)
    got = [roots.get(v, v) for v in values]
    assert [values[w] for w in want] == got


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (7, 6), (7, 6), (-4, 70)]
    out = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert {out[i] for i in range(61)} == {0} and {out[100 + i] for i in range(30)} == {100} and out[70] == -4


@pytest.mark.parametrize("numbers", [range(4096), [x for i in range(2048) for x in (i, 4095 - i)]])
def test_paths_take_few_rounds(spark, numbers):
    """A path in rising order and one that goes to and fro."""
    numbers = list(numbers)
    found, rounds = _components(spark.createDataFrame(list(zip(numbers, numbers[1:], strict=False)), "a BIGINT, b BIGINT").coalesce(4))
    assert [tuple(r) for r in found.groupBy("root").count().collect()] == [(0, 4096)] and rounds <= 14


def test_drop_near_duplicates(tricky, tricky_rows):
    out = simhash.drop_near_duplicates(tricky)
    assert out.columns == tricky.columns
    kept = sorted((r.doc_id for r in out.collect()), key=repr)
    groups = {c for _, _, c in near(tricky_rows, 5)}
    assert kept == sorted(groups, key=repr)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.drop_near_duplicates(empty).collect() == []
