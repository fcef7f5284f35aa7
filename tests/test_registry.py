import pytest

from spotlake.operators import genesets, registry, splitting

DDL = "sample_id INT, id STRING, organ STRING, disease_state STRING, st_technology STRING, species STRING, preservation_method STRING"


@pytest.fixture(scope="module")
def cli(spark):
    rows = [
        (1, "TENX1", "Breast", "Cancer", "Visium", "Homo sapiens", "FFPE"),
        (2, "TENX2", "Breast", "Healthy", "Visium", "Homo sapiens", "FFPE"),
        (3, "TENX3", "Bowel", "Cancer", "Visium", "Homo sapiens", "Fresh Frozen"),
        (4, "TENX4", "Bowel", "Cancer", "Xenium", "Homo sapiens", "FFPE"),
        (5, "TENX5", "Lung", "Cancer", "Visium", "Mus musculus", "FFPE"),
    ]
    return spark.createDataFrame(rows, DDL).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_selection(cli):
    assert ids(registry.select_samples(cli, organ="bowel")) == ["TENX3", "TENX4"]
    assert ids(registry.select_samples(cli, organ="Bowel", st_technology="Xenium")) == ["TENX4"]
    assert ids(registry.select_samples(cli, organ="Breast", limit=1)) == ["TENX1"]
    assert ids(registry.select_samples(cli, take_all=True, organ="Lung")) == [f"TENX{i}" for i in range(1, 6)]
    assert ids(registry.select_samples(cli, sample="TENX5", organ="Bowel")) == ["TENX5"]
    assert ids(registry.select_samples(cli)) == []
    assert ids(registry.filter_samples(cli, organ="Brain")) == []


def test_options_and_ids(cli):
    got = registry.options(cli)
    assert got.filter("field = 'organ'").count() == 3
    chosen = registry.sample_ids(cli, cli.filter("sample_id > 1"), organ="Colorectal")
    assert sorted(r.sample_id for r in chosen.collect()) == [3, 4]
    nothing_left = registry.sample_ids(cli, cli, organ="Brain", max_samples=2)
    assert [r.sample_id for r in nothing_left.collect()] == [1, 2]


def test_requested_files(spark, cli):
    paths = ["st/TENX1.h5ad", "patches/TENX1.h5", "a/b/TENX1_x.json", "st/TENX10.h5ad", "st/TENX2.h5ad", "meta/info.csv"]
    files = spark.createDataFrame([(p,) for p in paths], "path STRING")
    got = registry.requested_files(cli.filter("id = 'TENX1'"), files, ("%.csv",))
    assert sorted(r.path for r in got.collect()) == ["a/b/TENX1_x.json", "meta/info.csv", "patches/TENX1.h5", "st/TENX1.h5ad"]


def test_patient_split(spark):
    rows = [("S1", "P1"), ("S2", "P1"), ("S3", "P2"), ("S4", "P2"), ("S5", "P3"), ("S6", None)]
    df = spark.createDataFrame(rows, "id STRING, patient STRING")
    split = splitting.patient_split(df, 0.25)
    got = {r.id: r.split for r in split.collect()}
    assert len(got) == 6 and got["S1"] == got["S2"] and got["S3"] == got["S4"]
    assert len({r.patient_group for r in split.filter("split = 'val'").collect()}) == 1
    assert splitting.leaking_patients(split).count() == 0
    again = {r.id: r.split for r in splitting.patient_split(df.repartition(3), 0.25).collect()}
    assert again == got
    alone = spark.createDataFrame([("S1", None), ("S2", None), ("S3", None)], "id STRING, patient STRING")
    sizes = {r.split: r.n for r in splitting.split_counts(splitting.patient_split(alone, 0.34)).collect()}
    assert sizes == {"train": 1, "val": 2}
    three = {r.split for r in splitting.patient_split(df, 0.5, 0.25).collect()}
    assert three == {"train", "val", "test"}


def test_random_split(spark):
    df = spark.range(10).withColumnRenamed("id", "id")
    sizes = {r.split: r.n for r in splitting.split_counts(splitting.random_split(df, 0.2)).collect()}
    assert sizes == {"train": 8, "val": 2}
    one = splitting.random_split(spark.range(1), 0.2)
    assert sorted(r.split for r in one.collect()) == ["train", "val"]


def test_collections(spark):
    rows = [("a", 0, "P", "g1"), ("a", 0, "P", "g2"), ("b", 1, "P", "g3"), ("b", 1, "Q", "g1")]
    gs = spark.createDataFrame(rows, "collection STRING, pos INT, pathway STRING, gene STRING")
    first = {(r.pathway, r.gene) for r in genesets.merge_first(gs).collect()}
    last = {(r.pathway, r.gene) for r in genesets.merge_last(gs).collect()}
    assert first == {("P", "g1"), ("P", "g2"), ("Q", "g1")} and last == {("P", "g3"), ("Q", "g1")}
    with pytest.raises(ValueError):
        genesets.named_sets(gs, spark.createDataFrame([("nope",)], "pathway STRING"))
    lists = spark.createDataFrame([(0, "x"), (0, "y"), (1, "y")], "sample_id INT, gene STRING")
    assert [r.gene for r in genesets.in_all(lists).collect()] == ["y"]
