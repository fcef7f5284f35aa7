"""The gene panel of all slides is far larger than the files it comes from."""

from pyspark.sql import functions as F

from spotlake.catalog.bindings import Bindings
from spotlake.operators import scoring


def _tables(spark, path):
    spark.createDataFrame([(0,), (4,), (7,), (None,)], "n_nationkey INT").coalesce(1).write.parquet(f"{path}/nation.parquet")
    parts = [(i, "Brand#1", "PROMO" if i % 2 else "SMALL") for i in [*range(1, 41), 40]] + [(None, "Brand#1", "SMALL")]
    spark.createDataFrame(parts, "p_partkey BIGINT, p_brand STRING, p_type STRING").coalesce(1).write.parquet(f"{path}/part.parquet")
    return Bindings(spark, str(path))


def test_panel_is_dealt_out_before_it_multiplies(spark, tmp_path):
    var = _tables(spark, tmp_path).var
    assert var.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = sorted((r.sample_id, r.gene) for r in var.where("gene IS NOT NULL").collect())
    genes = [("MT-" if i % 2 else "G") + str(i) for i in [*range(1, 41), 40]]
    assert got == sorted((s, g) for s in (0, 4, 7) for g in genes if not (s == 4 and g.startswith("MT-")))


def test_panel_counts_its_copies_in_the_size_estimate(spark, tmp_path):
    b = _tables(spark, tmp_path)
    one = b.genes._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert b.var._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 4 * one


def test_sets_meet_genes_without_a_broadcast(spark, tmp_path):
    b = _tables(spark, tmp_path)
    spots = spark.createDataFrame([(0, 1), (0, 2), (7, 3)], "sample_id INT, barcode BIGINT")
    x = spots.withColumn("gene", F.concat(F.lit("G"), (F.col("barcode") * 2).cast("string"))).withColumn("x", F.lit(1.0))
    sizes = scoring.set_sizes(spots, b.var, b.gene_sets)
    packed = scoring.packed_scores(spots, x, b.gene_sets, sizes)
    for df in (sizes, packed):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [gene" in plan and "BroadcastHashJoin [gene" not in plan
