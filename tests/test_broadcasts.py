"""Tables whose files are much smaller than their rows are dealt out by key: never broadcast, never one large task."""

import re

import pytest
from pyspark.sql import functions as F

from spotlake.catalog import load
from spotlake.catalog.bindings import Bindings
from spotlake.operators import genesets, moran, qc, scoring, tiles


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def b(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    tables = {
        "nation": spark.createDataFrame([(0,), (4,)], "n_nationkey INT"),
        "customer": spark.range(1, 9).selectExpr("id AS c_custkey", "CAST(id % 2 * 4 AS INT) AS c_nationkey"),
        "orders": spark.range(1, 41).selectExpr("id AS o_orderkey", "1 + id % 8 AS o_custkey"),
        "lineitem": spark.range(200).selectExpr(
            "1 + id % 40 AS l_orderkey", "1 + id % 30 AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber", "CAST(1 + id % 5 AS DOUBLE) AS l_quantity"),
        "part": spark.range(1, 31).selectExpr("id AS p_partkey", "concat('Brand#', id % 3) AS p_brand", "if(id % 2 = 0, 'PROMO', 'SMALL') AS p_type"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return Bindings(spark, str(path))


def test_counts_meet_orders_customers_and_genes_without_a_broadcast(b):
    plan = _plan(b.expr)
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 3
    got = {(r.sample_id, r.barcode, r.gene): r["count"] for r in b.expr.collect()}
    want = {}
    for i in range(200):
        part, customer = 1 + i % 30, 1 + (1 + i % 40) % 8
        sample = customer % 2 * 4
        if not (sample == 4 and part % 2):
            key = sample, customer, ("G" if part % 2 else "MT-") + str(part)
            want[key] = want.get(key, 0) + 1 + i % 5
    assert got == want


def test_spots_are_not_broadcast_when_they_are_placed(b):
    assert "Broadcast" not in _plan(b.obs)
    assert sorted((r.sample_id, r.barcode, r.x) for r in b.obs.collect()) == [
        (s, c, 256.0 * i) for s, first in ((0, 2), (4, 1)) for i, c in enumerate(range(first, 9, 2))]


def test_spots_are_not_broadcast_by_quality_control(b):
    counts = qc.passing_counts(b.expr, 5, 1, 1.0)
    for df in (qc.passing_spots(b.obs, b.expr, 5, 1, 1.0), qc.passing_spots_of(b.obs, b.expr, counts, 5, 1, 1.0)):
        assert not re.search(r"BroadcastHashJoin \[(\w+#\d+L?, )*barcode", _plan(df))
        assert df.count() == 8


def _partitions_of_panel(df, *keys) -> bool:
    """Are the (sample, gene) rows dealt by ``keys`` into the given number of partitions?"""
    by = ", ".join(rf"{k}#\d+L?" for k in keys)
    return bool(re.search(rf"Exchange hashpartitioning\({by}, 4\), REPARTITION_BY_NUM", _plan(df)))


def test_panel_rows_keep_their_partitions(spark, b):
    assert _partitions_of_panel(genesets.in_all(b.var), "gene")
    assert _partitions_of_panel(genesets.sample_coverage(b.gene_sets, b.var), "gene")
    assert _partitions_of_panel(scoring.set_sizes(b.obs, b.var, b.gene_sets), "gene")
    assert {r.gene for r in genesets.in_all(b.var).collect()} == {f"MT-{i}" for i in range(2, 31, 2)}
    assert {(r.sample_id, r.n_found, r.n_wanted) for r in genesets.sample_coverage(b.gene_sets, b.var).collect()} == {(0, 30, 30), (4, 15, 30)}


def test_panel_lists_with_repeats_and_nulls(spark):
    lists = spark.createDataFrame([(0, "a"), (0, "a"), (1, "a"), (0, "b"), (None, "a"), (1, None), (0, None), (None, None)], "sample_id INT, gene STRING")
    assert {r.gene for r in genesets.in_all(lists.where("sample_id IS NOT NULL")).collect()} == {"a", None}
    assert {r.gene for r in genesets.in_all(lists).collect()} == {"a", None}


def test_gene_sums_move_the_tiles_once(spark):
    """One shuffle by (sample, gene) for the centre and the sums, no written table between."""
    values = spark.createDataFrame([("a", i, f"g{i % 3}", float(i)) for i in range(1, 9)], "sample_id STRING, barcode INT, gene STRING, x DOUBLE")
    members = spark.createDataFrame([("a", i // 3, i, []) for i in range(1, 9)], "sample_id STRING, tile BIGINT, barcode INT, neighbors ARRAY<INT>")
    sums = tiles.gene_sums(values, members)
    plan = _plan(sums)
    assert "FlatMapGroupsInArrow" in plan and len(re.findall(r"Exchange hashpartitioning\(sample_id#\d+, gene#\d+, 4\), REPARTITION_BY_NUM", plan)) == 1
    got = {r.gene: (r.m, r.mean, r.square_sum) for r in sums.collect()}
    assert got == {"g0": (2, 4.5, pytest.approx(4.5)), "g1": (3, 4.0, pytest.approx(18)), "g2": (3, 5.0, pytest.approx(18))}


def test_vocabulary_reads_the_counts_once(spark, b):
    from spotlake.plans.vocabulary import build_vocabulary

    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    plain = b.expr
    expr = plain.mapInArrow(counted, plain.schema)
    got = build_vocabulary(b.obs, b.var, expr, None, 5, 0.5, 2).orderBy("pos").collect()
    assert seen.value == plain.count() and [r.pos for r in got] == list(range(5))
    want = plain.groupBy("gene").agg(F.sum("count").alias("n")).collect()
    assert {r.gene: r.total_counts for r in got}.items() <= {r.gene: r.n for r in want}.items()
    means = moran.mean_gene_morans(moran.gene_morans(b.obs, plain.withColumnRenamed("count", "x"), b.var, 2)).collect()
    assert {r.gene: pytest.approx(r.morans_i) for r in got} == {r.gene: r.morans_i for r in means if r.gene in {g.gene for g in got}}


@pytest.mark.parametrize("name", [
    "agg_06_scored_pathways", "agg_16_pathway_ranges", "fil_13_min_pathways", "fil_13_rejected_samples", "plan_01_activity_attributes"])
def test_sample_queries_broadcast_slides_only(spark, b, name):
    """Left to file sizes, the plan broadcasts customers, genes and spots; the driver may hold one row for each slide."""
    plan = _plan(load()[0][name](spark, b.sf_dir))
    keys = re.findall(r"BroadcastHashJoin \[(.*?)\], \[", plan)
    assert all(re.fullmatch(r"sample_id#\d+L?", k) for k in keys), keys
    assert plan.count("BroadcastNestedLoopJoin") <= 1  # the panel on every slide
