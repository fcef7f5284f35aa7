"""Writes and positions are dealt out by their keys, whatever the number of bytes."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.errors import AnalysisException

from spotlake.catalog import load
from spotlake.llm.near_copies import SEGMENTS, fetched_pairs
from spotlake.operators.index import position_by_number
from spotlake.operators.knn import knn_edges
from spotlake.session import shared_dir
from spotlake.sources import runs


def test_a_run_is_one_file(spark, tmp_path):
    log = spark.range(400).selectExpr("concat('run_', id % 5) AS run_name", "CAST(id AS INT) AS epoch", "'loss' AS metric", "id * 1.0 AS value")
    log.repartition(4).write.partitionBy("run_name").option("header", True).csv(f"{tmp_path}/log")
    runs.csv_to_table(spark, str(tmp_path))
    for i in range(5):
        assert len([f for f in os.listdir(f"{tmp_path}/table/run_name=run_{i}") if f.endswith(".parquet")]) == 1
    assert runs.read_run_metrics(spark, str(tmp_path)).count() == 400


def test_many_runs_share_files(spark, tmp_path):
    """Files do not follow the number of runs, and the rows are those of the events."""
    spark.range(2000).selectExpr("id AS event_id", "timestamp_seconds(id * 7200) AS ts", "nullif(id % 500, 499) AS user_id", "'view' AS event_type",
                                 "CAST(id AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    found = load()[0]["src_19_csv_to_table"](spark, str(tmp_path)).collect()
    home = f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}"
    newest = max((f for f in os.listdir(home) if f.startswith("convert-")), key=lambda f: os.path.getmtime(f"{home}/{f}"))
    assert sum(len(folders) + len(files) for _, folders, files in os.walk(f"{home}/{newest}")) < 500
    days = {}
    for i in range(2000):
        run = None if i % 500 == 499 else f"run_{i % 500}"
        day = (datetime(1970, 1, 1) + timedelta(seconds=7200 * i)).day
        days[run, day] = float(i)  # later events win
    want = {}
    for (run, _), v in days.items():
        n, total = want.get(run, (0, 0.0))
        want[run] = (n + 1, total + v)
    assert {r.run_name: (r.n, r.total) for r in found if r.run_name} == {k: v for k, v in want.items() if k}


def test_shared_runs_are_replaced(spark, tmp_path):
    root, ddl = str(tmp_path), "run_name STRING, epoch INT, metric STRING, value DOUBLE"

    def log(runs_, value, shared=True, at=root):
        df = spark.createDataFrame([(r, e, "loss", value) for r in runs_ for e in range(2)], ddl)
        if shared:
            runs.write_shared_log(df, at)
        else:
            df.write.partitionBy("run_name").option("header", True).csv(f"{at}/log")

    def move(name, to):
        os.rename(f"{root}/{name}", f"{root}/{to}")

    def read():
        rows = runs.read_run_metrics(spark, root).collect()
        assert len(rows) == 2 * len({r.run_name for r in rows})
        return {r.run_name: r.value for r in rows}

    log([" a, \"b\" ", "c", "d"], 1.0)
    assert read() == {" a, \"b\" ": 1.0, "c": 1.0, "d": 1.0}  # logs alone
    runs.csv_to_table(spark, root)
    move("shared_log", "old_1")
    log(["c", "e"], 2.0)
    runs.csv_to_table(spark, root)
    move("shared_log", "old_2")
    assert read() == {" a, \"b\" ": 1.0, "c": 2.0, "d": 1.0, "e": 2.0}
    log(["d", "f"], 3.0, shared=False)
    runs.csv_to_table(spark, root)  # d gets a folder, which counts
    move("log", "old_3")
    assert read() == {" a, \"b\" ": 1.0, "c": 2.0, "d": 3.0, "e": 2.0, "f": 3.0}
    log(["f", "c"], 4.0)
    runs.csv_to_table(spark, root)  # f keeps its folder
    move("shared_log", "old_4")
    assert read() == {" a, \"b\" ": 1.0, "c": 4.0, "d": 3.0, "e": 2.0, "f": 4.0}
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        runs.csv_to_table(spark, f"{root}/nowhere")


def test_positions_use_all_partitions(spark):
    df = spark.range(3000).selectExpr("CAST(id % 40 AS INT) AS g", "id AS k")
    placed = position_by_number(df, ["g"], "k", "pos", width=500)
    assert placed.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert placed.where("pos <> (k - g) / 40").count() == 0


def test_many_neighbours_from_larger_leaves(spark):
    points = spark.range(900).selectExpr("0 AS sample_id", "id AS barcode", "CAST(id % 30 AS DOUBLE) AS x", "CAST(floor(id / 30) AS DOUBLE) AS y")
    def order(df):
        return sorted(map(tuple, df.select("barcode", "neighbor", "d2", "rank").collect()))
    assert order(knn_edges(points, 40, slide_size=0)) == order(knn_edges(points, 40))


def test_texts_under_a_full_value_join_the_crowd(spark):
    """Eight texts hold one value; nobody is near any other by the first word, yet they must be compared exactly."""
    def lanes(n):
        return [(0x5555555555555555 if n % 2 else -0x5555555555555556) ^ (n * 0x0F0F0F)] * 8
    rows = [(n, lanes(n), [(0 << 22) | 77, *[(s << 22) | (n * 4099 + s * 7) % (1 << 22) for s in range(1, SEGMENTS)]]) for n in range(8)]
    rows.append((99, lanes(3), [(s << 22) | ((1 << 21) + 5000 * s + 3) for s in range(SEGMENTS)]))
    texts = spark.createDataFrame(rows, "n BIGINT, lanes ARRAY<BIGINT>, segments ARRAY<BIGINT>")
    _, joined = fetched_pairs(texts, spark.createDataFrame([(0,)], "n BIGINT"), 3)
    assert {r.n for r in joined.collect()} == set(range(1, 8))
