"""Run logs: metric tables, summaries, exports and artefact listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.operators.runs import only_runs
from spotlake.session import dealt
from spotlake.sources.tables import exists

METRICS_DDL = "epoch INT, metric STRING, value DOUBLE"
PARTS = 64  # of shared tables; a fixed value, since runs are found again by it


def empty_metrics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"run_name STRING, {METRICS_DDL}")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """(epoch, metric, value, run_name) of tables or logs below ``path``, with a folder per run or not; None if there are none."""
    if not exists(spark, path):
        return None
    reader = spark.read.schema(f"{METRICS_DDL}, run_name STRING")
    rows = reader.option("header", True).csv(path) if path.endswith("log") else reader.parquet(path)
    return rows.select("epoch", "metric", "value", "run_name")


def _all(*tables: DataFrame | None) -> DataFrame | None:
    found = [t for t in tables if t is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def _of_runs(df: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Rows of ``df`` whose run is in ``runs`` ("left_semi") or is not ("left_anti"); a null run is a run."""
    names = runs.select(F.col("run_name").alias("__run")).distinct()
    return df.join(names, F.col("run_name").eqNullSafe(F.col("__run")), how)


def read_run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of all runs below ``root``: Parquet tables, and CSV logs of runs that have no table.

    Layout: ``root/table/run_name=<run>/*.parquet`` and ``root/log/run_name=<run>/*.csv``. A folder and a file for each run take
    more time and driver memory than the rows of short runs, so many runs may share files: ``root/shared_table/part=<n>/*.parquet``
    and ``root/shared_log/*.csv``, with run_name as the last column. A run with a folder of tables has no other tables.
    """
    table, shared = _stored(spark, f"{root}/table"), _stored(spark, f"{root}/shared_table")
    if table is not None and shared is not None:
        shared = _of_runs(shared, table, "left_anti")
    table = _all(table, shared)
    table = empty_metrics(spark) if table is None else table
    log = _all(_stored(spark, f"{root}/log"), _stored(spark, f"{root}/shared_log"))
    if log is None:
        return table.select("run_name", "epoch", "metric", "value")
    missing = log.join(table.select("run_name").distinct(), "run_name", "left_anti")
    return table.unionByName(missing).select("run_name", "epoch", "metric", "value")


def write_shared_log(df: DataFrame, root: str) -> None:
    """Add CSV logs of many runs, in files that they share; names are kept as they are and have no line breaks."""
    rows = df.select("epoch", "metric", "value", "run_name").write.mode("append").option("header", True)
    rows.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{root}/shared_log")


def by_run(df: DataFrame) -> DataFrame:
    """``df`` dealt by run, for writes with a folder per run: a file for each run, not one from every task.

    The number of partitions is given: creating the files takes the time, not the rows, so few bytes are no reason for few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run_name")


def csv_to_table(spark: SparkSession, root: str) -> None:
    """Convert the CSV logs into tables, replacing the tables of the same runs.

    Logs in a folder per run become tables in a folder per run, shared logs become shared tables, but a run that has a folder keeps it.
    """
    log, shared = _stored(spark, f"{root}/log"), _stored(spark, f"{root}/shared_log")
    if log is None and shared is None:
        log = spark.read.csv(f"{root}/log")  # raises that there are no logs
    if shared is not None:
        folders = _all(log, _stored(spark, f"{root}/table"))
        if folders is not None:
            log = _all(log, _of_runs(shared, folders, "left_semi"))
            shared = _of_runs(shared, folders, "left_anti")
        _write_shared(spark, shared, root)
    if log is not None:
        by_run(log).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_name").parquet(f"{root}/table")


def _write_shared(spark: SparkSession, rows: DataFrame, root: str) -> None:
    """Replace the runs of ``rows`` in the shared tables; a run lies in one part, and parts do not depend on how many runs there are."""
    last = _stored(spark, f"{root}/shared_table")
    if last is not None:
        rows = rows.unionByName(_of_runs(last, rows, "left_anti"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("run_name"), F.lit(PARTS)).cast("int"))
    dealt(rows, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{root}/shared_table")


def discover_runs(spark: SparkSession, root: str, explicit: str | None = None, pattern: str = "*") -> DataFrame:
    """Names of the non-hidden folders below ``root`` that hold files, plus one explicit run folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rest = F.substring_index("path", root.rstrip("/") + "/", -1)
    names = files.select(rest.alias("rest")).filter(F.col("rest").contains("/")).select(
        F.substring_index("rest", "/", 1).alias("run_name")).filter(~F.col("run_name").startswith("."))
    if explicit:
        one = spark.range(1).select(F.lit(explicit.rstrip("/").rsplit("/", 1)[-1]).alias("run_name"))
        names = names.unionByName(one)
    return names.distinct().orderBy("run_name")


def export_runs(tables: list[DataFrame], runs: list[str] | None = None) -> DataFrame:
    """Metric tables of several runs as one, run name first; columns a run lacks are NULL."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if runs:
        out = only_runs(out, runs)
    return out.select("run_name", *[c for c in out.columns if c != "run_name"])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def collect_summaries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All run-summary documents below ``path`` as one table, best loss first."""
    docs = spark.read.schema(schema).json(path)
    return docs.orderBy(F.col("best_val_loss").asc_nulls_last(), "run_name")


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, run_name, modificationTime) of image files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("run_name"), "modificationTime")
