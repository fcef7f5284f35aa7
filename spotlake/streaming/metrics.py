"""Streaming run logs: live tail, idempotent upserts, live KPI cards, duplicates, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spotlake.operators import runs
from spotlake.session import materialise
from spotlake.sources.tables import exists

ROW = ["run_name", "epoch"]


def tail(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_trigger: int | None = None,
         name_filter: str | None = None) -> DataFrame:
    """Unbounded read of a growing folder; the schema is given, never inferred."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path)


def append_batches(stream: DataFrame, root: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Write each micro-batch to its own folder. A repeated batch overwrites only itself, so a restart
    after a failure never duplicates or loses rows.

    With an ``interval`` such as ``"5 seconds"`` the query keeps polling; without one it ends when the
    present input is used up.
    """
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """Current rows of the batch folders: per (run, epoch) the newest batch replaces the whole row, and
    inside it the last event of each metric counts."""
    log = spark.read.parquet(root)
    newest = log.groupBy(*ROW).agg(F.max("batch").alias("batch"))
    return (
        log.join(newest, [*ROW, "batch"], "left_semi").groupBy(*ROW, "metric")
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))


def live_kpis(stream: DataFrame, columns: list[str]) -> DataFrame:
    """Last epoch per run of a wide metric stream; state is one row per run."""
    return stream.groupBy("run_name").agg(F.max_by(F.struct("epoch", *columns), "epoch").alias("r")).select(
        "run_name", "r.*")


def one_row_per_epoch(stream: DataFrame, time: str = "ts", delay: str = "1 day") -> DataFrame:
    """First arrival per (run, epoch); the watermark only bounds the kept state."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(ROW)


STOP_STATE = "run_name STRING, stop_epoch INT, best DOUBLE, wait BIGINT, last INT, n_late BIGINT"


def early_stopping(stream: DataFrame, root: str, checkpoint: str, patience: int = 15, min_delta: float = 0.0) -> StreamingQuery:
    """Early stopping of each run over the arrivals of ``stream`` (run_name, epoch, val_loss).

    Each arrival goes on from the state that the one before has left, with the same pieces as in a batch
    (``runs.continued_stop``), so an arrival may be as long as a whole log. Its new state, one row for every run seen so
    far, is a version of its own below ``root``: a repeated arrival overwrites only itself. An epoch that comes after a
    later one was seen in an earlier arrival cannot change what was decided: it is left out and counted in ``n_late``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select("run_name", F.col("epoch").cast("int").alias("epoch"), F.col("val_loss").cast("double").alias("val_loss"))
        before = stop_state(batch.sparkSession, root, batch_id)
        held = materialise(rows.join(before.select("run_name", "last", "stop_epoch"), "run_name", "left"))
        late = F.col("last").isNotNull() & (F.col("epoch") <= F.col("last"))
        seen = held.groupBy("run_name").agg(F.max("epoch").alias("newest"), F.count_if(late).alias("late"))
        open_rows = held.where(~late & F.col("stop_epoch").isNull()).select("run_name", "epoch", "val_loss")
        after = runs.continued_stop(open_rows, before, patience, min_delta).withColumnsRenamed({"stop_epoch": "stops", "wait": "waited"})
        both = before.join(seen, "run_name", "full").join(after, "run_name", "left").select(
            "run_name", F.coalesce("stop_epoch", "stops").alias("stop_epoch"), F.coalesce("best_loss", "best").alias("best"),
            F.coalesce("waited", "wait").alias("wait"), F.greatest("last", "newest").alias("last"),
            (F.coalesce("n_late", F.lit(0)) + F.coalesce("late", F.lit(0))).alias("n_late"))
        both.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step).trigger(availableNow=True).start()


def stop_state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(run_name, stop_epoch, best, wait, last, n_late) after the newest arrival, or after the newest one before ``before``."""
    none = spark.createDataFrame([], STOP_STATE)
    if not exists(spark, root):
        return none
    versions = spark.read.schema(f"{STOP_STATE}, batch BIGINT").parquet(root)
    if before is not None:
        versions = versions.where(F.col("batch") < before)
    newest = versions.agg(F.max("batch")).first()[0]
    return none if newest is None else versions.where(F.col("batch") == newest).drop("batch")
