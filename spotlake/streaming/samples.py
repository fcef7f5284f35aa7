"""Process new samples as they arrive, and resume after an interruption."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spotlake.plans.activities import Thresholds, pathway_activities
from spotlake.session import materialise
from spotlake.sources.tables import exists, pending, write_activities


def process_new_samples(
    arrivals: DataFrame, tables: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]],
    gene_sets: DataFrame, root: str, checkpoint: str, t: Thresholds = Thresholds(),
) -> StreamingQuery:
    """``arrivals`` streams (sample_id). ``tables(ids)`` returns obs, var and expr of these samples.

    Finished samples are skipped. A repeated batch rewrites the partitions of its own samples only. The outcome of every
    sample of a batch goes to a version of its own in ``outcomes``, also that of samples without any spot, so that a later
    success retires a rejection (``read_rejected``). Rejected samples are tried again when they arrive again.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _outcomes(spark, root, batch_id)
        finished = None if done is None else done.where("reason IS NULL")
        ids = materialise(pending(batch.select("sample_id").distinct(), finished))
        if ids.isEmpty():
            return
        obs, var, expr = tables(ids)
        result = pathway_activities(obs, var, expr, gene_sets, t)
        # one row per sample, computed once for the attributes and the outcomes
        status = materialise(result.attrs.withColumn("reason", F.lit(None).cast("string")).unionByName(result.rejected, allowMissingColumns=True))
        absent = ids.join(status, "sample_id", "left_anti").select("sample_id", F.lit("no data").alias("reason"))
        attrs = status.where("reason IS NULL").drop("reason")
        if not attrs.isEmpty():
            write_activities(result.scores, result.morans, attrs, root, overwrite=True)
        # the outcome marks a sample as finished, and is written last
        status.select("sample_id", "reason").unionByName(absent).write.mode("overwrite").parquet(f"{root}/outcomes/batch={batch_id}")

    return arrivals.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run).trigger(availableNow=True).start()


def _outcomes(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """(sample_id, reason) with the newest outcome of each sample, of batches before ``before``; None without any batch."""
    if not exists(spark, f"{root}/outcomes"):
        return None
    outcomes = spark.read.parquet(f"{root}/outcomes")
    if before is not None:
        outcomes = outcomes.where(F.col("batch") < before)
    return outcomes.groupBy("sample_id").agg(F.max_by(F.struct("reason"), "batch").alias("outcome")).select("sample_id", "outcome.reason")


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """(sample_id, reason) of the samples whose newest outcome is a rejection."""
    outcomes = _outcomes(spark, root)
    if outcomes is None:
        raise FileNotFoundError(f"no outcomes below {root}")
    return outcomes.where("reason IS NOT NULL")
