"""Queries STR-*: each runs its stream to the end of the input and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotlake.catalog.aggregates import LIMITS
from spotlake.catalog.bindings import Bindings
from spotlake.catalog.registry import query
from spotlake.catalog.windows import EARLY_STOP, losses
from spotlake.operators import runs
from spotlake.session import work_path
from spotlake.streaming import metrics as stream
from spotlake.streaming import samples as sample_stream


def _event_stream(b: Bindings):
    schema = b.t("events").schema
    raw = stream.tail(b.spark, b.sf_dir, schema, name_filter="events.parquet")
    return raw.select(
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_name"), F.dayofmonth("ts").alias("epoch"),
        F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _drain(b: Bindings, df, name: str, mode: str = "append"):
    """Run a stream until the present input is used up; keep the last output per batch folder."""
    root, check = work_path(b.spark, name), work_path(b.spark, f"{name}-check")
    _step(df, root, check, mode)
    return b.spark.read.parquet(root)


def _step(df, root: str, check: str, mode: str) -> None:
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    df.writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(write).trigger(
        availableNow=True).start().awaitTermination()


def _two_arrivals(b: Bindings, df, build, name: str, mode: str):
    """The early epochs arrive first; the stream is stopped, the late ones arrive, and it goes on from its state."""
    path, root, check = (work_path(b.spark, f"{name}-{part}") for part in ("in", "out", "check"))
    for part in (df.filter("epoch <= 12"), df.filter("epoch > 12")):
        part.write.mode("append").parquet(path)
        _step(build(stream.tail(b.spark, path, df.schema)), root, check, mode)
    return b.spark.read.parquet(root)


@query("str_01_live_tail", "SELECT run_name, count(*) AS n, sum(value) AS total FROM b_metrics_long GROUP BY 1", r="total", i="n")
def _(b: Bindings):
    return _drain(b, _event_stream(b), "tail").groupBy("run_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("str_02_stream_upsert", "SELECT run_name, epoch, metric, value FROM d_cells", r="value")
def _(b: Bindings):
    root = work_path(b.spark, "upsert")
    stream.append_batches(_event_stream(b), root, work_path(b.spark, "upsert-check")).awaitTermination()
    return stream.read_latest(b.spark, root)


@query("str_03_live_kpis", """SELECT run_name, epoch, click, view FROM (SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY epoch DESC) AS r FROM d_wide)
 WHERE r = 1""", r="click view")
def _(b: Bindings):
    table = runs.wide(runs.latest_cells(b.metrics_long), ["click", "view", "purchase"])
    out = _two_arrivals(b, table, lambda rows: stream.live_kpis(rows, ["click", "view"]), "kpi", "complete")
    last = out.agg(F.max("batch")).scalar()
    return out.filter(F.col("batch") == last).drop("batch")


@query("str_04_new_samples", """SELECT sample_id, count(*) AS n_rows, sum(score) AS total FROM d_scores JOIN d_enough USING (sample_id) GROUP BY 1""",
       r="total", i="n_rows")
def _(b: Bindings):
    nations = stream.tail(b.spark, b.sf_dir, b.t("nation").schema, name_filter="nation.parquet")
    root = work_path(b.spark, "new-samples")

    def tables(ids):
        return tuple(df.join(ids, "sample_id", "left_semi") for df in (b.obs, b.var, b.expr))

    sample_stream.process_new_samples(
        nations.select(F.col("n_nationkey").alias("sample_id")), tables, b.gene_sets, root,
        work_path(b.spark, "new-samples-check"), LIMITS).awaitTermination()
    return b.spark.read.parquet(f"{root}/activities").groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("score").alias("total"))


@query("str_04_rejected_samples", """SELECT sample_id, CASE WHEN sample_id NOT IN (SELECT sample_id FROM b_obs) THEN 'no data'
 WHEN sample_id NOT IN (SELECT sample_id FROM d_passed) THEN 'no spot passes quality control' ELSE 'too few scorable pathways' END AS reason
 FROM (SELECT n_nationkey AS sample_id FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation) WHERE sample_id NOT IN (SELECT sample_id FROM d_enough)""")
def _(b: Bindings):
    """Every other arriving sample has no spots at all."""
    nations = stream.tail(b.spark, b.sf_dir, b.t("nation").schema, name_filter="nation.parquet")
    key = F.col("n_nationkey")
    root = work_path(b.spark, "rejected-samples")

    def tables(ids):
        return tuple(df.join(ids, "sample_id", "left_semi") for df in (b.obs, b.var, b.expr))

    sample_stream.process_new_samples(
        nations.select(F.explode(F.array(key, key + 100)).alias("sample_id")), tables, b.gene_sets, root,
        work_path(b.spark, "rejected-samples-check"), LIMITS).awaitTermination()
    return sample_stream.read_rejected(b.spark, root).select(F.col("sample_id").cast("bigint").alias("sample_id"), "reason")


@query("str_05_early_stopping", EARLY_STOP)
def _(b: Bindings):
    rows = losses(b)
    path, root, check = (work_path(b.spark, f"stop-{part}") for part in ("in", "out", "check"))
    for part in (rows.filter("epoch <= 12"), rows.filter("epoch > 12")):
        part.write.mode("append").parquet(path)
        stream.early_stopping(stream.tail(b.spark, path, rows.schema), root, check, 3).awaitTermination()
    return stream.stop_state(b.spark, root).select("run_name", "stop_epoch")


@query("str_06_one_row_per_epoch", "SELECT DISTINCT run_name, epoch FROM b_metrics_long")
def _(b: Bindings):
    return _drain(b, stream.one_row_per_epoch(_event_stream(b), "ts", "400 days"), "dedup").select("run_name", "epoch")
