"""Run-log analytics on the long metric table (run_name, epoch, metric, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.operators.index import position
from spotlake.session import materialise

# Rows of a curve that one task walks over.
PIECE = 100_000
RUN_METRIC = ["run_name", "metric"]


def latest_cells(log: DataFrame) -> DataFrame:
    """Last value per (run, epoch, metric) of an append log with (ts, event_id)."""
    return log.groupBy("run_name", "epoch", "metric").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def upsert(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace whole (run, epoch) rows: metrics that the newer row omits disappear."""
    keys = ["run_name", "epoch"]
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def wide(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row per (run, epoch) with one column per named metric."""
    return metrics.groupBy("run_name", "epoch").pivot("metric", names).agg(F.first("value"))


def only_runs(df: DataFrame, runs: list[str]) -> DataFrame:
    return df.filter(F.col("run_name").isin(*runs))


def moving_average(metrics: DataFrame, window: int, piece: int = PIECE) -> DataFrame:
    """Trailing mean over the last ``window`` logged epochs of each (run, metric); nulls are left out first.

    Curves are cut into pieces of ``piece`` rows that overlap by ``window - 1`` rows.
    """
    if not 1 <= window <= 50:
        raise ValueError("window must be between 1 and 50")
    piece = max(piece, window)
    placed = position(metrics.filter(F.col("value").isNotNull()), RUN_METRIC, [F.col("epoch")], "__pos")
    own = F.floor(F.col("__pos") / piece)
    tail = F.col("__pos") % piece >= piece - (window - 1)
    copies = placed.withColumn("__own", own).withColumn(
        "__piece", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    inside = Window.partitionBy(*RUN_METRIC, "__piece").orderBy("epoch").rowsBetween(-(window - 1), 0)
    return copies.withColumn("smoothed", F.avg("value").over(inside)).filter(
        F.col("__piece") == F.col("__own")).drop("__pos", "__own", "__piece")


def best_so_far(losses: DataFrame, piece: int = PIECE) -> DataFrame:
    """Best earlier loss and whether the epoch is a new best (strictly lower), per run."""
    return _best_so_far(position(losses, ["run_name"], [F.col("epoch")], "__pos"), "__pos", piece).drop("__pos")


def _best_so_far(placed: DataFrame, pos: str, piece: int) -> DataFrame:
    """Runs are cut into pieces: the best earlier loss is the lower of the best inside the piece and before it."""

    def earlier(order: str, *keys: str):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    cut = placed.withColumn("__piece", F.floor(F.col(pos) / piece))
    pieces = cut.groupBy("run_name", "__piece").agg(F.min("val_loss").alias("__m"))
    pieces = pieces.select("run_name", "__piece", F.min("__m").over(earlier("__piece", "run_name")).alias("__prev"))
    out = cut.withColumn("__in", F.min("val_loss").over(earlier(pos, "run_name", "__piece"))).join(
        pieces, ["run_name", "__piece"]).withColumn("best_before", F.least("__in", "__prev")).drop("__piece", "__in", "__prev")
    return out.withColumn(
        "is_best", F.col("val_loss").isNotNull() & (F.col("best_before").isNull() | (F.col("val_loss") < F.col("best_before"))))


def early_stop(losses: DataFrame, patience: int = 15, min_delta: float = 0.0, piece: int = PIECE) -> DataFrame:
    """Epoch at which patience ends, per run (run_name, stop_epoch, best_loss); NULL when the run is never stopped."""
    return continued_stop(losses, None, patience, min_delta, piece).select("run_name", "stop_epoch", "best_loss")


def continued_stop(losses: DataFrame, state: DataFrame | None, patience: int = 15, min_delta: float = 0.0, piece: int = PIECE) -> DataFrame:
    """(run_name, stop_epoch, best_loss, wait): early stopping over ``losses`` (run_name, epoch, val_loss), per run.

    ``state`` (run_name, best, wait) says what was accepted last and how many epochs ago; runs without a row there begin.
    ``wait`` of the result is the number of epochs since the last accepted loss; a null loss is an epoch without one.

    ``min_delta`` makes the best value depend on the path: after an accepted loss the next one is the first that lies
    lower by more than that, and the run stops if it comes after ``patience`` epochs or never. Only records, losses below
    all earlier ones, can be accepted, and they fall, so the next one is found by an ordered search among the records of
    the next ``patience`` epochs. A run is cut into pieces; for each record of a piece the fold is followed to the
    piece's end: it stops there, or enters the next piece at some record. Neighbouring pieces are then put together
    two by two. An entered block is entered in its first piece, so half of the rows go in each round.
    """
    piece = max(piece, patience)
    placed = materialise(position(losses.select("run_name", "epoch", "val_loss"), ["run_name"], [F.col("epoch"), F.col("val_loss")], "pos"))
    records = _best_so_far(placed, "pos", piece).filter("is_best").select("run_name", "pos", "val_loss")
    own = F.floor(F.col("pos") / piece)
    seen = F.when((own > 0) & (F.col("pos") % piece < patience), F.array(own, own - 1)).otherwise(F.array(own))
    kind = records.schema["run_name"].dataType.simpleString()

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        pos, loss = rows.column("pos").to_numpy(), rows.column("val_loss").to_numpy()
        number = rows.column("piece")[0].as_py()
        own = int(np.searchsorted(pos, (number + 1) * piece))
        after = np.searchsorted(-loss, -(loss[:own] - min_delta), side="right")
        ahead = after < len(pos)
        ahead[ahead] = pos[after[ahead]] <= pos[:own][ahead] + patience
        last, leads = np.arange(own), np.full(own, -1)
        for i in range(own - 1, -1, -1):
            if ahead[i]:
                n = after[i]
                last[i], leads[i] = (last[n], leads[n]) if n < own else (i, pos[n])
        return pa.table({"run_name": rows.column("run_name")[:own], "piece": np.full(own, number), "pos": pos[:own], "loss": loss[:own],
                         "at": pos[last], "best_loss": loss[last], "into": pa.array(leads, mask=leads < 0)})

    ways = materialise(records.withColumn("piece", F.explode(seen)).groupBy("run_name", "piece").applyInArrow(
        follow, f"run_name {kind}, piece bigint, pos bigint, loss double, at bigint, best_loss double, into bigint"))
    runs = placed.groupBy("run_name").agg(F.count(F.lit(1)).alias("n"))
    begin = F.lit(None).cast("double").alias("best"), F.lit(0).cast("bigint").alias("wait")
    if state is None:
        runs = runs.select("*", *begin)
    else:
        runs = runs.join(state.select("run_name", "best", F.col("wait").cast("bigint").alias("wait")), "run_name", "left").na.fill({"wait": 0})
    # The first record that is low enough; it counts if it comes in time, and then lies in the first piece.
    limit = F.coalesce(F.col("best"), F.lit(float("inf"))) - min_delta
    entry = ways.join(runs, "run_name").where(F.col("loss") < limit).groupBy("run_name").agg(F.min("pos").alias("entry"))
    since = -1 - F.col("wait")
    runs = materialise(runs.join(entry, "run_name", "left").withColumn("entry", F.when(F.col("entry") <= since + patience, F.col("entry"))))
    ways = ways.join(runs.where("entry IS NOT NULL").select("run_name", "entry"), "run_name")
    ways = materialise(ways.where("piece > 0 OR pos = entry").drop("entry", "loss"))
    span = 1
    while span <= (ways.agg(F.max("piece")).first()[0] or 0):
        left, right = ways.where(F.col("piece") % (2 * span) == 0), ways.where(F.col("piece") % (2 * span) == span)
        onward = right.select("run_name", F.col("pos").alias("into"), *[F.col(c).alias(f"r_{c}") for c in ("at", "best_loss", "into")])
        both = left.join(onward, ["run_name", "into"], "left")
        moved = F.col("r_at").isNotNull()
        ways = materialise(both.select("run_name", "piece", "pos", *[
            F.when(moved, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c) for c in ("at", "best_loss", "into")]))
        span *= 2
    folded = runs.join(ways.select("run_name", F.col("pos").alias("entry"), "at", "best_loss"), ["run_name", "entry"], "left")
    # Without a loss that is accepted in time the wait goes on from the state.
    folded = folded.select("run_name", "n", F.coalesce("at", since).alias("at"), F.coalesce("best_loss", "best").alias("best_loss"))
    stops = folded.withColumn("pos", F.col("at") + patience)
    epochs = placed.select("run_name", "pos", F.col("epoch").cast("int").alias("stop_epoch"))
    return stops.join(epochs, ["run_name", "pos"], "left").select("run_name", "stop_epoch", "best_loss", (F.col("n") - 1 - F.col("at")).alias("wait"))


def elapsed_fields(metrics: DataFrame) -> DataFrame:
    """(run_name, runtime_seconds, epochs_completed) from the time stamps of a run's metrics."""
    micros = [f(F.unix_micros(F.col("ts").cast("timestamp"))) for f in (F.max, F.min)]
    cells = metrics.groupBy("run_name", "epoch").agg(micros[0].alias("hi"), micros[1].alias("lo"))
    return cells.groupBy("run_name").agg(
        F.round((F.max("hi") - F.min("lo")) / 1000000.0, 1).alias("runtime_seconds"), F.count(F.lit(1)).alias("epochs_completed"))


def run_summary(table: DataFrame, loss: str = "val_loss") -> DataFrame:
    """Best loss and its epoch, epochs completed and the last row, from a wide (run, epoch, ...) table."""
    rest = [c for c in table.columns if c != "run_name"]
    return table.groupBy("run_name").agg(
        F.min(loss).alias("best_loss"),
        F.min_by("epoch", F.when(F.col(loss).isNotNull(), F.struct(loss, "epoch"))).alias("best_epoch"),
        F.count(F.lit(1)).alias("epochs_completed"),
        F.max_by(F.struct(*rest), "epoch").alias("last"))


def last_rows(table: DataFrame, columns: list[str]) -> DataFrame:
    """KPI cards: the last epoch of each run."""
    return table.groupBy("run_name").agg(F.max_by(F.struct("epoch", *columns), "epoch").alias("r")).select(
        "run_name", "r.*")


def summary_json(summary: DataFrame, config: DataFrame, timestamp: Column) -> DataFrame:
    """One JSON document per run; ``config`` has (run_name, config struct, runtime_seconds)."""
    return summary.join(config, "run_name").select("run_name", F.to_json(F.struct(
        timestamp.alias("timestamp"), F.round("runtime_seconds", 1).alias("runtime_seconds"), "epochs_completed",
        F.round("best_loss", 6).alias("best_val_loss"), "config", F.col("last").alias("final_epoch"))).alias("doc"))


def log_rounded(table: DataFrame, digits: dict[str, int]) -> DataFrame:
    return table.withColumns({c: F.round(c, d) for c, d in digits.items()})


def parse_artifacts(files: DataFrame) -> DataFrame:
    """(run_name, sample, epoch, mtime) of ``SAMPLE_epoch_N.png`` files; other names are dropped."""
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.split(F.replace(F.col("filename"), F.lit(".png"), F.lit("")), "_epoch_")
    return (
        files.withColumn("filename", name).filter(F.col("filename").endswith(".png"))
        .withColumn("p", parts).filter(F.size("p") == 2)
        .withColumn("epoch", F.expr("try_cast(p[1] AS INT)")).filter(F.col("epoch").isNotNull())
        .select("run_name", "filename", F.col("p")[0].alias("sample"), "epoch", F.col("modificationTime").alias("mtime")))


def sort_artifacts(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy(F.col("epoch").desc(), F.col("run_name").desc())


def artifact_options(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("sample", "epoch").distinct().orderBy("sample", "epoch")
