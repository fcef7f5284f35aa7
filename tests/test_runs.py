import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from spotlake.operators import runs
from spotlake.session import work_path
from spotlake.streaming import metrics as stream

LOG = "run_name STRING, epoch INT, metric STRING, value DOUBLE, ts TIMESTAMP, event_id BIGINT"


def at(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def losses(spark, values, run="a"):
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(values)], "run_name STRING, epoch INT, val_loss DOUBLE")


def test_upsert_replaces_whole_rows(spark):
    old = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 1, "y", 2.0), ("a", 2, "x", 3.0)], "run_name STRING, epoch INT, metric STRING, value DOUBLE")
    new = spark.createDataFrame([("a", 1, "x", 9.0)], old.schema)
    got = sorted((r.epoch, r.metric, r.value) for r in runs.upsert(old, new).collect())
    assert got == [(1, "x", 9.0), (2, "x", 3.0)]


@pytest.mark.parametrize("values, patience, delta, want", [
    ([5, 4, 3, 3, 3, 3], 3, 0.0, 5), ([5, 4, 3, 2, 1], 2, 0.0, None), ([5, 4.95, 4.9, 4.85, 4.4, 4.3], 3, 0.5, 3),
    ([5, 4.9, 4.4, 4.0, 3.9], 3, 0.5, None), ([1, 2, 3, 0.5], 2, 0.0, 2)])
def test_early_stop_fold(spark, values, patience, delta, want):
    assert runs.early_stop(losses(spark, values), patience, delta).first().stop_epoch == want


def test_moving_average_skips_nulls(spark):
    df = spark.createDataFrame([("a", 0, "m", 1.0), ("a", 1, "m", None), ("a", 2, "m", 3.0), ("a", 3, "m", 8.0)],
                               "run_name STRING, epoch INT, metric STRING, value DOUBLE")
    got = [(r.epoch, r.smoothed) for r in runs.moving_average(df, 2).orderBy("epoch").collect()]
    assert got == [(0, 1.0), (2, 2.0), (3, 5.5)]
    with pytest.raises(ValueError):
        runs.moving_average(df, 51)


def test_best_so_far_is_strict(spark):
    got = [r.is_best for r in runs.best_so_far(losses(spark, [3, 3, 2, 2.5])).orderBy("epoch").collect()]
    assert got == [True, False, True, False]


def test_long_runs_in_pieces(spark):
    """Cut into pieces of 7 rows, every result equals the plain window."""
    values = [((i * 37) % 101) / 10 + (5 if i % 9 else 0) for i in range(60)]
    df = losses(spark, values).unionByName(losses(spark, [3.0, 1.0], "b"))
    long = df.select("run_name", F.lit("m").alias("metric"), "epoch", F.col("val_loss").alias("value"))
    for w in (1, 3, 10):
        plain, cut = (sorted((r.run_name, r.epoch, round(r.smoothed, 9)) for r in runs.moving_average(long, w, n).collect())
                      for n in (1000, 7))
        assert plain == cut
    plain, cut = (sorted((r.run_name, r.epoch, r.best_before or -1, r.is_best) for r in runs.best_so_far(df, n).collect())
                  for n in (1000, 7))
    assert plain == cut
    for patience, delta in ((2, 0.0), (5, 0.3), (30, 0.0)):
        wait, best, want = 0, float("inf"), None
        for i, v in enumerate(values):
            best, wait = (v, 0) if v < best - delta else (best, wait + 1)
            if wait >= patience:
                want = i
                break
        for n in (1000, 7):
            got = {r.run_name: r for r in runs.early_stop(df, patience, delta, n).collect()}
            assert (got["a"].stop_epoch, got["b"].stop_epoch) == (want, None) and got["a"].best_loss == best


def test_artifact_names(spark):
    names = ["S1_epoch_3.png", "S1_epoch_x.png", "note.png", "A_epoch_1_epoch_2.png", "S2_epoch_10.png", "S3_epoch_4.txt"]
    df = spark.createDataFrame([(f"runs/r/{n}", "r", at(0)) for n in names], "path STRING, run_name STRING, modificationTime TIMESTAMP")
    got = [(r["sample"], r.epoch) for r in runs.sort_artifacts(runs.parse_artifacts(df)).collect()]
    assert got == [("S2", 10), ("S1", 3)]


def test_run_summary_ignores_missing_losses(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 2.0), ("a", 3, None)], "run_name STRING, epoch INT, val_loss DOUBLE")
    r = runs.run_summary(df).first()
    assert (r.best_loss, r.best_epoch, r.epochs_completed, r["last"].epoch) == (2.0, 2, 3, 3)


def test_stream_upsert_over_two_arrivals(spark):
    src, root, check = (work_path(spark, n) for n in ("in", "out", "check"))
    first = spark.createDataFrame([("a", 1, "x", 1.0, at(1), 1), ("a", 1, "x", 2.0, at(2), 2), ("a", 1, "y", 7.0, at(2), 3),
                                   ("b", 1, "x", 4.0, at(1), 4)], LOG)
    second = spark.createDataFrame([("a", 1, "x", 5.0, at(5), 5), ("a", 2, "x", 6.0, at(6), 6)], LOG)
    for part in (first, second):
        part.write.mode("append").parquet(src)
        stream.append_batches(stream.tail(spark, src, part.schema), root, check).awaitTermination()
    got = sorted((r.run_name, r.epoch, r.metric, r.value) for r in stream.read_latest(spark, root).collect())
    assert got == [("a", 1, "x", 5.0), ("a", 2, "x", 6.0), ("b", 1, "x", 4.0)]
    # nothing new: a restart adds nothing
    stream.append_batches(stream.tail(spark, src, first.schema), root, check).awaitTermination()
    assert stream.read_latest(spark, root).count() == 3


def fold(values, patience, delta):
    """(stop position, best loss) of a list of losses."""
    wait, best = 0, None
    for i, v in enumerate(values):
        best, wait = (v, 0) if v is not None and (best is None or v < best - delta) else (best, wait + 1)
        if wait >= patience:
            return i, best
    return None, best


@pytest.mark.parametrize("piece", [16, 100_000])
def test_early_stop_over_many_pieces(spark, piece):
    """Falling, noisy and late runs, in pieces of 16 rows or whole; every record of a falling run could be accepted."""
    draw = random.Random(piece)
    curves = {"falling": [1000 - i / 7 for i in range(700)], "slow": [1000 - i / 7 + draw.random() for i in range(700)],
              "flat end": [50.0 - i for i in range(40)] + [20.0] * 60, "late": [None] * 9 + [3.0, 2.0], "never": [None] * 4, "nothing": [None] * 30, "one": [1.0]}
    rows = [(name, i, v) for name, values in curves.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run_name STRING, epoch INT, val_loss DOUBLE").repartition(5)
    for patience, delta in ((5, 0.0), (16, 1.0), (12, 2.5)):
        got = {r.run_name: (r.stop_epoch, r.best_loss) for r in runs.early_stop(df, patience, delta, piece).collect()}
        assert got == {name: fold(values, patience, delta) for name, values in curves.items()}


def test_stream_early_stop_equals_the_batch(spark):
    """Three arrivals, the last two with rows that come too late; a fourth start without input changes nothing."""
    src, root, check = (work_path(spark, n) for n in ("es-in", "es-out", "es-check"))
    curves = {"a": [5, 4, 4.5, 4.2, 3.9, 4.1, 4.0, 4.3], "b": [2, 3, 4, 1, 1, 1, 1, 1], "c": [9 - i for i in range(8)], "d": [None, 7, None, 7, 6.9, 7, 6, 8]}
    schema = "run_name STRING, epoch INT, val_loss DOUBLE"

    def rows(lo, hi):
        return [(r, i, None if v is None else float(v)) for r, values in curves.items() for i, v in enumerate(values) if lo <= i < hi]

    late = {3: [("a", 1, 0.0), ("c", 0, -5.0)], 6: [("a", 5, 0.0)]}
    for lo, hi in ((0, 3), (3, 6), (6, 8), (8, 8)):
        part = spark.createDataFrame(rows(lo, hi) + late.get(lo, []), schema)
        if lo < hi:
            part.repartition(2).write.mode("append").parquet(src)
        stream.early_stopping(stream.tail(spark, src, schema), root, check, 3, 0.5).awaitTermination()
    got = {r.run_name: r for r in stream.stop_state(spark, root).collect()}
    want = {r.run_name: r for r in runs.early_stop(spark.createDataFrame(rows(0, 8), schema), 3, 0.5).collect()}
    assert {n: (r.stop_epoch, r.best) for n, r in got.items()} == {n: (r.stop_epoch, r.best_loss) for n, r in want.items()}
    assert {n: (r.stop_epoch, r.best_loss) for n, r in want.items()} == {n: fold(v, 3, 0.5) for n, v in curves.items()}
    assert {n: (r.n_late, r["last"]) for n, r in got.items()} == {"a": (2, 7), "b": (0, 7), "c": (1, 7), "d": (0, 7)}
    assert stream.stop_state(spark, root, 1).where("run_name = 'a'").first().wait == 1
