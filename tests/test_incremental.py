import numpy as np
from pyspark.sql import functions as F

from spotlake.plans.activities import Thresholds, pathway_activities
from spotlake.session import work_path
from spotlake.sources import tables
from spotlake.streaming import metrics as stream
from spotlake.streaming.samples import process_new_samples, read_rejected


def test_new_samples_only(spark):
    """Two arrivals: finished samples are skipped, and the sum equals one batch run."""
    rng = np.random.default_rng(4)
    cells = [(s, i, f"g{j}", float(rng.integers(1, 9))) for s in (0, 1) for i in range(9) for j in range(6) if rng.random() < 0.6]
    expr = spark.createDataFrame(cells, "sample_id INT, barcode INT, gene STRING, count DOUBLE")
    obs = spark.createDataFrame([(s, i, float(i % 3), float(i // 3)) for s in (0, 1) for i in range(9)],
                                "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    var = spark.createDataFrame([(s, f"g{j}") for s in (0, 1) for j in range(6)], "sample_id INT, gene STRING")
    sets = spark.createDataFrame([("c", p, f"g{j}") for p, js in (("A", (0, 1, 2)), ("B", (3, 4, 5))) for j in js],
                                 "collection STRING, pathway STRING, gene STRING")
    limits = Thresholds(1, 1, None, 2, 1, 3)
    seen = []

    def of(ids):
        seen.append(sorted(r.sample_id for r in ids.collect()))
        return tuple(df.join(ids, "sample_id", "left_semi") for df in (obs, var, expr))

    src, root, check = (work_path(spark, n) for n in ("arrivals", "results", "arrivals-check"))
    for ids in ([(0,)], [(0,), (1,)]):
        spark.createDataFrame(ids, "sample_id INT").write.mode("append").parquet(src)
        process_new_samples(stream.tail(spark, src, "sample_id INT"), of, sets, root, check, limits).awaitTermination()
    assert seen == [[0], [1]]
    scores, morans = tables.read_activities(spark, root)
    want = pathway_activities(obs, var, expr, sets, limits)

    def rounded(df, value):
        return sorted(tuple(r) for r in df.withColumn(value, F.round(value, 9)).select(*sorted(df.columns)).collect())

    assert rounded(scores, "score") == rounded(want.scores, "score")
    assert rounded(morans, "morans_i") == rounded(want.morans, "morans_i")


def test_a_later_success_retires_a_rejection(spark):
    """Sample 0 comes without spots first, sample 1 stays without any; a third arrival of both changes nothing for 0."""
    obs = spark.createDataFrame([(0, i, float(i), 0.0) for i in range(5)], "sample_id INT, barcode INT, x DOUBLE, y DOUBLE")
    expr = spark.createDataFrame([(0, i, f"g{j}", float(1 + (i * j) % 3)) for i in range(5) for j in range(4)], "sample_id INT, barcode INT, gene STRING, count DOUBLE")
    var = spark.createDataFrame([(0, f"g{j}") for j in range(4)], "sample_id INT, gene STRING")
    sets = spark.createDataFrame([("c", "A", f"g{j}") for j in range(3)], "collection STRING, pathway STRING, gene STRING")
    src, root, check = (work_path(spark, n) for n in ("retry", "retried", "retry-check"))
    rejected = []
    for ready in (False, True, True):
        def of(ids, ready=ready):
            return tuple(df.where(str(ready)).join(ids, "sample_id", "left_semi") for df in (obs, var, expr))

        spark.createDataFrame([(0,), (1,)], "sample_id INT").write.mode("append").parquet(src)
        process_new_samples(stream.tail(spark, src, "sample_id INT"), of, sets, root, check, Thresholds(1, 1, None, 2, 1, 3)).awaitTermination()
        rejected.append(sorted(tuple(r) for r in read_rejected(spark, root).collect()))
    assert rejected == [[(0, "no data"), (1, "no data")], [(1, "no data")], [(1, "no data")]]
    assert tables.read_activities(spark, root)[0].select("sample_id").distinct().collect() == [(0,)]


def test_discovery(spark):
    root = work_path(spark, "files")
    for name in ("A1.h5", "B2.h5"):
        spark.range(1).coalesce(1).write.parquet(f"{root}/{name}")
    found = tables.discover_samples(spark, f"{root}/A1.h5", ".parquet").collect()
    assert len(found) == 1 and found[0].id.startswith("part-")
