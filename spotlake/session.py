"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int | None = None, app: str = "spotlake") -> SparkSession:
    """A session for tests and benches; on a cluster the submitter sets these values.

    ``shuffle_partitions`` is for small local data; left out, Spark's own value holds.
    """
    builder = SparkSession.builder.master(master).appName(app)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # hash instead of sort where every measured partition of one side is small
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without one gets a fresh temporary folder; a cluster session without one is
    refused, because a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="spotlake-")
    if configured and not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return (configured or context.getCheckpointDir()).rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call gets.

    All paths of an application lie in one folder of its own, which is removed when the application ends.
    """
    home = f"{shared_dir(spark)}/work-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over all shuffle partitions; grouping and joining by these keys needs no other shuffle.

    The number of partitions is given. Left to itself, Spark puts partitions together by their compressed size, and rows of a
    panel that repeats its genes for every slide take many times that size in the memory of a task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
