"""Readers and writers of the canonical tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake import schemas


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Sample registry CSV with a fixed schema; no inference pass over the file."""
    return spark.read.schema(schemas.REGISTRY_CSV).option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return schemas.validate(df, kind) if kind else df


def write_by_sample(df: DataFrame, path: str, codec: str = "zstd", overwrite: bool = False) -> None:
    """Parquet partitioned by sample. With ``overwrite`` only the samples in ``df`` are replaced."""
    out = df.write.partitionBy("sample_id").option("compression", codec)
    if overwrite:
        out = out.option("partitionOverwriteMode", "dynamic")
    out.mode("overwrite" if overwrite else "append").parquet(path)


def write_activities(
    scores: DataFrame, morans: DataFrame | None, attrs: DataFrame, root: str, overwrite: bool = False
) -> None:
    """Scores, optional Moran weights and QC attributes as three gzip Parquet tables."""
    for name, df in (("activities", scores), ("pathway_morans", morans), ("qc_attrs", attrs)):
        if df is not None:
            write_by_sample(df, f"{root}/{name}", "gzip", overwrite)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_activities(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None]:
    """Scores and Moran weights; results written without weights give None."""
    scores = spark.read.option("mergeSchema", True).parquet(f"{root}/activities")
    path = f"{root}/pathway_morans"
    return scores, spark.read.parquet(path) if exists(spark, path) else None


def with_optional(df: DataFrame, column: str, dtype: str) -> DataFrame:
    """Older files may lack a column: add it as NULL."""
    return df if column in df.columns else df.withColumn(column, F.lit(None).cast(dtype))


def pending(samples: DataFrame, done: DataFrame | None, overwrite: bool = False) -> DataFrame:
    """Samples still to be computed."""
    if overwrite or done is None:
        return samples
    return samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")


def discover_samples(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Sample ids from file names with an extension; file contents are never read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.substring(name, F.lit(1), F.length(name) - F.lit(len(extension))).alias("id"), "path")


def sample_folders(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Folders right above files with an extension, once each, as ``sample_id=...`` layouts have them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{extension}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("folder")).distinct()


def candidate_feature_dirs(root: str, backbone: str | None = None, explicit: str | None = None) -> list[str]:
    """Feature folders in order of preference. The folder names of the data layout."""
    if explicit:
        return [explicit]
    leaf = "he_features" if not backbone or backbone == "resnet50" else f"he_features_{backbone}"
    return [f"{root}/{leaf}", f"{root}/patches/{leaf}"]


def resolve_feature_dir(spark: SparkSession, root: str, backbone: str | None = None, explicit: str | None = None) -> str:
    tried = candidate_feature_dirs(root, backbone, explicit)
    for path in tried:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"no feature folder among {tried}")


def write_vocabulary(vocab: DataFrame, root: str) -> None:
    """Ordered gene list as JSON and statistics as CSV; both stay in vocabulary order."""
    vocab.orderBy("pos").select("pos", "gene").write.mode("overwrite").json(f"{root}/genes")
    vocab.orderBy("pos").select("gene", "total_counts", "morans_i").write.mode("overwrite").option(
        "header", True).csv(f"{root}/stats")
