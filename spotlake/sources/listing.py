"""Listings of stored files: taken once, kept as a table, and read by every report that asks what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, modified) of the files below ``root`` whose names match; contents are not read, hidden files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def commit_listing(spark: SparkSession, root: str, to: str, pattern: str = "*") -> DataFrame:
    """Write the listing of ``root`` to ``to`` and read it back: later changes below ``root`` do not show in it."""
    list_files(spark, root, pattern).write.mode("overwrite").parquet(to)
    return spark.read.parquet(to)


def listed_artifacts(listing: DataFrame) -> DataFrame:
    """(path, run_name, modificationTime, size) of image artefacts, with the run folder right above them.

    An artefact is a file ``NAME.png`` or, as Spark writes it, a folder of that name: then sizes of its files are summed and
    the newest time counts. Of folders ``key=value`` the value is the name.
    """
    pattern = r"^(?:.*/)?([^/]+)/([^/]+[.]png)(?:/.*)?$"

    def name(group: int):
        return F.regexp_replace(F.regexp_extract("path", pattern, group), "^[^=]*=", "")

    found = listing.where(F.col("path").rlike(pattern)).withColumns({"run_name": name(1), "filename": name(2)})
    return found.groupBy("run_name", "filename").agg(F.max("modified").alias("modificationTime"), F.sum("size").alias("size")).select(
        F.concat_ws("/", "run_name", "filename").alias("path"), "run_name", "modificationTime", "size")


def sample_files(listing: DataFrame) -> DataFrame:
    """(sample_id, kind, n_files, size) of tables written by sample; the kind is the folder above ``sample_id=...``."""
    pattern = r"^(?:.*/)?([^/]+)/sample_id=([^/]+)/[^/]+$"
    found = listing.where(F.col("path").rlike(pattern))
    return found.groupBy(F.regexp_extract("path", pattern, 2).alias("sample_id"), F.regexp_extract("path", pattern, 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("size"))
