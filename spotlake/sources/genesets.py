"""GMT gene-set text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gmt_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a place that orders them inside their file, however the file is split into tasks."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("a"), F.monotonically_increasing_id().alias("b")).alias("line"))


def parse_gmt(lines: DataFrame) -> DataFrame:
    """(pathway, pos, gene) of tab-separated lines ``name, description, gene...``.

    Edge whitespace is stripped, lines with fewer than three fields are skipped, and of several lines
    with one name the last one counts.
    """
    parts = F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), "\t")
    rows = lines.select(parts.alias("p"), "file", "line").filter(F.size("p") >= 3)
    named = rows.select(F.col("p")[0].alias("pathway"), "file", "line",
                        F.slice("p", F.lit(3), F.size("p") - 2).alias("genes"))
    last = named.groupBy("pathway").agg(F.max_by("genes", F.struct("file", "line")).alias("genes"))
    return last.select("pathway", F.posexplode("genes").alias("pos", "gene"))


def read_gmt(spark: SparkSession, path: str, collection: str) -> DataFrame:
    return parse_gmt(gmt_lines(spark, path)).select(F.lit(collection).alias("collection"), "pathway", "gene")


def gmt_text(gene_sets: DataFrame) -> DataFrame:
    """One GMT line per set, for writing with ``write.text``; a set is bounded by the gene panel."""
    genes = F.array_join(F.array_sort(F.collect_list("gene")), "\t")
    return gene_sets.groupBy("pathway").agg(genes.alias("g")).select(
        F.concat_ws("\t", "pathway", F.lit("na"), "g").alias("value"))
