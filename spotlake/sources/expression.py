"""Expression layouts to long rows, and the metadata-only scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_csr(blocks: DataFrame) -> DataFrame:
    """Row blocks in CSR form (sample_id, barcodes[], genes[], data[], indices[], indptr[]) to long rows.

    A slide may come in any number of blocks; each block is expanded on its own.
    """

    def cells(barcode: Column, row: Column) -> Column:
        start, end = F.get("indptr", row), F.get("indptr", row + 1)
        places = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
        return F.struct(barcode.alias("barcode"), F.transform(places, lambda p: F.struct(
            F.get("genes", F.get("indices", p)).alias("gene"), F.get("data", p).cast("double").alias("count"))).alias("cells"))

    # Only the cells of a spot leave a block, never its arrays.
    spots = blocks.select("sample_id", F.inline(F.transform("barcodes", cells)))
    return spots.select("sample_id", "barcode", F.inline("cells")).filter(F.col("count") != 0)


def from_dense(rows: DataFrame, gene_index: DataFrame) -> DataFrame:
    """Dense rows (sample_id, barcode, values[]) with (sample_id, gene_pos, gene); zeros are dropped."""
    cells = rows.select("sample_id", "barcode", F.posexplode("values").alias("gene_pos", "count")).filter(
        F.col("count") != 0)
    return cells.join(gene_index, ["sample_id", "gene_pos"]).select(
        "sample_id", "barcode", "gene", F.col("count").cast("double").alias("count"))


def metadata(obs: DataFrame, var: DataFrame, images: DataFrame, scalefactors: DataFrame) -> DataFrame:
    """Per sample: number of spots and genes, image shapes and scale factors; counts are never read."""
    shapes = images.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.concat_ws(
        "x", F.concat_ws(":", "image_key", F.col("h").cast("string")), F.col("w").cast("string")))).alias("s"))
    factors = scalefactors.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.concat_ws("=", "key", F.format_string("%.4f", F.col("value").cast("double"))))).alias("f"))
    return (
        obs.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_spots"))
        .join(var.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_genes")), "sample_id", "left")
        .join(shapes, "sample_id", "left").join(factors, "sample_id", "left")
        .select("sample_id", "n_spots", F.coalesce("n_genes", F.lit(0)).alias("n_genes"),
                F.array_join("s", ",").alias("images"), F.array_join("f", ",").alias("scalefactors")))


def choose_image(images: DataFrame, scalefactors: DataFrame, wanted: str | None = None,
                 preferred: str = "downscaled_fullres") -> DataFrame:
    """One image and scale factor per sample.

    Image: the wanted one, else the preferred key, else the first by name. Factor: ``tissue_<key>_scalef``,
    else the first key containing both the image key and ``scalef``, else the first by name. A sample
    without any factor keeps its image, with nulls.
    """
    rank = F.when(F.col("image_key") == (wanted or preferred), 0).otherwise(1)
    if wanted:
        images = images.filter(F.col("image_key") == wanted)
    image = images.groupBy("sample_id").agg(
        F.min_by(F.struct("image_key", "h", "w"), F.struct(rank, "image_key")).alias("i")).select("sample_id", "i.*")
    exact = F.col("key") == F.concat(F.lit("tissue_"), "image_key", F.lit("_scalef"))
    close = F.contains("key", "image_key") & F.col("key").contains("scalef")
    order = F.struct(F.when(exact, 0).when(close, 1).otherwise(2), F.col("key"))
    factor = image.join(scalefactors, "sample_id").groupBy("sample_id").agg(
        F.min_by(F.struct("key", "value"), order).alias("f"))
    return image.join(factor, "sample_id", "left").select(
        "sample_id", "image_key", "h", "w", F.col("f.key").alias("scale_key"), F.col("f.value").alias("scalef"))
