"""Pooling and similarity of feature vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPOTS, VECTORS = 2048, 256  # rows of the two sides of one product
DIGITS = 12  # similarities that agree in so many digits are ties in a ranking


def _regroup(long: DataFrame, value: str = "v") -> DataFrame:
    # one group is one vector: its length is the feature width
    return long.groupBy("sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda e: e[value]).alias("features"))


def mean_pool(features: DataFrame) -> DataFrame:
    """One mean vector per sample; positions are averaged with partial aggregation, then put in order."""
    return _regroup(
        features.select("sample_id", F.posexplode("features").alias("pos", "f"))
        .groupBy("sample_id", "pos").agg(F.avg(F.col("f").cast("double")).alias("v")))


def softmax_weights(scores: DataFrame) -> DataFrame:
    """Softmax of ``score`` over the spots of a sample, from pre-aggregated maximum and sum."""
    top = scores.groupBy("sample_id").agg(F.max("score").alias("top"))
    e = scores.join(top, "sample_id").withColumn("e", F.exp(F.col("score") - F.col("top"))).drop("top")
    return e.join(e.groupBy("sample_id").agg(F.sum("e").alias("z")), "sample_id").withColumn(
        "weight", F.col("e") / F.col("z")).drop("e", "z")


def attention_pool(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Softmax-weighted sum of the feature vectors per sample.

    Numerator and denominator are summed together, so the vectors are read once.
    """
    top = scores.groupBy("sample_id").agg(F.max("score").alias("top"))
    weighted = (
        features.join(scores, ["sample_id", "barcode"]).join(top, "sample_id")
        .select("sample_id", F.exp(F.col("score") - F.col("top")).alias("e"), F.posexplode("features").alias("pos", "f"))
        .groupBy("sample_id", "pos").agg((F.sum(F.col("e") * F.col("f").cast("double")) / F.sum("e")).alias("v")))
    return _regroup(weighted)


def pathway_similarity(features: DataFrame, vectors: DataFrame, spots: int = SPOTS, catalogue: int = VECTORS) -> DataFrame:
    """Cosine of each spot vector with each pathway vector; null where a vector is null, has a null or another length.

    Both sides are dealt into blocks by hash, and each pair of blocks is one matrix product, so neither side is
    gathered anywhere: a task holds about ``spots`` times ``catalogue`` results, whatever the sizes of the tables.
    """
    return _products(features, vectors, spots, catalogue, None)


def most_similar(features: DataFrame, vectors: DataFrame, k: int, spots: int = SPOTS, catalogue: int = VECTORS) -> DataFrame:
    """(keys, pathway, similarity, rank) of the ``k`` pathways most like each spot; ties go by name, nulls first.

    Each pair of blocks keeps k rows for a spot, and these are merged; spots x pathways is never written. Similarities are
    rounded to 12 digits; null and NaN ones are left out. A spot is told by its keys.
    """
    keys = _keys(features)
    best = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "pathway")
    return _products(features, vectors, spots, catalogue, k).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _keys(features: DataFrame) -> list[str]:
    return [c for c in ("sample_id", "barcode") if c in features.columns]


def _products(features: DataFrame, vectors: DataFrame, spots: int, catalogue: int, k: int | None) -> DataFrame:
    keys = _keys(features)

    def blocks(table: DataFrame, size: int):
        return table.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size))).scalar()

    down, across = blocks(features, spots), blocks(vectors, catalogue)
    left = features.select(
        *keys, "features", F.pmod(F.xxhash64(*keys, "features"), down).alias("__i"), F.explode(F.sequence(F.lit(0).cast("bigint"), across - 1)).alias("__j"))
    right = vectors.select(
        "pathway", "vector", F.explode(F.sequence(F.lit(0).cast("bigint"), down - 1)).alias("__i"), F.pmod(F.xxhash64("pathway", "vector"), across).alias("__j"))

    def product(spot: pa.Table, path: pa.Table) -> pa.Table:
        similarity, known = block_cosines(spot.column("features").combine_chunks(), path.column("vector").combine_chunks())
        if k is None:
            row, column = np.indices(similarity.shape).reshape(2, -1)
        else:
            similarity = np.round(similarity, DIGITS)
            names = np.argsort(pc.sort_indices(path.column("pathway"), null_placement="at_start").to_numpy())
            left_out = ~known | np.isnan(similarity)
            order = np.lexsort((np.broadcast_to(names, similarity.shape), -similarity, left_out), axis=1)[:, :k]
            row, column = np.repeat(np.arange(len(order)), order.shape[1]), order.ravel()
            row, column = row[~left_out[row, column]], column[~left_out[row, column]]
        values = pa.array(similarity[row, column], mask=~known[row, column])
        return pa.table({**{c: spot.column(c).take(pa.array(row)) for c in keys}, "pathway": path.column("pathway").take(pa.array(column)), "similarity": values})

    schema = T.StructType([*[features.schema[c] for c in keys], vectors.schema["pathway"], T.StructField("similarity", T.DoubleType())])
    return left.groupBy("__i", "__j").cogroup(right.groupBy("__i", "__j")).applyInArrow(product, schema)


def block_cosines(a: pa.ListArray, b: pa.ListArray, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """(cosines of all vectors of two blocks, which of them are known); a norm below ``eps`` is replaced by ``eps``."""
    similarity, known = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)), bool)
    ours, theirs = _by_length(a), _by_length(b)
    for length in ours.keys() & theirs.keys():
        (i, u), (j, v) = ours[length], theirs[length]
        at = np.ix_(i, j)
        similarity[at] = (u / np.maximum(np.linalg.norm(u, axis=1), eps)[:, None]) @ (v / np.maximum(np.linalg.norm(v, axis=1), eps)[:, None]).T
        known[at] = True
    return similarity, known


def _by_length(vectors: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each length; null vectors and those with a null are left out."""
    rows = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    kept = vectors.take(pa.array(rows))
    sizes = pc.list_value_length(kept).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    flat = kept.flatten()
    gap = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))
    whole = gap[starts + sizes] == gap[starts]
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    out = {}
    for length in np.unique(sizes[whole]):
        at = np.flatnonzero(whole & (sizes == length))
        out[int(length)] = rows[at], values[starts[at][:, None] + np.arange(length)]
    return out
