"""Hooks for user models: batched feature extraction, slide scoring, patch scoring and preprocessing.

The model is user code. Spark partitions the rows and moves Arrow batches; a model is built once per
task by a factory, never shipped from the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotlake.functions.coords import SYMMETRIES

# Channel means and deviations commonly used for image backbones.
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def decode_patches(images: pd.Series, h: int, w: int, c: int) -> np.ndarray:
    """Patches of one shape as (B, H, W, C) bytes."""
    return np.frombuffer(b"".join(images), dtype=np.uint8).reshape(len(images), h, w, c)


def preprocess(img: np.ndarray, op: int = 0, mean=CHANNEL_MEAN, std=CHANNEL_STD) -> np.ndarray:
    """(..., H, W, C) bytes to normalised (..., C, H, W) floats, moved by one of the eight symmetries."""
    chw = np.moveaxis(img.astype(np.float64), -1, -3) / 255.0
    chw = (chw - np.asarray(mean)[:, None, None]) / np.asarray(std)[:, None, None]
    return np.ascontiguousarray(turn(chw, op))


def turn(chw: np.ndarray, op: int) -> np.ndarray:
    """Pixels moved as ``SYMMETRIES`` moves their positions; x runs along the last axis, y along the one before."""
    to_x, to_y = SYMMETRIES[op]
    out = chw.swapaxes(-2, -1) if "y" in to_x else chw
    out = out[..., ::-1] if "-" in to_x else out
    return out[..., ::-1, :] if "-" in to_y else out


def extract_features(
    patches: DataFrame, model_factory: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 64
) -> DataFrame:
    """(sample_id, barcode, x, y, features) of a patch table; the model sees (B, C, H, W) batches of one shape.

    An optional column ``op`` (0..7) moves each patch by a symmetry first.
    """
    schema = T.StructType([patches.schema[c] for c in ("sample_id", "barcode", "x", "y")]
                          + [T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            for (h, w, c, op), same in pdf.groupby(["h", "w", "c", "op"], sort=False):
                for i in range(0, len(same), batch_size):
                    part = same.iloc[i:i + batch_size]
                    out = part[["sample_id", "barcode", "x", "y"]].copy()
                    out["features"] = [v.astype(np.float32) for v in model(preprocess(decode_patches(part["img"], h, w, c), op))]
                    yield out

    op = F.col("op") if "op" in patches.columns else F.lit(0)
    return patches.select("sample_id", "barcode", "x", "y", "img", "h", "w", "c", op.cast("int").alias("op")).mapInPandas(run, schema)


def check_width(features: DataFrame, width: int) -> DataFrame:
    """``features`` where the plan raises on a vector of another length; no pass of its own."""
    wrong = F.concat(F.lit(f"expected feature vectors of length {width}, found "), F.size("features").cast("string"))
    vector = F.when(F.size("features") == width, F.col("features")).otherwise(F.raise_error(wrong))
    return features.withColumn("features", vector)


def score_spots(
    features: DataFrame, model_factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    names: list[str], width: int,
) -> DataFrame:
    """Dense scores (sample_id, barcode, pathway, score) of a spot-wise model, batch by batch.

    Spots are scored independently, so a large slide is spread over many tasks.
    """
    missing = {"x", "y"} - set(features.columns)
    if missing:
        raise ValueError("coordinates are required")
    features = check_width(features, width)
    schema = T.StructType([features.schema["sample_id"], features.schema["barcode"],
                           T.StructField("scores", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_factory()
        for pdf in batches:
            if len(pdf):
                got = model(np.stack(pdf["features"].to_numpy()).astype(np.float64), pdf[["x", "y"]].to_numpy())
                yield pdf[["sample_id", "barcode"]].assign(scores=list(np.asarray(got, dtype=np.float64)))

    scored = features.select("sample_id", "barcode", "x", "y", "features").mapInPandas(run, schema)
    labels = F.array(*[F.lit(n) for n in names])
    return scored.select("sample_id", "barcode", F.posexplode("scores").alias("i", "score")).select(
        "sample_id", "barcode", F.element_at(labels, F.col("i") + 1).alias("pathway"), "score")


def score_slides(dense: DataFrame) -> DataFrame:
    """One score per (sample, pathway): the mean of the dense scores."""
    return dense.groupBy("sample_id", "pathway").agg(F.avg("score").alias("score"))


MAX_SPOTS = 200_000  # of a slide that one task may hold


def score_whole_slides(
    features: DataFrame, model_factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]],
    names: list[str], width: int, dense: bool = True, max_spots: int = MAX_SPOTS,
) -> DataFrame:
    """Scores of a model that has to see a whole slide, one slide at a time.

    The model gets (N, width) features and (N, 2) coordinates in the order of barcodes. With ``dense`` it returns (N, P)
    and every spot has its scores (sample_id, barcode, pathway, score); else (1, P) or (P,), and every slide has them
    (sample_id, pathway, score). A slide with more than ``max_spots`` spots raises before any of it is gathered.
    """
    missing = {"x", "y"} - set(features.columns)
    if missing:
        raise ValueError("coordinates are required")
    keys = ["sample_id", "barcode"] if dense else ["sample_id"]
    sizes = features.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    wide = F.concat(F.lit("slide "), F.col("sample_id").cast("string"), F.lit(f" has more than {max_spots} spots: "), F.col("n").cast("string"))
    spots = check_width(features, width).select("sample_id", "barcode", "x", "y", "features").join(sizes, "sample_id")
    spots = spots.withColumn("features", F.when(F.col("n") <= max_spots, F.col("features")).otherwise(F.raise_error(wide))).drop("n")

    def run(slide: pd.DataFrame) -> pd.DataFrame:
        slide = slide.sort_values("barcode", kind="stable")
        got = np.asarray(model_factory()(np.stack(slide["features"].to_numpy()).astype(np.float64), slide[["x", "y"]].to_numpy(dtype=np.float64)), dtype=np.float64)
        rows = len(slide) if dense else 1
        if got.reshape(-1, len(names)).shape != (rows, len(names)) or (dense and got.ndim != 2):
            raise ValueError(f"expected scores of shape {(rows, len(names))}, found {got.shape}")
        return slide[keys].head(rows).assign(scores=list(got.reshape(rows, len(names))))

    schema = T.StructType([*[features.schema[k] for k in keys], T.StructField("scores", T.ArrayType(T.DoubleType()))])
    labels = F.array(*[F.lit(n) for n in names])
    scored = spots.groupBy("sample_id").applyInPandas(run, schema)
    return scored.select(*keys, F.posexplode("scores").alias("i", "score")).select(*keys, F.element_at(labels, F.col("i") + 1).alias("pathway"), "score")


def score_patches(features: DataFrame, model_factory: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Score rows on their own, each at coordinate (0, 0)."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()
        for vectors in parts:
            x = np.stack(vectors.to_numpy()).astype(np.float64)
            yield pd.Series(list(np.asarray(model(x, np.zeros((len(x), 2))), dtype=np.float64)))

    return features.withColumn("scores", one("features"))
