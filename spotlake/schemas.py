"""Canonical table schemas and the contract check every user table has to pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

STRING, DOUBLE, INT, BOOL = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


REGISTRY_CSV = _struct(
    ("id", STRING), ("organ", STRING), ("disease_state", STRING), ("st_technology", STRING),
    ("species", STRING), ("preservation_method", STRING), ("patient", STRING),
)

# Required columns per table kind. ``None`` accepts any atomic type (ids may be numbers or strings).
CONTRACTS: dict[str, dict[str, tuple[type, ...] | None]] = {
    "samples": {"id": None, "organ": (T.StringType,), "disease_state": (T.StringType,),
                "st_technology": (T.StringType,), "species": (T.StringType,), "patient": (T.StringType,)},
    "obs": {"sample_id": None, "barcode": None, "x": (T.DoubleType,), "y": (T.DoubleType,)},
    "var": {"sample_id": None, "gene": (T.StringType,)},
    "expr": {"sample_id": None, "barcode": None, "gene": (T.StringType,), "count": (T.DoubleType,)},
    "gene_sets": {"collection": (T.StringType,), "pathway": (T.StringType,), "gene": (T.StringType,)},
    "features": {"sample_id": None, "barcode": None, "x": (T.DoubleType,), "y": (T.DoubleType,),
                 "features": (T.ArrayType,)},
    "patches": {"sample_id": None, "barcode": None, "x": (T.DoubleType,), "y": (T.DoubleType,),
                "img": (T.BinaryType,), "h": (T.IntegerType,), "w": (T.IntegerType,), "c": (T.IntegerType,)},
    "images": {"sample_id": None, "image_key": (T.StringType,), "h": (T.IntegerType, T.LongType),
               "w": (T.IntegerType, T.LongType)},
    "scalefactors": {"sample_id": None, "key": (T.StringType,), "value": (T.DoubleType,)},
    "activities": {"sample_id": None, "barcode": None, "pathway": (T.StringType,), "score": (T.DoubleType,)},
    "pathway_morans": {"sample_id": None, "pathway": (T.StringType,), "morans_i": (T.DoubleType,)},
    "predictions": {"sample_id": None, "barcode": None, "pathway": (T.StringType,),
                    "pred": (T.DoubleType,), "target": (T.DoubleType,)},
    "metrics": {"run_name": (T.StringType,), "epoch": (T.IntegerType, T.LongType),
                "metric": (T.StringType,), "value": (T.DoubleType,)},
    "artifacts": {"path": (T.StringType,), "modificationTime": (T.TimestampType,)},
}


def validate(df: DataFrame, kind: str) -> DataFrame:
    """Return ``df`` unchanged when it satisfies the contract of ``kind``; raise otherwise."""
    if kind not in CONTRACTS:
        raise KeyError(f"unknown table kind: {kind}")
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in CONTRACTS[kind] if c not in types]
    if missing:
        raise ValueError(f"{kind}: missing columns {missing}")
    for name, allowed in CONTRACTS[kind].items():
        if allowed is None:
            if isinstance(types[name], (T.ArrayType, T.MapType, T.StructType)):
                raise TypeError(f"{kind}.{name}: an atomic type is required, got {types[name].simpleString()}")
        elif not isinstance(types[name], allowed):
            raise TypeError(f"{kind}.{name}: got {types[name].simpleString()}")
    return df
