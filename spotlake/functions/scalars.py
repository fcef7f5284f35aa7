"""Scalar column helpers: names, rounding, normalisation, membership values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mitochondrial gene-name prefixes (lower case) of the pathway QC.
MT_PREFIXES = ("mt-", "mt:", "mt_", "grcm38_mt-", "hs_mt-")
# Substrings that mark mitochondrial genes in the QC audit.
MT_SUBSTRINGS = ("mt-", "mt:")
# Fixed value: collection prefix of hallmark set names.
SET_PREFIX = "HALLMARK_"


def rounded(c: Column, digits: int = 6) -> Column:
    """Round and turn -0.0 into 0.0, so equal results print and hash equally."""
    return F.round(c, digits) + F.lit(0.0)


def is_mt_prefix(gene: Column) -> Column:
    low = F.lower(gene)
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in MT_PREFIXES])


def is_mt_substring(gene: Column) -> Column:
    low = F.lower(gene)
    return reduce(lambda a, b: a | b, [low.contains(p) for p in MT_SUBSTRINGS])


def log_normalised(count: Column, library: Column, target_sum: float = 10000.0) -> Column:
    """log1p of the count scaled to ``target_sum`` per spot; libraries below 1 count as 1."""
    return F.log1p(count / F.greatest(library, F.lit(1.0)) * F.lit(float(target_sum)))


def back_transformed(value: Column) -> Column:
    return F.expm1(value)


def short_name(pathway: Column) -> Column:
    return F.replace(pathway, F.lit(SET_PREFIX), F.lit(""))


def metric_title(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def trace_label(run: Column, metric: Column, several: Column) -> Column:
    """The run name alone, or ``run (Metric Title)`` when several metrics share a chart."""
    return F.when(several, F.concat(run, F.lit(" ("), metric_title(metric), F.lit(")"))).otherwise(run)


def clipped_at_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def utf8(c: Column) -> Column:
    return F.decode(c, "UTF-8")



def seeded_hash(seed: int, *keys: Column) -> Column:
    """A 32-bit number from md5 of ``seed:key:...``; the same on every engine and partitioning."""
    text = F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
