"""Aggregates as plain column expressions, usable in any ``agg``.

They use the central-moment aggregates (``var_pop``, ``covar_pop``): these merge without the
cancellation of raw sums, and unlike ``corr`` they do not divide by a zero variance.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pcc(pred: Column, target: Column, eps: float = 1e-8) -> Column:
    """Pearson correlation with ``eps`` inside each root; 0 for a constant column."""
    n = F.count(pred).cast("double")
    return n * F.covar_pop(pred, target) / (
        F.sqrt(n * F.var_pop(pred) + F.lit(eps)) * F.sqrt(n * F.var_pop(target) + F.lit(eps))
    )


def pearson(a: Column, b: Column, tiny: float = 0.0) -> Column:
    """Pearson correlation, NULL unless both population deviations exceed ``tiny``."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > F.lit(tiny)) & (sb > F.lit(tiny)), F.covar_pop(a, b) / (sa * sb))


def mse(pred: Column, target: Column) -> Column:
    return F.avg((pred - target) * (pred - target))


def weighted_mse(pred: Column, target: Column, weight: Column) -> Column:
    """Sum of weighted squares over the sum of weights; NULL when the weights sum to 0."""
    return F.try_divide(F.sum(weight * (pred - target) * (pred - target)), F.sum(weight))


def mae(pred: Column, target: Column) -> Column:
    return F.avg(F.abs(pred - target))


def huber(pred: Column, target: Column, delta: float = 1.0) -> Column:
    d = F.abs(pred - target)
    return F.avg(F.when(d <= delta, d * d * 0.5).otherwise(F.lit(delta) * (d - 0.5 * delta)))


def poisson_nll(log_rate: Column, target: Column) -> Column:
    return F.avg(F.exp(log_rate) - target * log_rate)


def centred_square_sum(mean_nonzero: Column, var_nonzero: Column, m: Column, n: Column) -> Column:
    """Sum of squared deviations over ``n`` values of which ``m`` are stored and the rest are zero."""
    return var_nonzero * m + m * (n - m) / n * mean_nonzero * mean_nonzero


def morans(cross: Column, lagged: Column, mean: Column, square_sum: Column, k: int) -> Column:
    """Moran's I of a k-nearest-neighbour graph with weights 1/k.

    ``cross`` = sum of x_i*x_j over edges, ``lagged`` = sum of x_j over edges, ``square_sum`` = sum of
    squared deviations. Every row of weights sums to 1, so the total weight equals the spot count.
    """
    return F.when(square_sum < 1e-12, F.lit(0.0)).otherwise(
        (cross - mean * lagged) / F.lit(float(k)) / square_sum
    )
