"""Registration of queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotlake.catalog.bindings import Bindings, oracle
from spotlake.functions.scalars import rounded

# Moves exact halves, whose last bits are noise, off the rounding border.
OFF_HALF = 1.3e-9

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, r: str = "", i: str = "", **ctes: str):
    """Register ``fn(bindings) -> DataFrame``.

    ``r`` names double columns that are rounded to 6 digits,  ``i`` integer columns that become bigint,
    on both sides alike (engines differ in summation order and in the type of an integer sum).
    """

    def register(fn: Callable[[Bindings], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Bindings(spark, sf_dir))
            casts = {c: rounded(F.col(c).cast("double") + F.lit(OFF_HALF)) for c in r.split()}
            casts |= {c: F.col(c).cast("bigint") for c in i.split()}
            return df.withColumns(casts) if casts else df

        QUERIES[name] = run
        if sql:
            fixes = [f"round(CAST({c} AS DOUBLE) + CAST({OFF_HALF} AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS {c}" for c in r.split()]
            fixes += [f"CAST({c} AS BIGINT) AS {c}" for c in i.split()]
            text = f"SELECT * REPLACE ({', '.join(fixes)}) FROM (\n{sql}\n)" if fixes else sql
            ORACLES[name] = oracle(text, **ctes)
        return fn

    return register
