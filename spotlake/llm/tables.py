"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.session import work_path

# ASCII white space as the contracts define it, U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]"


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (names are compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut, and the size is known to the planner."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.__dict__["stored_at"] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``stored`` that nothing reads any more; other tables are left alone."""
    for table in tables:
        path = table.__dict__.pop("stored_at", None)
        if path:
            where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def checked_broadcast(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """``table``, a stored one with short rows, to be broadcast if it has at most ``rows`` rows; else it is shuffled."""
    return F.broadcast(table) if table.count() <= rows else table


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keep_winners(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, SHA-256 of the text) is in ``winners``, one row for each such key.

    ``winners`` is a stored table (doc_id, text_sha256, repeated); ``repeated`` marks keys that several
    rows may carry. Only those rows pass a second grouping, which combines before it shuffles.
    """
    digest, won = fresh(docs, "text_sha256"), fresh(docs, "won")
    left = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    right = winners.select(F.col("doc_id").alias(won), F.col("text_sha256").alias(won + "_sha"), F.col("repeated").alias(won + "_repeated"))
    joined = left.join(right, left["doc_id"].eqNullSafe(right[won]) & (left[digest] == right[won + "_sha"]))
    single = joined.where(~F.col(won + "_repeated")).select(*docs.columns)
    if winners.where("repeated").isEmpty():
        return single
    again = joined.where(won + "_repeated").dropDuplicates([won, won + "_sha"]).select(*docs.columns)
    return single.unionByName(again)
