"""Exact deduplication by deterministic block naming; DataFrame functions only.

A text is cut into blocks of ``BLOCK`` characters. Blocks are sorted into cells by the high bits of a hash, and
the different blocks of one cell are sorted and numbered: cell and number are the integer name of a block. Then
adjacent names are paired, and the pairs are named in the same way, until each document has one name; the number
of blocks and that name are named last. Equal names mean equal blocks, without trusting the hash: a cell is read
as a name by itself only after a count over all data shows that it holds one value, and the values of every other
cell are numbered. Only distinct blocks are shuffled (once, combined before the shuffle); a passage or document
that is repeated often meets no other rows than its own kind from each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.tables import keep_winners, stored

BLOCK = 1024
CELL_BITS = 56  # of 63; the others number the values of a cell


def integer_names(lists: DataFrame, cell_bits: int = CELL_BITS) -> DataFrame:
    """Replace the array ``items`` by an array ``names`` of longs; names are equal where items are.

    ``lists`` has a column ``row`` that is unique. Empty arrays stay empty.
    """
    room = 63 - cell_bits

    def cell(value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - cell_bits)

    rest = [c for c in lists.columns if c != "items"]
    values = lists.select(F.explode("items").alias("value")).select(cell(F.col("value")).alias("cell"), "value").distinct()
    shared = stored(values.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
    if shared.isEmpty():
        return lists.select(*rest, F.transform("items", lambda v: F.shiftleft(cell(v), room)).alias("names"))
    order = Window.partitionBy("cell").orderBy("value")
    numbers = stored(values.join(shared, "cell", "left_semi").select("cell", "value", (F.row_number().over(order) - 1).alias("number")), "numbers")
    number = F.coalesce(F.col("number"), F.lit(0)).cast("long")
    number = F.when(number < (1 << room), number).otherwise(F.raise_error(F.lit("more values in a cell than cell_bits leaves numbers")))
    each = lists.select(*rest, F.posexplode_outer("items").alias("at", "value")).withColumn("cell", cell(F.col("value")))
    named = each.join(numbers, ["cell", "value"], "left").withColumn("name", F.shiftleft("cell", room).bitwiseOR(number))
    back = named.groupBy("row").agg(
        *[F.first(c).alias(c) for c in rest if c != "row"],
        F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "name")))).alias("placed"),
    )
    return back.select(*rest, F.col("placed.name").alias("names"))


def identities(docs: DataFrame, block: int = BLOCK, cell_bits: int = CELL_BITS) -> DataFrame:
    """(row, doc_id, text_sha256, identity) of every row; equal identity means equal text. Stored.

    Null texts count as empty. ``row`` is unique, so that repeated doc_ids and repeated rows stay apart.
    """
    text = F.coalesce("text", F.lit(""))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % block), F.lit(0))
    start = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(text, 256).alias("text_sha256"), blocks.alias("items"))
    names = stored(integer_names(start, cell_bits).withColumn("blocks", F.size("names").cast("long")), "names")
    most = names.agg(F.max("blocks")).first()[0] or 0
    while most > 1:
        pairs = F.when(F.size("names") > 0, F.transform(
            F.sequence(F.lit(0), F.size("names") - 1, F.lit(2)),
            lambda i: F.struct(F.get("names", i).alias("left"), F.coalesce(F.get("names", i + 1), F.lit(-1)).alias("right")),
        )).otherwise(F.array().cast("array<struct<left:bigint,right:bigint>>"))
        names = stored(integer_names(names.select("row", "doc_id", "text_sha256", "blocks", pairs.alias("items")), cell_bits), "names")
        most = (most + 1) // 2
    last = F.array(F.struct(F.col("blocks"), F.coalesce(F.get("names", F.lit(0)), F.lit(-1)).alias("name")))
    done = integer_names(names.select("row", "doc_id", "text_sha256", last.alias("items")), cell_bits)
    return stored(done.select("row", "doc_id", "text_sha256", F.get("names", F.lit(0)).alias("identity")), "identities")


def _groups(rows: DataFrame) -> DataFrame:
    """Groups of two and more rows, stored; of rows with the largest doc_id, the last row wins."""
    counted = rows.groupBy("identity").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))
    return stored(counted.where("group_size > 1").select("identity", "group_size", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")), "groups")


def exact_duplicates(docs: DataFrame, block: int = BLOCK, cell_bits: int = CELL_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Null texts count as empty and are copies of each other and of empty texts. Of equal texts, the row with the
    largest doc_id stays (a null doc_id is smaller than any other); of repeated rows exactly one is kept. No
    rows give no rows. Only doc_id and text are read.
    """
    rows = identities(docs, block, cell_bits)
    joined = rows.join(_groups(rows), "identity", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, block: int = BLOCK, cell_bits: int = CELL_BITS) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all columns."""
    found = stored(exact_duplicates(docs, block, cell_bits), "copies")
    counts = found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    return keep_winners(docs, stored(counts.where("kept").select("doc_id", "text_sha256", (F.col("n") > 1).alias("repeated")), "winners"))
