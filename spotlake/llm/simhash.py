"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most two bits differ in
at most one bit of the high segment, or agree in the low one. So the table holds every fingerprint under both
segments; probes are the low segment itself and the ball of radius one around the high segment; what a probe
fetches is verified over all 64 bits.

A segment value with more than ``bucket`` fingerprints would give too many pairs. The fingerprints that meet
there are linked another way, which is exact too: two fingerprints differ in at most two bits if and only if
their full balls of radius one share a point. A point is shared by 65 fingerprints at most, so this stays linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.components import connected_components
from spotlake.llm.tables import keep_winners, stored

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
BLOCK = 65536


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of one text: a bit is 1 if set in over half of the shingle hashes."""
    parts = (text or "").encode().translate(LOWER).split()  # bytes.split() splits at U+0020, U+0009 to U+000D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        spans = zip(starts, ends[words - 1:].tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at:at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, text_sha256) for every row. A null text counts as empty; a text without words has fp 0."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [fingerprint(t.as_py(), words) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(fps, pa.int64()), part.column("text_sha256")], ["doc_id", "fp", "text_sha256"]
            )

    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long, text_sha256 string")


def links(prints: DataFrame, bucket: int = 64) -> DataFrame:
    """Links (a, b) that connect the same fingerprints as all pairs within two bits do.

    ``prints`` (fp) holds distinct fingerprints and is stored. Every pair that meets in a bucket of at most
    ``bucket`` fingerprints comes as a link of its own; fuller buckets give links by shared ball points.
    """
    high = F.shiftrightunsigned("fp", 32)
    low_key = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)) + F.lit(1 << 32)
    table = prints.select("fp", F.explode(F.array(high, low_key)).alias("key"))
    # Of two values one bit apart, exactly one has a 0 there: only that one probes.
    bits = F.array(*[F.lit(1 << i) for i in range(32)])
    raised = F.filter(F.transform(bits, lambda bit: high.bitwiseOR(bit)), lambda v: v != high)
    probes = prints.select("fp", F.explode(raised).alias("key"))
    full = stored(table.groupBy("key").count().where(F.col("count") > bucket).select("key"), "full")
    crowded = None
    if not full.isEmpty():
        met = table.join(full, "key", "left_semi").union(probes.join(full, "key", "left_semi"))
        crowded = met.select("fp").distinct()
        table, probes = table.join(full, "key", "left_anti"), probes.join(full, "key", "left_anti")
    same = table.select(F.col("fp").alias("a"), "key").join(table.select(F.col("fp").alias("b"), "key"), "key").where("a < b")
    near = probes.select(F.col("fp").alias("a"), "key").join(table.select(F.col("fp").alias("b"), "key"), "key")
    found = same.select("a", "b").union(near.select("a", "b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
    if crowded is None:
        return found
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << i) for i in range(63)], F.lit(-(1 << 63)))
    ball = F.transform(masks, lambda mask: F.col("fp").bitwiseXOR(mask))
    points = crowded.select("fp", F.explode(ball).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.union(points.join(hubs, "point").where("a <> fp").select("a", F.col("fp").alias("b")))


def near_duplicates(docs: DataFrame, words: int = 3, bucket: int = 64) -> DataFrame:
    """(doc_id, fp, fingerprint, root, component_id, text_sha256) for every row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most two differing bits; rows with equal
    fingerprints are linked. Null texts count as empty and are linked to each other; null doc_ids are passed
    over in the minimum (null only if the whole group has none); repeated rows stay; other columns are ignored.
    root names the group also where it has no doc_id.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "prints")
    roots = connected_components(links(prints.select("fp"), bucket))
    placed = stored(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")),
        "placed",
    )
    groups = stored(placed.groupBy("root").agg(F.min("least_id").alias("component_id")), "groups")
    classes = stored(placed.join(groups, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id", "text_sha256"
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3, bucket: int = 64) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, then the smallest text digest. All columns stay.

    Rows without a doc_id only stay where their whole group has none (one of them).
    """
    found = stored(near_duplicates(docs, words, bucket), "near")
    least = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counts = least.groupBy("root", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("root").agg(F.min(F.struct("text_sha256", "doc_id", "n")).alias("best"))
    winners = best.select("best.doc_id", "best.text_sha256", (F.col("best.n") > 1).alias("repeated"))
    return keep_winners(docs, stored(winners, "winners"))
