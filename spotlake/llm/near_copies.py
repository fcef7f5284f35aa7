"""Near copies: wide SimHash fingerprints, multi-index hashing, and a check of the shingles themselves.

Texts that share eight in ten of their shingles differ in about a seventh of all fingerprint bits, so one word of 64
bits within two bits is too strict for a pipeline. Here a fingerprint has eight words, cut into 21 segments of 22 bits.
The table holds every segment; a text probes its own segments and the balls of radius one around them, and
what it fetches is held against it over all bits. Candidates are verified by the share of common shingles.

Many near copies of one text would fetch each other in most segments. So every text meets, under its own segments, only
the leader of each value, the text whose values are held most often; verified links are closed transitively. Texts that
are near a leader are the crowd. Balls are fetched for pairs with at least one text outside the crowd.
Fingerprints meet by chance and are held against bounds, so they only link most near copies, with few comparisons. Every text, of the
crowd or not, that can have a near copy it is not connected to (``unsettled``, an exact test) is then joined exactly by its rarest
shingles (``set_join``), which pairs only texts that are not connected yet. So no pair is left out.
Nothing depends on how many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spotlake.llm.components import connected_components
from spotlake.llm.minhash import leader_pairs, shared_keys
from spotlake.llm.set_join import SLACK, unlinked_pairs, verified
from spotlake.llm.shingles import shingle_hashes, shingle_sets
from spotlake.llm.simhash import BLOCK
from spotlake.llm.tables import checked_broadcast, discard, keep_winners, stored

# At 0.8 in common about 0.151 of the bits differ; then a segment and its ball are met with probability 0.134, one of all
# with 0.951, and with more in common sooner.
LANES, WIDTH, SEGMENTS = 8, 22, 21
RADIUS_FIRST = 20  # bits of the first word; of all words a quarter
PART = 16  # one in so many shingles more than the least number lie in the early ones


def _remixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Another 64-bit hash for each hash; fixed values: the constants of a public 64-bit mixer."""
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def wide_fingerprint(text: str | None, words: int = 5, lanes: int = LANES) -> list[int]:
    """``lanes`` signed 64-bit words; a bit is 1 if set in over half of the hashes of its lane, each distinct shingle once."""
    return _voted(np.unique(shingle_hashes(text, words)), lanes)


def _voted(hashes: np.ndarray, lanes: int = LANES) -> list[int]:
    votes = np.zeros((lanes, 64), dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        for lane in range(lanes):
            part = hashes[at:at + BLOCK]
            part = _remixed(part, lane) if lane else part
            bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes[lane] += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view("<i8").ravel().tolist()


def _segments(lanes: list[int], width: int, segments: int) -> list[int]:
    """Segment number and value as one integer, for each segment."""
    whole = sum((w % (1 << 64)) << (64 * i) for i, w in enumerate(lanes))
    return [(s << width) | (whole >> (s * width) & ((1 << width) - 1)) for s in range(segments)]


def _segments(lanes: list[int], width: int = WIDTH, segments: int = SEGMENTS) -> list[int]:
    """Segment number and value as one integer, for each segment."""
    whole = sum((w % (1 << 64)) << (64 * i) for i, w in enumerate(lanes))
    return [(s << width) | (whole >> (s * width) & ((1 << width) - 1)) for s in range(segments)]


def _least_common(size: int, share: float) -> int:
    """The fewest shingles that a set of ``size`` has in common with any set that has ``share`` of their union in common with it."""
    return math.ceil(share * size - SLACK)


def _met(size: int, share: float) -> int:
    """How many early shingles two sets have in common at least, if the smaller one has ``size`` and they share enough."""
    return min(1 + size // PART, _least_common(size, share))


def early_shingles(hashes: np.ndarray, share: float) -> np.ndarray:
    """The least of a set's sorted hashes, so many that each set with ``share`` in common has ``_met`` of them among its own.

    Of two sets with c common hashes the k-th common one comes among the first size - c + k of either.
    """
    return hashes[:hashes.size - _least_common(hashes.size, share) + _met(hashes.size, share)]


def wide_fingerprints(docs: DataFrame, words: int, share: float = 0.8) -> DataFrame:
    """(doc_id, text_sha256, lanes, segments, least, early) for every row; a text without words has zeros and the shingle 0.

    ``early`` are the early shingles, and ``least`` tells how many of them are found among those of any text with ``share`` in common.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lanes, least, early = [], [], []
            for text in part.column("text"):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                lanes.append(_voted(hashes))
                hashes = hashes if hashes.size else np.zeros(1, dtype="<u8")
                least.append(_met(_least_common(hashes.size, share), share))
                early.append(early_shingles(hashes, share).view("<i8"))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_sha256"), pa.array(lanes, longs), pa.array([_segments(w) for w in lanes], longs),
                 pa.array(least, pa.int64()), pa.array(early, longs)], ["doc_id", "text_sha256", "lanes", "segments", "least", "early"])

    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.mapInArrow(batches, f"doc_id {kind}, text_sha256 string, lanes array<long>, segments array<long>, least long, early array<long>")


def _near(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole fingerprints differ in at most a quarter of the bits."""
    whole = pairs.join(texts.select(F.col("n").alias("a"), F.col("lanes").alias("x")), "a").join(
        texts.select(F.col("n").alias("b"), F.col("lanes").alias("y")), "b")
    bits = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    return whole.where(bits <= 16 * F.size("x")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("n")).distinct()


def fetched_pairs(texts: DataFrame, crowd: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b), a > b, that meet in a ball, at least one of them outside ``crowd`` (n), stored; and texts (n) that met few others.

    Under a value that more than ``bucket`` texts hold a text outside the crowd meets three of them, which links most. The second
    table has the texts that hold or probe such a value. Their other pairs, those of the crowd, and those that do not meet or are
    dropped by their fingerprints are found by the exact join of ``near_copy_groups``, which asks every text.
    """
    marked = texts.join(crowd.withColumn("in", F.lit(True)), "n", "left").select(
        "n", F.get("lanes", F.lit(0)).alias("first"), "segments", F.col("in").isNotNull().alias("in"))
    marked = stored(marked, "marked")
    table = marked.select(F.col("n").alias("m"), F.col("first").alias("m_first"), F.col("in").alias("m_in"), F.explode("segments").alias("key"))
    bits = F.array(*[F.lit(1 << i) for i in range(WIDTH)])
    # Of two values one bit apart, exactly one has a 0 there: only that one probes.
    raised = F.flatten(F.transform("segments", lambda s: F.filter(F.transform(bits, lambda b: s.bitwiseOR(b)), lambda v: v != s)))
    asking = marked.select("n", "first", "in", F.explode(F.concat("segments", raised)).alias("key"))
    full = stored(table.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > bucket).select("key"), "full")
    near = (F.bit_count(F.col("first").bitwiseXOR(F.col("m_first"))) <= RADIUS_FIRST) & (F.col("n") != F.col("m"))
    ends = (F.greatest("n", "m").alias("a"), F.least("n", "m").alias("b"))
    rest = table.join(checked_broadcast(full), "key", "left_anti")
    pairs = asking.join(rest, "key").where(near & ~(F.col("in") & F.col("m_in"))).select(*ends).distinct()
    spread = [F.min(F.struct(F.xxhash64(F.lit(i), "m").alias("h"), "m", "m_first")).alias(f"l{i}") for i in range(3)]
    some = table.join(checked_broadcast(full), "key", "left_semi").groupBy("key").agg(*spread)
    some = stored(some.select("key", F.explode(F.array_distinct(F.array(*[F.struct(f"l{i}.m", f"l{i}.m_first") for i in range(3)]))).alias("l")).select("key", "l.*"), "some")
    met = asking.where("NOT in").join(checked_broadcast(some), "key").where(near).select(*ends).distinct()
    pairs, met = (stored(_near(p, texts), "fetched") for p in (pairs, met))
    joined = asking.where("NOT in").join(checked_broadcast(full), "key", "left_semi").select("n").distinct()
    return stored(pairs.union(met).distinct(), "pairs"), joined


def shared_early(rows: DataFrame) -> DataFrame:
    """(key, n) of the early shingles of ``rows`` (n, early) that several rows have. Stored.

    Most are held once, so they are moved once, in a window over the key; it has a row for each text at most, and goes to disk if long.
    """
    slots, same = rows.select("n", F.explode("early").alias("key")), Window.partitionBy("key")
    found = slots.select("key", "n", F.min("n").over(same).alias("x"), F.max("n").over(same).alias("y"))
    return stored(found.where("x <> y").select("key", "n"), "early")


def _enough(held: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts (n) with at least ``least`` rows in ``held``."""
    counts = held.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    return counts.join(texts.select("n", "least"), "n").where("k >= least").select("n")


def unsettled(held: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(n) of the texts that can have a near copy they are not connected to. Stored.

    Such a text finds ``least`` of its early shingles among those of a text with another root.
    """
    placed = held.join(roots.select(F.col("node").alias("n"), "root"), "n", "left").select("key", "n", F.coalesce("root", "n").alias("root"))
    placed = stored(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = stored(_enough(placed.join(mixed, "key", "left_semi"), texts), "unsettled")
    discard(placed)
    return left


def near_copy_groups(docs: DataFrame, words: int = 5, share: float = 0.8, bucket: int = 16) -> DataFrame:
    """(doc_id, text_sha256, root) for every row: rows with one root are copies or linked by near copies. Stored.

    Null texts count as empty; texts without words form one group. Equal texts are one group in any case.
    """
    percent = round(100 * share)
    rows = stored(wide_fingerprints(docs, words, share).withColumn("n", F.monotonically_increasing_id()), "wide")
    # One node for each text, under the number of one of its rows.
    texts = stored(rows.groupBy("text_sha256").agg(
        F.min("n").alias("n"), F.first("lanes").alias("lanes"), F.first("segments").alias("segments"), F.first("least").alias("least")).select(
        "n", "text_sha256", "lanes", "segments", "least"), "texts")
    held = shared_keys(texts.select("n", F.explode("segments").alias("key")))
    led = stored(_near(leader_pairs(held), texts), "led")
    crowd = stored(_ends(led), "crowd")
    fetched, _ = fetched_pairs(texts, crowd, bucket)
    pairs = stored(led.union(fetched).distinct(), "pairs")
    early = shared_early(rows.select("n", "early"))
    wanted = _ends(pairs).union(_enough(early, texts)).distinct()
    sets = shingle_sets(docs, stored(texts.join(wanted, "n").select("n", "text_sha256"), "wanted"), words)
    links = stored(verified(pairs, sets, percent), "links")
    roots = connected_components(links)
    # Equal texts have one node and no link between them; only nodes are asked for.
    left = unsettled(early.join(texts.select("n"), "n", "left_semi"), texts, roots)
    placed = sets.join(left, "n").join(roots.select(F.col("node").alias("n"), "root"), "n", "left").withColumn("root", F.coalesce("root", "n"))
    further = stored(verified(unlinked_pairs(stored(placed, "placed"), share).join(pairs, ["a", "b"], "left_anti"), sets, percent), "further")
    if not further.isEmpty():
        roots = connected_components(links.union(further))
    discard(held, led, fetched, pairs, early, crowd, sets, links, left, further)
    roots = roots.select(F.col("node").alias("n"), "root")
    by_text = stored(texts.join(roots, "n", "left").select("text_sha256", F.coalesce("root", "n").alias("root")), "by_text")
    return stored(rows.select("doc_id", "text_sha256").join(by_text, "text_sha256"), "groups")


def drop_near_copies(docs: DataFrame, words: int = 5, share: float = 0.8, bucket: int = 16) -> DataFrame:
    """One row of each group stays: that with the smallest doc_id, then the smallest digest. All columns stay.

    A row without a doc_id only stays where its whole group has none.
    """
    found = near_copy_groups(docs, words, share, bucket)
    counts = found.groupBy("root", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_sha256", "n")
    best = counts.groupBy("root").agg(F.min(first).alias("best"))
    winners = best.select("best.doc_id", "best.text_sha256", (F.col("best.n") > 1).alias("repeated"))
    return keep_winners(docs, stored(winners, "winners"))
