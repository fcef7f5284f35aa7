"""MinHash near-duplicates: band candidates, b-bit signatures, and links confirmed over whole sets.

A text's set of shingles gets MINIMA minima of hash permutations. Bands of ROWS minima are candidate keys. Of every
minimum only the low BITS bits are kept, packed into integers; the matching ones of two signatures estimate the
similarity, corrected for those that match by chance, and drop candidates before any set is read.

Keys can be held by thousands of texts, so no pairs are made within a key. Every text meets the leader of its key, the
one whose keys are held most often, and verified links are closed transitively. A key whose texts are connected then is
done. The texts of all other keys go through an exact join of their sets (``set_join``), which pairs only texts
that are not connected yet. Both steps run at every size, whatever a key holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.components import connected_components
from spotlake.llm.set_join import unlinked_pairs, verified
from spotlake.llm.shingles import shingle_hashes, shingle_sets
from spotlake.llm.tables import checked_broadcast, discard, stored

MINIMA, ROWS, BITS = 128, 5, 2
BANDS = MINIMA // ROWS  # a pair at 0.85 shares none of 25 keys with probability 4e-7
MISS = 1e-9  # probability that the estimate drops a pair at the asked similarity
LANES = 64 // BITS
BLOCK = 2048
_DRAW = np.random.default_rng(42)
_MASKS = _DRAW.integers(0, 1 << 63, size=(MINIMA, 1), dtype=np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 63, size=(MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a set of 64-bit hashes, at least one; memory does not grow with the set."""
    least = None
    for at in range(0, len(hashes), BLOCK):
        part = ((hashes[None, at:at + BLOCK] ^ _MASKS) * _FACTORS).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    keys = [xxhash.xxh64_intdigest(least[b * ROWS:(b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, dtype="<u8").view("<i8").tolist()


def packed_bits(least: np.ndarray) -> list[int]:
    """The low BITS bits of all minima, LANES of them in each integer."""
    lanes = (least & np.uint64((1 << BITS) - 1)).reshape(-1, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(lanes, axis=1).view("<i8").tolist()


def least_matches(share: float) -> int:
    """How many of MINIMA signatures must match, so that a pair with ``share`` in common fails with at most MISS."""
    p, below = share + (1 - share) / (1 << BITS), 0.0
    for k in range(MINIMA + 1):
        below += math.comb(MINIMA, k) * p**k * (1 - p) ** (MINIMA - k)
        if below > MISS:
            return k
    return MINIMA


def estimate(x: Column, y: Column) -> Column:
    """Similarity of two packed signatures: the share of matching minima, less those that match by chance."""
    ones = F.lit(sum(1 << (BITS * i) for i in range(LANES)))

    def differing(a: Column, b: Column) -> Column:
        diff = a.bitwiseXOR(b)
        spread = diff
        for i in range(1, BITS):
            spread = spread.bitwiseOR(F.shiftrightunsigned(diff, i))
        return F.bit_count(spread.bitwiseAND(ones))

    apart = F.aggregate(F.zip_with(x, y, differing), F.lit(0), lambda s, v: s + v)
    chance = 1 / (1 << BITS)
    return ((F.lit(MINIMA) - apart) / MINIMA - chance) / (1 - chance)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, text_sha256, n_shingles, digest, bands, packed) for every row; a text without words has only n_shingles, 0."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, digests, bands, packed = [], [], [], []
            for text in part.column("text"):
                hashes = np.unique(shingle_hashes(text.as_py(), words))
                sizes.append(hashes.size)
                least = minima(hashes) if hashes.size else None
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()) if hashes.size else None)
                bands.append(None if least is None else band_keys(least))
                packed.append(None if least is None else packed_bits(least))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_sha256"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(packed, longs)],
                ["doc_id", "text_sha256", "n_shingles", "digest", "bands", "packed"])

    rows = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.mapInArrow(batches, f"doc_id {kind}, text_sha256 string, n_shingles long, digest binary, bands array<long>, packed array<long>")


def shared_keys(slots: DataFrame) -> DataFrame:
    """(key, n, held) of ``slots`` (key, n) whose key several texts hold. Stored."""
    sizes = stored(slots.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "sizes")
    return stored(slots.join(checked_broadcast(sizes), "key"), "held")


def leader_pairs(held: DataFrame) -> DataFrame:
    """(a, b), a > b: every text with the leader of each of its keys, the text whose keys are held most."""
    weight = held.groupBy("n").agg(F.sum("held").alias("weight"))
    first = held.join(weight, "n").groupBy("key").agg(F.max(F.struct("weight", "n")).alias("most")).select("key", F.col("most.n").alias("m"))
    met = held.join(stored(first, "leaders"), "key").where("n <> m")
    return met.select(F.greatest("n", "m").alias("a"), F.least("n", "m").alias("b")).distinct()


def unsettled(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(n, root) of the texts that share a key with a text they are not connected to. Stored."""
    placed = stored(held.select("key", "n").join(roots.select(F.col("node").alias("n"), "root"), "n", "left").select("key", "n", F.coalesce("root", "n").alias("root")), "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    return stored(placed.join(mixed, "key", "left_semi").select("n", "root").distinct(), "unsettled")


def text_components(texts: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) of the texts (n, text_sha256, bands, packed) that are linked with others. Stored."""
    share = percent / 100
    held = shared_keys(texts.select("n", F.explode("bands").alias("key")))
    bits = texts.select("n", "packed")
    pairs = stored(leader_pairs(held), "pairs")
    near = pairs.join(bits.select(F.col("n").alias("a"), F.col("packed").alias("x")), "a").join(bits.select(F.col("n").alias("b"), F.col("packed").alias("y")), "b")
    chance = 1 / (1 << BITS)
    floor = (least_matches(share) / MINIMA - chance) / (1 - chance)
    near = stored(near.where(estimate(F.col("x"), F.col("y")) >= floor - 1e-9).select("a", "b"), "near")
    every = stored(texts.join(held.select("n").distinct(), "n").select("n", "text_sha256"), "wanted")
    sets = shingle_sets(docs, every, words)
    links = stored(verified(near, sets, percent), "links")
    roots = connected_components(links)
    left = unsettled(held, roots)
    more = unlinked_pairs(stored(sets.join(left, "n"), "left"), share)
    further = stored(verified(more.join(near, ["a", "b"], "left_anti"), sets, percent), "further")
    if not further.isEmpty():
        roots = connected_components(links.union(further))
    discard(held, pairs, near, every, sets, links, more, further)
    return roots


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if 100 * shingles in common >= percent * shingles of the union; component_id is the smallest
    doc_id that can be reached. Texts without words (null, empty, blank) are linked with nothing, not with each
    other either. Repeated rows stay. A null doc_id is passed over in the minimum and is never kept; component_id is null
    only where the whole group has no doc_id. Other columns are ignored.
    """
    rows = stored(signatures(docs, words), "signatures")
    one = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("text_sha256").alias("text_sha256"), F.first("bands").alias("bands"), F.first("packed").alias("packed"), F.min("doc_id").alias("least_id"))
    texts = stored(one.withColumn("n", F.monotonically_increasing_id()), "texts")
    roots = text_components(texts, docs, words, percent)
    placed = stored(texts.select("n", "digest", "least_id").join(roots.withColumnRenamed("node", "n"), "n", "left").select(
        "digest", "least_id", F.coalesce("root", "n").alias("root")), "placed")
    groups = placed.groupBy("root").agg(F.min("least_id").alias("component"))
    classes = stored(placed.join(groups, "root").select("digest", "component"), "classes")
    found = rows.select("doc_id", "n_shingles", "digest").join(checked_broadcast(classes), "digest", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
