"""Shingles of words as 64-bit hashes, and the sets of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotlake.llm.simhash import LOWER, SEED
from spotlake.llm.tables import checked_broadcast, stored


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of every shingle of lower-cased words (fewer words: the whole sequence; none: no hash)."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    if len(parts) <= words:
        spans = [(0, len(joined))]
    else:
        spans = zip(np.concatenate(([0], ends[:-1] + 1)).tolist(), ends[words - 1:].tolist(), strict=False)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(n, size, hashes): whole sets of the texts in ``wanted`` (n, text_sha256), a stored table. Stored.

    A text without words has the one hash 0.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seen: dict[int, np.ndarray] = {}
            for n, text in zip(part.column("n").to_pylist(), part.column("text"), strict=True):
                if n not in seen:
                    hashes = np.unique(shingle_hashes(text.as_py(), words)).view("<i8")
                    seen[n] = hashes if hashes.size else np.zeros(1, dtype="<i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array([s.size for s in seen.values()], pa.int64()), pa.array(list(seen.values()), pa.list_(pa.int64()))],
                ["n", "size", "hashes"])

    body = docs.select("text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).join(checked_broadcast(wanted), "text_sha256")
    return stored(body.select("n", "text").mapInArrow(batches, "n long, size long, hashes array<long>").dropDuplicates(["n"]), "sets")
