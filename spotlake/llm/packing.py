"""Packing by power-of-two decomposition.

The ids of a document are cut into pieces whose lengths are powers of two: as many of the longest length as fit,
then one for each binary digit of the rest. A piece is a sequence of its own, so nothing is padded and no sequence
crosses documents; sequences of one length form a bucket, from which a trainer draws batches of equal token count.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotlake.llm.memo import Remembered

MAX_TOKENS = 4096
END_ID = 2
# How the tokenizer cuts lower-case text before its merges, for U+0000 to U+00FF: letters, one digit,
# 's 't 're 've 'm 'll 'd, other marks.
_LETTER = "a-zA-Zªµºß-öø-ÿÀ-ÖØ-Þ"
_NUMBER = "0-9²³¹¼½¾"
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0"
_CUT = re.compile(f"[{_LETTER}]+|[{_NUMBER}]|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{_LETTER}{_NUMBER}]+")

# The letter that stands for a byte in the vocabulary: itself if it is visible, else the next one from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_LETTERS = {b: 256 + n for n, b in enumerate(_HIDDEN)}


def _little_endian(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(Remembered):
    """Ids of words between spaces, by the pieces that the tokenizer merges alone; made by its model when first asked for."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def make(self, word: str) -> bytes:
        pieces = _CUT.findall(word)
        if pieces != [word]:
            return b"".join(map(self.__getitem__, pieces))
        letters = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return _little_endian([t.id for t in self.model.tokenize(letters)])

    def of_text(self, text: str) -> bytes:
        """The same ids as ``tokenizer.encode(text, add_special_tokens=False)``.

        Texts within U+0000 to U+00FF are in normal form and change case letter by letter, so they are cut here;
        others, and those that may hold a special token, are left to the tokenizer.
        """
        if "<|" not in text and (text.isascii() or _latin(text)):
            return b"".join(map(self.__getitem__, text.lower().split(" ")))
        return _little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_bytes(text: str | None, words: WordIds, end_id: int = END_ID) -> bytes:
    """All ids of a text, then ``end_id``, as little-endian unsigned 32-bit integers."""
    return words.of_text(text or "") + _little_endian([end_id])


def binary_lengths(tokens: int, longest: int = MAX_TOKENS) -> list[int]:
    """Powers of two, longest first, that add up to ``tokens``; ``longest`` is a power of two."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, longest: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): one row for each piece, which is a sequence.

    ``ids`` holds little-endian unsigned 32-bit integers. A null text counts as empty: one piece with the end id.
    Repeated rows are packed each. Sequences of one length have ids in one range, from exponent * 2^56 on. One
    pass without a shuffle; ``tokenizer`` is a path on every machine.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    fields = ["doc_id", "start", "length", "doc_tokens", "ids"]
    kind = docs.schema["doc_id"].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer)
        for part in parts:
            ids, held = part.column("doc_id"), 0
            rows: list[tuple] = []
            for n in range(part.num_rows):
                every = token_bytes(part.column("text")[n].as_py(), words, end_id)
                tokens, start = len(every) // 4, 0
                for length in binary_lengths(tokens, longest):
                    rows.append((n, start, length, tokens, every[4 * start:4 * (start + length)]))
                    start += length
                held += len(every)
                if held >= 1 << 24:
                    yield _batch(ids, rows, fields)
                    rows, held = [], 0
            if rows:
                yield _batch(ids, rows, fields)

    pieces = docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, ids binary")
    exponent = F.char_length(F.bin("length")).cast("long") - 1
    return pieces.select(*fields, (F.shiftleft(exponent, 56) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def _batch(doc_ids: pa.Array, rows: list[tuple], fields: list[str]) -> pa.RecordBatch:
    at, *columns = zip(*rows, strict=True)
    arrays = [doc_ids.take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, fields)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with one folder for each length, so that a trainer reads one bucket at a time."""
    pieces.write.partitionBy("length").parquet(path)
