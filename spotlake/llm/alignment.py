"""Cross-tokenizer alignment by products of token-byte incidence matrices.

Two tokenizers cut the same bytes. Each gives a sparse matrix, tokens by bytes, in compressed rows. The row product
``A . Bt`` (Gustavson) has an entry wherever a token of A and one of B share bytes: the overlap links, with their byte
counts. The same product over the last bytes alone gives the pairs that end together, and over the groups between
common ends, tokens by groups, all pairs of a group.

A text is cut at single spaces between other characters. No token of either vocabulary reaches over such a cut, which
``Tokenizers`` checks, so a word is aligned once while a task remembers it; words that are met first are
aligned together, as one block-diagonal matrix.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotlake.llm.memo import Remembered
from spotlake.llm.packing import _BYTE_LETTERS
from spotlake.llm.tables import discard, stored

CUT = re.compile(r" (?<=\S )(?=\S)")
SPACE = "▁"
CHUNK = 8 << 20  # letters of text whose links share one dictionary
TOGETHER = 1 << 20  # letters of text whose new words are aligned together
LINKS = ("end", "overlap", "group")


@dataclass(frozen=True)
class Csr:
    """A sparse matrix in compressed rows; ``data`` holds counts."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    columns: int

    @staticmethod
    def of(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int]) -> Csr:
        """From entries in any order; equal ones are added up."""
        cell, data = np.unique(rows.astype(np.int64) * max(shape[1], 1) + columns, return_counts=True)
        row, column = np.divmod(cell, max(shape[1], 1))
        return Csr(np.searchsorted(row, np.arange(shape[0] + 1)), column, data, shape[1])

    def row_numbers(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        return Csr(np.searchsorted(self.indices[order], np.arange(self.columns + 1)), self.row_numbers()[order], self.data[order], len(self.indptr) - 1)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: each entry (i, k) adds row k of ``other`` to row i, for all rows at once."""
        first, many = other.indptr[self.indices], np.diff(other.indptr)[self.indices]
        entry = np.repeat(np.arange(len(self.indices)), many)
        taken = first[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
        cell = self.row_numbers()[entry].astype(np.int64) * max(other.columns, 1) + other.indices[taken]
        cells, place = np.unique(cell, return_inverse=True)
        data = np.bincount(place, weights=self.data[entry] * other.data[taken], minlength=len(cells)).astype(np.int64)
        row, column = np.divmod(cells, max(other.columns, 1))
        return Csr(np.searchsorted(row, np.arange(len(self.indptr))), column, data, other.columns)


def incidence(lengths: np.ndarray) -> Csr:
    """Tokens by bytes of tokens that follow each other."""
    return Csr(np.concatenate(([0], np.cumsum(lengths))), np.arange(lengths.sum()), np.ones(lengths.sum(), dtype=np.int64), int(lengths.sum()))


def last_bytes(matrix: Csr) -> Csr:
    """Only the last byte of each token that has bytes."""
    some = np.flatnonzero(np.diff(matrix.indptr))
    return Csr.of(some, matrix.indices[matrix.indptr[some + 1] - 1], (len(matrix.indptr) - 1, matrix.columns))


@dataclass(frozen=True)
class Aligned:
    """Links (tokens of A, tokens of B) of one kind in order, and the group of every token."""

    left: np.ndarray
    right: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray


def align(a_lengths: np.ndarray, b_lengths: np.ndarray, kind: str = "end") -> Aligned:
    """Align two token sequences of the same bytes, given the byte length of each token (at least one)."""
    a, b = incidence(a_lengths), incidence(b_lengths)
    ends = last_bytes(a).times(last_bytes(b).transposed())
    common = np.cumsum(a_lengths)[ends.row_numbers()]  # byte offsets at which both end, rising
    a_group = np.searchsorted(common, np.cumsum(a_lengths))
    b_group = np.searchsorted(common, np.cumsum(b_lengths))
    if kind == "end":
        links = ends
    elif kind == "overlap":
        links = a.times(b.transposed())
    else:
        by_group = [Csr.of(np.arange(len(g)), g, (len(g), len(common))) for g in (a_group, b_group)]
        links = by_group[0].times(by_group[1].transposed())
    return Aligned(links.row_numbers(), links.indices, a_group, b_group)


class Tokenizers:
    """A byte-level BPE file (A, given a space before the text) and a piece model with byte fallback (B, which adds one)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = {chr(c): b for b in range(256) for c in [_BYTE_LETTERS.get(b, b)]}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for entry, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array(list(map(len, names)), dtype=np.int64) for names in (self.a_bytes, self.b_bytes)]
        self.texts = list(map(str, range(max(len(self.a_bytes), len(pieces)))))
        if any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece reaches over the space between two words")

    def __call__(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids by A and by B of each word (without the space before it)."""
        a = self.a.encode_batch([" " + w for w in words], add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(a, self.b.encode(words, num_threads=1), strict=True)]


Word = tuple[str, int, bytes | None]  # group text; tokens of A << 32 | tokens of B; linked id pairs, None if the bytes differ
DIFFERENT: Word = ("", 0, None)


def _words(found: list[tuple[list[int], list[int]]], texts: list[str], tokens: Tokenizers, kind: str) -> list[Word]:
    """Align many words at once, as the blocks of one matrix. Words whose bytes A or B do not keep are DIFFERENT."""
    sizes = np.array([1 + len(t.encode()) for t in texts], dtype=np.int64)
    sides = []
    for side, names in ((0, tokens.a_bytes), (1, tokens.b_bytes)):
        each = [x[side] for x in found]
        ids = list(chain.from_iterable(each))
        sides.append((ids, b"".join(map(names.__getitem__, ids)), tokens.sizes[side][ids], np.cumsum(list(map(len, each)), dtype=np.int64)))
    whole = (" " + " ".join(texts)).encode()
    byte_ends = [np.concatenate(([0], np.cumsum(lengths)))[ends] for _, _, lengths, ends in sides]
    if not all(raw == whole for _, raw, _, _ in sides) or any((ends != np.cumsum(sizes)).any() for ends in byte_ends):
        good = [b"".join([tokens.a_bytes[i] for i in a]) == b" " + t.encode() == b"".join([tokens.b_bytes[i] for i in b])
                for t, (a, b) in zip(texts, found, strict=True)]
        kept = iter(_words([f for f, ok in zip(found, good, strict=True) if ok], [t for t, ok in zip(texts, good, strict=True) if ok], tokens, kind) if any(good) else [])
        return [next(kept) if ok else DIFFERENT for ok in good]
    (a_ids, _, a_lengths, a_ends), (b_ids, _, b_lengths, b_ends) = sides
    aligned = align(a_lengths, b_lengths, kind)
    links = np.column_stack((np.array(a_ids)[aligned.left], np.array(b_ids)[aligned.right])).astype("<u4").tobytes()
    link_ends = np.searchsorted(aligned.left, a_ends) * 8
    groups = _group_texts(list(map(tokens.texts.__getitem__, a_ids)), list(map(tokens.texts.__getitem__, b_ids)), aligned)
    group_ends = aligned.a_group[a_ends - 1] + 1
    out: list[Word] = []
    first = [0, 0, 0, 0]
    for last in zip(a_ends.tolist(), b_ends.tolist(), group_ends.tolist(), link_ends.tolist(), strict=True):
        out.append((";".join(groups[first[2]:last[2]]), (last[0] - first[0]) << 32 | (last[1] - first[1]), links[first[3]:last[3]]))
        first = last
    return out


def _group_texts(a_ids: list[str], b_ids: list[str], aligned: Aligned) -> list[str]:
    """``a1,a2|b1`` of each group."""
    sides = []
    for text, group in ((a_ids, aligned.a_group), (b_ids, aligned.b_group)):
        ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group)).tolist()
        sides.append([text[x] if y == x + 1 else ",".join(text[x:y]) for x, y in zip([0, *ends], ends, strict=False)])
    return [f"{x}|{y}" for x, y in zip(*sides, strict=True)]


class WordMemory(Remembered):
    """Aligned words; those of a batch that are not remembered are aligned together."""

    def __init__(self, tokens: Tokenizers, kind: str):
        super().__init__()
        self.tokens, self.kind, self.fresh = tokens, kind, {}

    def make(self, word: str) -> Word:
        return self.fresh.get(word) or _words(self.tokens([word]), [word], self.tokens, self.kind)[0]

    def meet(self, texts: list[list[str]]) -> None:
        """Align what is new in ``texts``. It makes many small objects and no cycles, so the collector waits."""
        new = list(set().union(*texts).difference(self, self.old))
        collects = gc.isenabled()
        gc.disable()
        try:
            self.fresh = dict(zip(new, _words(self.tokens(new), new, self.tokens, self.kind), strict=True)) if new else {}
        finally:
            if collects:
                gc.enable()


@lru_cache(maxsize=2)
def _memory(a_path: str, b_path: str, kind: str) -> WordMemory:
    return WordMemory(Tokenizers(a_path, b_path), kind)


def align_documents(docs: DataFrame, a_path: str, b_path: str, kind: str = "end", groups: bool = True) -> DataFrame:
    """(doc_id, chunk, n_a, n_b, n_groups, groups, groups_sha256, a, b, times) for every row of ``docs``.

    ``groups`` is text (null if not asked for): ids of A and of B in each group, as ``a1,a2|b1;a3|b2``. ``a``, ``b`` and
    ``times`` are the distinct linked id pairs and how often the document has them; ``kind`` is end (both end at the same
    byte), overlap (they share a byte) or group (they are in one group). Null and empty texts, and those whose bytes A or B
    do not keep, have no tokens: zeros, empty arrays, empty texts. ``chunk`` names neighbouring rows of a task with about
    CHUNK letters. Repeated rows stay, a null doc_id stays null; other columns are ignored. Paths hold on every machine.
    """
    if kind not in LINKS:
        raise ValueError(f"kind must be one of {LINKS}")
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(a_path, b_path, kind)
        chunk, held = TaskContext.get().partitionId() << 32, 0
        for part in parts:
            for first, texts in _slices(part.column("text")):
                memory.meet(texts)
                yield _batch(part.column("doc_id").slice(first, len(texts)), [(chunk, *_document(words, memory, groups)) for words in texts])
                held += sum(len(w) for words in texts for w in words)
                if held >= CHUNK:
                    chunk, held = chunk + 1, 0

    schema = (f"doc_id {doc_id}, chunk long, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, "
              "a array<int>, b array<int>, times array<int>")
    return docs.select("doc_id", "text").mapInArrow(batches, schema)


NOTHING = (0, 0, 0, "", "", (np.zeros(0, np.int32),) * 3)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[list[str]]]]:
    """(number of the first text, words of each text), for about TOGETHER letters at a time."""
    first, held, out = 0, 0, []
    for at, text in enumerate(texts):
        text = text.as_py() or ""
        out.append(CUT.split(text) if text else [])
        held += len(text)
        if held >= TOGETHER:
            yield first, out
            first, held, out = at + 1, 0, []
    if out:
        yield first, out


def _document(parts: list[str], memory: WordMemory, groups: bool) -> tuple:
    if not parts:
        return NOTHING
    texts, sizes, links = zip(*map(memory.__getitem__, parts), strict=True)
    if None in links:
        return NOTHING
    joined, size = ";".join(texts), sum(sizes)
    code, times = np.unique(np.frombuffer(b"".join(links), dtype="<u8"), return_counts=True)
    pairs = code.view("<u4").reshape(-1, 2).astype(np.int32)
    return (size >> 32, size & 0xFFFFFFFF, joined.count(";") + 1, joined if groups else None, hashlib.sha256(joined.encode()).hexdigest(),
            (pairs[:, 0], pairs[:, 1], times.astype(np.int32)))


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    chunk, n_a, n_b, n_groups, groups, digest, links = zip(*rows, strict=True)
    sizes = np.concatenate(([0], np.cumsum([len(x[0]) for x in links]))).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([x[i] for x in links]))) for i in range(3)]
    longs = [pa.array(c, pa.int64()) for c in (chunk, n_a, n_b, n_groups)]
    return pa.RecordBatch.from_arrays(
        [doc_ids, *longs, pa.array(groups, pa.string()), pa.array(digest, pa.string()), *lists],
        ["doc_id", "chunk", "n_a", "n_b", "n_groups", "groups", "groups_sha256", "a", "b", "times"])


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, count, best) of every linked id pair of the corpus, best if no other pair of its ``b`` has more, and the
    pairs (chunk, a, b) of each chunk. Both stored."""
    pairs = aligned.select("chunk", F.explode(F.arrays_zip("a", "b", "times")).alias("x"))
    inside = stored(pairs.groupBy("chunk", F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.sum("x.times").alias("times")), "chunk-pairs")
    counts = stored(inside.groupBy("a", "b").agg(F.sum("times").alias("count")), "pairs")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return stored(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "counts"), inside


def score_documents(aligned: DataFrame) -> DataFrame:
    """``aligned`` (stored, of ``align_documents``) with n_links, n_best and count_sum for every row.

    n_links counts linked occurrences, n_best those whose pair is (one of) the most counted of its id of B in all
    documents, count_sum adds up the counts of their pairs. Every chunk gets the counts of its own pairs and nothing else,
    so that no task holds the counts of the whole corpus.
    """
    counts, inside = pair_counts(aligned)
    wanted = stored(inside.join(counts, ["a", "b"]).select("chunk", "a", "b", "count", "best"), "wanted")
    discard(inside)
    kept = aligned.select("doc_id", "chunk", "n_a", "n_b", "n_groups", "groups", "groups_sha256", "a", "b", "times")
    kind = aligned.schema["doc_id"].dataType.simpleString()

    def codes(table: pa.Table) -> np.ndarray:
        a, b = (table.column(c).to_numpy().astype(np.int64) for c in ("a", "b"))
        return a << 32 | b

    def score(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        code = codes(known)
        order = np.argsort(code)
        code, count, best = code[order], known.column("count").to_numpy()[order], known.column("best").to_numpy()[order]
        flat = {c: np.concatenate([x.flatten().to_numpy() for x in rows.column(c).chunks] or [np.zeros(0)]).astype(np.int64) for c in ("a", "b", "times")}
        place = np.searchsorted(code, flat["a"] << 32 | flat["b"])
        sizes = np.concatenate([x.value_lengths().to_numpy() for x in rows.column("a").chunks])
        owner = np.repeat(np.arange(rows.num_rows), sizes)
        sums = [_sums(owner, flat["times"] * w, rows.num_rows) for w in (np.int64(1), best[place].astype(np.int64), count[place])]
        out = rows.select(["doc_id", "n_a", "n_b", "n_groups", "groups", "groups_sha256"])
        for name, values in zip(("n_links", "n_best", "count_sum"), sums, strict=True):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups string, groups_sha256 string, n_links long, n_best long, count_sum long"
    return kept.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(score, schema)


def _sums(owner: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, owner, values)
    return out
