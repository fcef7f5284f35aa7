"""Token counts by a linear longest-match automaton.

A greedy word-piece tokenizer takes the longest vocabulary entry at each place of a word. The automaton is the trie
of the vocabulary with failure links: a failure link leads to the state after the longest entries at the left end of
what has been read are popped, and each link carries the number of popped pieces. A word is read once, byte by byte,
and only counts are added up; no piece is built.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spotlake.llm.memo import Remembered

NONE = -1


class LongestMatch:
    """Counts greedy pieces of a word; ``first`` are entries for the start of a word, ``inner`` for all other places.

    With ``bare``, a word that begins with no entry of ``first`` takes an empty piece, the space before it, and goes
    on with ``inner`` from its first byte.
    """

    def __init__(self, first: set[bytes], inner: set[bytes], bare: bool = False):
        self.step: list[dict[int, int]] = [{}, {}]  # state 0: start of a word, state 1: after a piece
        ends = [False, False]
        parent: list[tuple[int, int]] = [(NONE, 0), (NONE, 0)]
        for root, entries in ((0, first), (1, inner)):
            for entry in entries:
                at = root
                for byte in entry:
                    after = self.step[at].get(byte)
                    if after is None:
                        after = len(self.step)
                        self.step[at][byte] = after
                        self.step.append({})
                        ends.append(False)
                        parent.append((at, byte))
                    at = after
                if at != root:
                    ends[at] = True
        size = len(self.step)
        self.link, self.popped = [NONE] * size, [0] * size
        if bare:
            self.link[0], self.popped[0] = 1, 1
        queue = deque([*self.step[0].values(), *self.step[1].values()])
        while queue:  # by depth: the link of a state needs those of its parent and of shallower states
            at = queue.popleft()
            queue.extend(self.step[at].values())
            if ends[at]:
                self.link[at], self.popped[at] = 1, 1
                continue
            above, byte = parent[at]
            to, count = self.link[above], self.popped[above]
            while to != NONE and byte not in self.step[to]:
                to, count = self.link[to], count + self.popped[to]
            if to != NONE:
                self.link[at], self.popped[at] = self.step[to][byte], count

    def count(self, word: bytes) -> int:
        """Number of greedy pieces; 0 if the word cannot be cut into entries."""
        at, pieces, step, link, popped = 0, 0, self.step, self.link, self.popped
        for byte in word:
            while byte not in step[at]:
                pieces += popped[at]
                at = link[at]
                if at == NONE:
                    return 0
            at = step[at][byte]
        while at != 1:  # the end of a word: pop until nothing is left
            if at == NONE or at == 0:
                return 0
            pieces += popped[at]
            at = link[at]
        return pieces


class WordCounts(Remembered):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.make = automaton.count


def read_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """(entries at the start of a word, entries elsewhere) of a file of base64 entries and ranks.

    An entry that begins with a space belongs to the start of a word, without the space; entries with other
    white space are left out, as words have none.
    """
    first, inner = set(), set()
    with open(path, "rb") as lines:
        for line in lines:
            entry = base64.b64decode(line.split()[0])
            body = entry.removeprefix(b" ")
            if body and body.split() == [body]:
                (first if body is not entry and len(body) < len(entry) else inner).add(body)
    return first, inner


def has_bare_space(path: str) -> bool:
    """Whether the space alone is an entry of the file."""
    with open(path, "rb") as lines:
        return any(base64.b64decode(line.split()[0]) == b" " for line in lines)


@lru_cache(maxsize=2)
def word_counts(path: str, bare: bool = False) -> WordCounts:
    return WordCounts(LongestMatch(*read_vocabulary(path), bare=bare and has_bare_space(path)))


def count_tokens(docs: DataFrame, vocabulary: str, bare: bool = False) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_unknown) for every row; a word is a run without U+0020 and U+0009 to U+000D.

    A word that cannot be cut into entries counts as one token and one unknown word. A null or empty text has no
    words. Repeated rows are counted each; other columns are ignored. ``vocabulary`` is a path on every machine. With
    ``bare``, the entry that is the space alone may begin a word: every word is cut as its space and itself would be, so
    a vocabulary with all single bytes leaves no word unknown.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = word_counts(vocabulary, bare)
        for part in parts:
            columns: tuple[list[int], ...] = ([], [], [])
            for text in part.column("text"):
                each = list(map(counts.__getitem__, (text.as_py() or "").encode().split()))
                unknown = each.count(0)
                for column, value in zip(columns, (len(each), sum(each) + unknown, unknown), strict=True):
                    column.append(value)
            arrays = [part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")
