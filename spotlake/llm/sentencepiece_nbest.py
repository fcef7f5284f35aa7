"""N-best segmentation into pieces, and decoding.

The lattice of a text has an edge for every vocabulary piece that spells a stretch of it. A forward Viterbi pass gives
the best score of every prefix; these are exact, so a backward A* search that adds them to what it has collected from
the end takes complete paths off its agenda from best to worst. Pieces never reach over the start of a word (checked
when the vocabulary is read), so a text is a chain of small lattices; the best paths of the chain are found by the same
search over those words whose second path costs least.
"""

from __future__ import annotations

import heapq
import math
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spotlake.llm.memo import WORDS, Remembered

SPACE = "▁"
UNIT = 1_000_000  # scores are integers in millionths, so that sums are exact and ties are ties
BYTE_COST = 30 * UNIT  # score of a byte that stands for a letter outside the vocabulary, negated


class Pieces:
    """Vocabulary of a model file; a piece scores by its rank, as if piece frequencies followed Zipf's law."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.text: dict[int, bytes] = {}
        self.ids: dict[str, int] = {}
        self.scores: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        normal = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[3:5], 16)
                self.bytes[byte], self.text[i] = i, bytes([byte])
        for rank, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i))):
            piece = model.id_to_piece(i)
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece reaches over the start of a word")
            self.ids[piece], self.scores[piece] = i, -round(UNIT * math.log(rank + 2))
            self.text[i] = piece.replace(SPACE, " ").encode()
        self.chunk = _chunk_pattern(self.ids)
        self.known = {p for p in self.ids if len(p) == 1}
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.matcher.add_word(piece, (len(piece), self.scores[piece], (i,)))
        self.matcher.make_automaton()

    def spell(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def edges(self, word: str) -> list[tuple[int, int, int, tuple[int, ...]]]:
        """Edges (start, end, score, ids) of the lattice, by end; a letter outside the vocabulary is an edge of bytes."""
        edges = [(last + 1 - size, last + 1, score, ids) for last, (size, score, ids) in self.matcher.iter(word)]
        missing = () if self.known.issuperset(word) else [at for at, letter in enumerate(word) if letter not in self.scores]
        for at in missing:
            raw = word[at].replace(SPACE, " ").encode()
            edges.append((at, at + 1, -BYTE_COST * len(raw), tuple(self.bytes[b] for b in raw)))
        if missing:
            edges.sort(key=lambda e: e[1])
        return edges

    def best(self, word: str) -> tuple[list[int], int, float]:
        """(ids of the best path, its score, what the next path loses; infinite if there is none).

        Each place of the word holds the scores of the two best paths to it, so one forward pass gives both.
        """
        size = len(word)
        best, after, came = [0] + [-math.inf] * size, [-math.inf] * (size + 1), [None] * (size + 1)
        for start, end, score, ids in self.edges(word):
            total, top = best[start] + score, best[end]
            if total > top:
                onward = after[start] + score
                after[end] = onward if onward > top else top
                best[end], came[end] = total, (start, ids)
            elif total > after[end]:
                after[end] = total
        parts, at = [], size
        while at:
            at, ids = came[at]
            parts.append(ids)
        parts.reverse()
        return [i for ids in parts for i in ids], best[size], best[size] - after[size]

    def nbest(self, word: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best paths of a lattice as (score, ids), best first (backward A*).

        An agenda entry is a path from some place to the end, as a chain of edges. Of entries with equal hopes the
        newest goes first: a tie is followed to the beginning instead of being spread out.
        """
        edges = self.edges(word)
        best, _ = _forward(edges, len(word))
        into: list[list] = [[] for _ in range(len(word) + 1)]
        for start, end, score, ids in edges:
            into[end].append((start, score, ids))
        agenda, pushed, found = [(-best[-1], 0, len(word), 0, None)], 0, []
        while agenda and len(found) < n:
            _, _, at, collected, tail = heapq.heappop(agenda)
            if at == 0:
                path: list[int] = []
                while tail is not None:
                    path += tail[0]
                    tail = tail[1]
                found.append((collected, tuple(path)))
                continue
            for start, score, ids in into[at]:
                pushed -= 1
                heapq.heappush(agenda, (-(best[start] + score + collected), pushed, start, score + collected, (ids, tail)))
        return found


def _chunk_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Parts of a text that no piece reaches beyond: words with the spaces before them, cut further where that is safe.

    Letters of no longer piece stand alone. A mark that follows a letter in no piece begins a new part after a letter.
    """
    longer = [p for p in pieces if len(p) > 1]
    inside = {c for p in longer for c in p} - {SPACE}
    letters = {c for c in inside if c.isalpha()}
    after_letter = {b for p in longer for a, b in zip(p, p[1:], strict=False) if a in letters}
    marks = inside - letters - after_letter
    group = {name: "".join(map(re.escape, sorted(chars))) for name, chars in (("letters", letters), ("marks", marks), ("inside", inside))}
    cut = f"{SPACE}*[{group['letters']}]+(?=[{group['marks']}])|" if letters and marks else ""
    word = f"{SPACE}*[{group['inside']}]+|" if inside else ""
    return re.compile(f"{cut}{word}{SPACE}+|.", re.DOTALL)


def _forward(edges: list[tuple[int, int, int, tuple[int, ...]]], size: int) -> tuple[list, list]:
    """Viterbi: the best score of each prefix, and the last edge of a path that has it."""
    best, came = [0] + [-math.inf] * size, [None] * (size + 1)
    for edge in edges:
        total = best[edge[0]] + edge[2]
        if total > best[edge[1]]:
            best[edge[1]], came[edge[1]] = total, edge
    return best, came


class WordPaths(dict):
    """Numbers of words that a task has met, with their best paths in flat arrays by number.

    All words are forgotten between two texts once there are more than twice WORDS; speed only, never a different value.
    ``next`` remembers the following paths of the few words that are changed.
    """

    def __init__(self, pieces: Pieces, n: int):
        super().__init__()
        self.pieces, self.n = pieces, n
        self.piece_size = np.zeros(max(pieces.text, default=0) + 1, np.int64)
        for i, raw in pieces.text.items():
            self.piece_size[i] = len(raw)
        self.spelt = np.frombuffer(b"".join(pieces.text.get(i, b"") for i in range(len(self.piece_size))), np.uint8)
        self.spelt_at = np.cumsum(self.piece_size) - self.piece_size
        self.next = Remembered()
        self.next.make = self.others
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids, self.ends, self.scores, self.losses = array("I"), array("q", [0]), array("q"), array("d")

    def __missing__(self, word: str) -> int:
        ids, score, loss = self.pieces.best(word)
        self.ids.extend(ids)
        self.ends.append(len(self.ids))
        self.scores.append(score)
        self.losses.append(loss)
        number = self[word] = len(self)
        return number

    def others(self, word: str) -> list[tuple[int, list[int]]]:
        """(loss, ids) of up to n paths, the first of which loses nothing."""
        paths = self.pieces.nbest(word, self.n)
        return [(paths[0][0] - score, list(ids)) for score, ids in paths]


@lru_cache(maxsize=2)
def word_paths(path: str, n: int) -> WordPaths:
    return WordPaths(Pieces(path), n)


def chunks(text: str, pieces: Pieces) -> list[str]:
    """The parts of a text that are cut into pieces alone; a space is put before the text, spaces are written as ``▁``."""
    return pieces.chunk.findall(SPACE + text.replace(" ", SPACE)) if text else []


def encode_nbest(text: str, paths: WordPaths) -> list[tuple[int, bytes]]:
    """The best ``paths.n`` segmentations of a text as (score, ids), best first; an empty text has one, without ids."""
    return [(score, ids) for score, ids, _ in segmentations(text, paths)]


def segmentations(text: str, paths: WordPaths) -> list[tuple[int, bytes, bytes]]:
    """As ``encode_nbest``, as (score, ids, decoded bytes with the space put before the text).

    Any of them leaves the best path in fewer than n words, and these can be taken among the words whose next path
    loses least (at equal losses, the earlier ones); the paths of only these words are searched, and put in place of
    the best ones in the ids and in their bytes.
    """
    words = chunks(text, paths.pieces)
    if not words:
        return [(0, b"", b"")]
    if len(paths) > 2 * WORDS:
        paths.forget()
    number = np.fromiter(map(paths.__getitem__, words), np.int64, len(words))
    score = int(np.frombuffer(paths.scores, np.int64)[number].sum())
    losses = np.frombuffer(paths.losses, np.float64)[number]
    ends = np.frombuffer(paths.ends, np.int64)
    first, sizes = ends[number], ends[number + 1] - ends[number]
    starts = np.cumsum(sizes) - sizes
    best = _stretches(np.frombuffer(paths.ids, np.uint32), first, sizes)
    near = [at for at in _least(losses, paths.n - 1) if losses[at] < math.inf]
    options = [paths.next[words[at]] for at in near]
    agenda: list[tuple[int, tuple[int, ...]]] = [(0, (0,) * len(near))]
    seen, picks = {agenda[0][1]}, []
    while agenda and len(picks) < paths.n:
        loss, pick = heapq.heappop(agenda)
        picks.append((loss, pick))
        for i, choices in enumerate(options):
            step = (*pick[:i], pick[i] + 1, *pick[i + 1:])
            if step[i] < len(choices) and step not in seen:
                seen.add(step)
                heapq.heappush(agenda, (sum(o[k][0] for o, k in zip(options, step, strict=True)), step))
    ids, raw = best.astype("<u4").tobytes(), _stretches(paths.spelt, paths.spelt_at[best], paths.piece_size[best]).tobytes()
    places = sorted((int(starts[at]), int(sizes[at]), i) for i, at in enumerate(near))
    before = [int(paths.piece_size[best[:start]].sum()) for start, _, _ in places]
    length = [int(paths.piece_size[best[start:start + size]].sum()) for start, size, _ in places]
    out = []
    for loss, pick in picks:
        some_ids, some_raw, at_id, at_raw = [], [], 0, 0
        for (start, size, i), raw_start, raw_size in zip(places, before, length, strict=True):
            if pick[i]:
                other = options[i][pick[i]][1]
                some_ids += [ids[at_id:4 * start], struct.pack(f"<{len(other)}I", *other)]
                some_raw += [raw[at_raw:raw_start], paths.pieces.spell(other)]
                at_id, at_raw = 4 * (start + size), raw_start + raw_size
        out.append((score - loss, b"".join([*some_ids, ids[at_id:]]), b"".join([*some_raw, raw[at_raw:]])))
    return out


def _stretches(pool: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``pool``, given by first entry and size, one after the other."""
    starts = np.cumsum(sizes) - sizes
    return pool[np.repeat(first - starts, sizes) + np.arange(sizes.sum())]


def _least(values: np.ndarray, n: int) -> list[int]:
    """Places of the ``n`` least values, least first; of equal ones the earlier."""
    if n <= 0:
        return []
    if len(values) > n:
        border = np.partition(values, n - 1)[n - 1]
        below, equal = np.flatnonzero(values < border), np.flatnonzero(values == border)
        places = np.concatenate((below, equal[:n - len(below)]))
    else:
        places = np.arange(len(values))
    return places[np.lexsort((places, values[places]))].tolist()


def decode(ids: bytes, pieces: Pieces) -> str:
    """The text of ids, as little-endian 32-bit integers, without the space put before it."""
    return pieces.spell(struct.unpack(f"<{len(ids) // 4}I", ids)).decode(errors="replace")[1:]


def segment(docs: DataFrame, model: str, n: int = 3) -> DataFrame:
    """(doc_id, nth, score, n_pieces, ids, ids_crc32, decoded): the ``n`` best segmentations of every text.

    nth counts from 1; fewer come if the lattice has fewer paths. decoded tells whether decoding gives the text back.
    A null text counts as empty: one segmentation without pieces. Repeated rows are segmented each.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = word_paths(model, n)
        for part in parts:
            rows: list[tuple] = []
            held = 0
            for at in range(part.num_rows):
                text = part.column("text")[at].as_py() or ""
                for nth, (score, ids, raw) in enumerate(segmentations(text, paths), 1):
                    rows.append((at, nth, score / UNIT, len(ids) // 4, ids, zlib.crc32(ids), raw.decode(errors="replace")[1:] == text))
                    held += len(ids)
                if held >= 1 << 24:
                    yield _batch(part.column("doc_id"), rows)
                    rows, held = [], 0
            if rows:
                yield _batch(part.column("doc_id"), rows)

    return docs.select("doc_id", "text").mapInArrow(
        batches, f"doc_id {kind}, nth int, score double, n_pieces long, ids binary, ids_crc32 long, decoded boolean")


def _batch(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.int32(), pa.float64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
    arrays = [doc_ids.take(pa.array(columns[0], pa.int64())), *[pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True)]]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "nth", "score", "n_pieces", "ids", "ids_crc32", "decoded"])
