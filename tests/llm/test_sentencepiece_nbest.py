import struct
from functools import lru_cache

import pytest

from spotlake.llm import sentencepiece_nbest as sp
from spotlake.llm.queries import PIECES


@pytest.fixture(scope="module")
def paths():
    return sp.word_paths(PIECES, 3)


def all_scores(word, pieces):
    """Scores of all segmentations of a short string, best first."""
    @lru_cache(None)
    def ways(at):
        if at == len(word):
            return (0,)
        out = []
        for end in range(at + 1, len(word) + 1):
            part = word[at:end]
            score = pieces.scores.get(part)
            if score is None and end == at + 1:
                score = -sp.BYTE_COST * len(part.replace("▁", " ").encode())
            if score is not None:
                out += [score + rest for rest in ways(end)]
        return tuple(out)

    return sorted(ways(0), reverse=True)


@pytest.mark.parametrize("text", ["hello", "hello to you", "a b", "  x", "né 中", "ab\ncd", "\U0001f600 in", "aaaaaaaa", "the the"])
def test_nbest_against_all_segmentations(paths, text):
    lattice = "▁" + text.replace(" ", "▁")
    want = all_scores(lattice, paths.pieces)
    got = sp.encode_nbest(text, paths)
    assert [s for s, _ in got] == want[:3]
    assert len({ids for _, ids in got}) == len(got)
    scores = {i: s for p, i in paths.pieces.ids.items() for s in [paths.pieces.scores[p]]}
    for score, ids in got:
        assert sp.decode(ids, paths.pieces) == text
        numbers = struct.unpack(f"<{len(ids) // 4}I", ids)
        assert sum(scores.get(i, -sp.BYTE_COST) for i in numbers) == score


def test_best_and_next_loss(paths):
    for word in ("▁international", "▁segmentation", "▁xqz", "▁", "▁▁▁▁a", "▁naïveté", "x" * 20000, "ab" * 3000, "\n" * 500):
        ids, score, loss = paths.pieces.best(word)
        found = paths.pieces.nbest(word, 2)
        assert found[0][0] == score
        assert (len(found) == 1 and loss == float("inf")) or found[0][0] - found[1][0] == loss


def test_segment(tricky, tricky_rows, paths):
    out = sp.segment(tricky, PIECES, 3).collect()
    assert all(r.decoded for r in out)
    want = sorted(((d, nth, round(s / sp.UNIT, 6), len(ids) // 4) for d, t in tricky_rows for nth, (s, ids) in enumerate(sp.encode_nbest(t or "", paths), 1)), key=repr)
    assert sorted(((r.doc_id, r.nth, round(r.score, 6), r.n_pieces) for r in out), key=repr) == want


def test_empty_table(empty):
    assert sp.segment(empty, PIECES, 2).collect() == []
