import random

import numpy as np
import pytest

from spotlake.llm import minhash, set_join
from spotlake.llm.tables import stored
from tests.llm.brute import LOWER, WORD, components


def brute(rows, k=5, percent=85):
    sets = []
    for _, t in rows:
        words = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(words[i:i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    roots = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b))
    least = {}
    for (d, _), r in zip(rows, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    found = [(d, len(s), least.get(r)) if s else (d, 0, d) for (d, _), s, r in zip(rows, sets, roots, strict=True)]
    return sorted(((d, n, c, d is not None and d == c) for d, n, c in found), key=repr)


def mutated(draw, words, n):
    words = list(words)
    for at in draw.sample(range(len(words)), n):
        words[at] = f"w{draw.randrange(10**6)}"
    return words


def corpus(seed):
    """Texts around a few templates, some of the same length, with changes that make pairs above, at and below the limit."""
    draw = random.Random(seed)
    rows = []
    for size in (150, 148, 60, 23):
        base = [f"t{draw.randrange(500)}" for _ in range(size)]
        for _ in range(45):
            words = mutated(draw, base, draw.choice([0, 1, 1, 2, 3, 4, 6]))
            rows.append(words[:draw.choice([size, size, size - 3])])
        for _ in range(12):
            rows.append(mutated(draw, draw.choice(rows[-30:]), draw.choice([1, 2])))
    rows += [["x"], ["x"], ["y", "z"], [f"u{i}" for i in range(400)]]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_against_brute_force(spark, tricky, tricky_rows):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    assert shown(minhash.near_duplicates(docs)) == brute(rows)
    assert shown(minhash.near_duplicates(tricky)) == brute(tricky_rows)


def test_empty_table(empty):
    assert minhash.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("share", [85, 50])
def test_set_join_loses_no_pair(spark, share):
    """All pairs of different roots above the limit are candidates, whatever the roots are."""
    draw = random.Random(share)
    sets, roots = [], []
    for _ in range(6):
        base = [draw.randrange(400) for _ in range(draw.choice([5, 30, 80]))]
        for _ in range(30):
            drop = draw.randrange(1 + len(base) // 4)
            sets.append(sorted({*draw.sample(base, len(base) - drop), *[draw.randrange(10**5) for _ in range(draw.randrange(1 + len(base) // 5))]}))
            roots.append(draw.choice([-1, -2, len(sets)]))
    table = stored(spark.createDataFrame([(i, len(s), r, s) for i, (s, r) in enumerate(zip(sets, roots, strict=True))], "n BIGINT, size BIGINT, root BIGINT, hashes ARRAY<BIGINT>"), "sets")
    found = set_join.unlinked_pairs(table, share / 100)
    got = {tuple(r) for r in set_join.verified(found, table, share).collect()}
    want = {(i, j) for i in range(len(sets)) for j in range(i)
            if roots[i] != roots[j] and 100 * len({*sets[i]} & {*sets[j]}) >= share * len({*sets[i]} | {*sets[j]})}
    assert got == want and len(want) > 50


def test_estimates(spark):
    draw = np.random.default_rng(1)
    rows = []
    for shared in (0, 100, 300, 600):
        a, b = draw.integers(0, 1 << 62, (2, 600), dtype=np.uint64)
        b[:shared] = a[:shared]
        rows.append((shared / (1200 - shared), minhash.packed_bits(minhash.minima(a)), minhash.packed_bits(minhash.minima(b))))
    df = spark.createDataFrame(rows, "truth DOUBLE, x ARRAY<BIGINT>, y ARRAY<BIGINT>")
    for r in df.select("truth", minhash.estimate(df.x, df.y).alias("got")).collect():
        assert abs(r.truth - r.got) < 0.17
    assert minhash.least_matches(1.0) == minhash.MINIMA and 85 < minhash.least_matches(0.85) < 100
