import random

import pytest

from spotlake.llm import near_copies
from tests.llm.brute import near_copies as brute


def edited(words, draw, n):
    out = list(words)
    for _ in range(n):
        out[draw.randrange(len(out))] = f"new{draw.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def copies():
    """Twelve texts with edited, cut and extended copies, a group of 120 near copies, and 60 unrelated texts."""
    draw = random.Random(8)
    rows = []
    for base in range(12):
        words = [f"w{draw.randrange(400)}" for _ in range(150)]
        rows.append(words)
        rows += [edited(words, draw, n) for n in (1, 2, 3, 6, 12)]
        rows += [words[:140], words + [f"x{i}" for i in range(10)], [w.upper() for w in words]]
        if base == 0:
            rows += [edited(words, draw, 1) for _ in range(120)]
    rows += [[f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 200))] for _ in range(60)]
    draw.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("bucket", [2, 16])
def test_groups_against_brute_force(spark, copies, bucket):
    docs = spark.createDataFrame(copies, "doc_id BIGINT, text STRING").repartition(4)
    out = near_copies.near_copy_groups(docs, bucket=bucket).collect()
    least = {}
    for r in out:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    got = {r.doc_id: least[r.root] for r in out}
    want = dict(zip([d for d, _ in copies], brute(copies), strict=True))
    assert all(want[d] == want[got[d]] for d in got)  # nothing is joined that brute force keeps apart
    pairs = [(d, want[d]) for d in want if want[d] != d]
    found = sum(got[a] == got[b] for a, b in pairs)
    assert len(pairs) > 150 and found >= 0.98 * len(pairs)


def test_pairs_in_a_template_group(spark):
    """Texts of one template that share about 0.7 of their shingles, each with one near copy that the leaders do not see."""
    draw = random.Random(5)
    texts = []
    for i in range(200):
        one = [f"w{k}" for k in range(330)] + [f"own{i}_{k}" for k in range(70)]
        two = list(one)
        for at in draw.sample(range(10, 390), 8):
            two[at] = f"new{i}_{at}"
        texts += [" ".join(one), " ".join(two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    root = {r.doc_id: r.root for r in near_copies.near_copy_groups(docs, bucket=2).collect()}
    want = [brute([(0, texts[i]), (1, texts[i + 1])]) == [0, 0] for i in range(0, 400, 2)]
    assert sum(want) > 150
    found = [root[i] == root[i + 1] for i in range(0, 400, 2)]
    assert found == want, f"{sum(found)} of {sum(want)} pairs"
    assert len(set(root.values())) == 400 - sum(want)


def test_near_copies_with_repeated_lines(spark):
    """Copies in which other lines are repeated, and more often, than in the first text; the sets of shingles are close."""
    draw = random.Random(6)
    texts = []
    for i in range(60):
        lines = [" ".join(f"t{i}_{k}_{j}" for j in range(10)) for k in range(25)]
        one, two = lines + 15 * [lines[3], lines[4]], lines + 15 * [lines[20], lines[21]]
        two[10] = " ".join(f"e{i}_{j}" for j in range(draw.randrange(1, 3)))
        texts += ["\n".join(one), "\n".join(two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    root = {r.doc_id: r.root for r in near_copies.near_copy_groups(docs).collect()}
    want = [brute([(0, texts[i]), (1, texts[i + 1])]) == [0, 0] for i in range(0, 120, 2)]
    found = sum(root[i] == root[i + 1] for i in range(0, 120, 2))
    assert all(want) and found >= 0.95 * len(want), f"{found} of {len(want)} pairs"
    assert len(set(root.values())) == 120 - found


def test_segments_cover_distinct_bits():
    values = near_copies._segments([-1] * near_copies.LANES)
    assert len(set(values)) == near_copies.SEGMENTS and max(values) < 2**62
    assert near_copies.LANES * 64 >= near_copies.WIDTH * near_copies.SEGMENTS


@pytest.mark.parametrize("bucket", [2, 16])
def test_every_pair_at_the_limit_among_full_values(spark, bucket):
    """A template with 300 texts that share 0.6 to 0.9: all links at 0.8 and more, by brute force, in full and half-full values."""
    draw = random.Random(bucket)
    base = [f"w{draw.randrange(300)}" for _ in range(160)]
    rows = [edited(base, draw, draw.choice([0, 1, 2, 3, 4, 5, 6])) for _ in range(240)]
    rows += [edited(draw.choice(rows), draw, draw.choice([1, 2, 3])) for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    root = {r.doc_id: r.root for r in near_copies.near_copy_groups(docs, bucket=bucket).collect()}
    want = brute(rows)
    assert all(want[a] == want[b] for a in root for b in root if root[a] == root[b])
    linked = [a for a in root if want[a] != a]
    found = sum(root[a] == root[want[a]] for a in linked)
    assert len(linked) > 100 and found >= 0.99 * len(linked), f"{found} of {len(linked)}"


def pairs_at_the_limit(draw):
    """200 texts of 20 to 60 words, each with a copy that shares exactly 0.8, or the next share above it; no two others are alike."""
    texts = []
    for i in range(200):
        words = [f"p{i}_{draw.randrange(10**6)}" for _ in range(draw.randrange(20, 60))]
        shingles = len(words) - 4
        texts += [" ".join(words), " ".join(words[:4 + -(-4 * shingles // 5)])]
    return texts


def test_pairs_at_the_limit_whose_fingerprints_do_not_meet(spark):
    texts = pairs_at_the_limit(random.Random(7))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(4)
    root = {r.doc_id: r.root for r in near_copies.near_copy_groups(docs).collect()}
    assert all(brute([(0, texts[i]), (1, texts[i + 1])]) == [0, 0] for i in range(0, 400, 2))
    found = sum(root[i] == root[i + 1] for i in range(0, 400, 2))
    assert found == 200 and len(set(root.values())) == 200, f"{found} of 200"


@pytest.mark.parametrize("bucket", [1, 16])
def test_nothing_is_left_out_when_no_fingerprints_meet(spark, monkeypatch, bucket):
    """All that leaders and balls find is dropped; the exact join alone gives the groups of brute force."""
    monkeypatch.setattr(near_copies, "_near", lambda pairs, texts: pairs.where("false"))
    draw = random.Random(bucket)
    base = [f"w{draw.randrange(300)}" for _ in range(160)]
    rows = [edited(base, draw, draw.choice([0, 1, 2, 3, 4, 5, 6])) for _ in range(80)]
    rows += [draw.choice(rows)[:draw.choice([130, 140, 150])] for _ in range(20)] + [["a"], ["a"], [], ["A"], ["a", "b", "c", "d", "e", "f"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += list(enumerate(pairs_at_the_limit(draw)[:100], len(rows)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    least = {}
    got = near_copies.near_copy_groups(docs, bucket=bucket).collect()
    for r in got:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    assert {r.doc_id: least[r.root] for r in got} == dict(zip([d for d, _ in rows], brute(rows), strict=True))


@pytest.mark.parametrize("share", [0.8, 0.5])
def test_early_shingles_of_near_sets_meet(share):
    draw = random.Random(9)
    for _ in range(4000):
        both, one, two = draw.randrange(1, 120), draw.randrange(0, 40), draw.randrange(0, 40)
        if both < share * (both + one + two):
            continue
        every = draw.sample(range(10**6), both + one + two)
        sets = [sorted(every[:both + one]), sorted(every[:both] + every[both + one:])]
        early = [set(near_copies.early_shingles(near_copies.np.array(s), share).tolist()) for s in sets]
        for s in sets:
            assert len(early[0] & early[1]) >= near_copies._met(near_copies._least_common(len(s), share), share) >= 1


def test_drop_keeps_one_row_of_each_group(tricky, tricky_rows):
    out = near_copies.drop_near_copies(tricky)
    assert out.columns == tricky.columns
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted(set(brute(tricky_rows)), key=repr)


def test_empty_table(empty):
    assert near_copies.near_copy_groups(empty).collect() == []
    assert near_copies.drop_near_copies(empty).collect() == []
