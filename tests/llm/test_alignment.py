import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spotlake.llm import alignment, queries

EXTRA = [
    (20, "two  spaces and\ttabs \n\n lines"), (21, " leading and trailing "), (22, "   "), (23, "a▁b has the mark"), (24, "<|endoftext|> <s> </s> <0x41> plain"),
    (25, "中文没有空格的文本 と日本語 한국어"), (26, "naïve\xa0no-break em　wide"), (27, "\x00 zero \x1f"), (28, "é combined é ﬁ"), (29, "don't we'll they're 3.14 100,000"),
    (30, "🙂🙂 🙂 emoji"), (31, "a" * 300 + " b"), (32, "x​y \u0085z"),
]


def brute(rows, kind="end"):
    a_model = Tokenizer.from_file(queries.BYTE_TOKENIZER)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    vocabulary = {i: t for t, i in json.load(open(queries.BYTE_TOKENIZER))["model"]["vocab"].items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}

    def a_bytes(i):
        return bytes(letters[c] for c in vocabulary[i])

    def b_bytes(i):
        piece = b_model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode()

    out = []
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            out.append([doc_id, 0, 0, [], ""])
            continue
        a_ends, b_ends = (np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b)))
        common = sorted({*a_ends} & {*b_ends})
        groups = []
        for lo, hi in zip([0, *common], common, strict=False):
            sides = [",".join(str(i) for i, e in zip(ids, ends, strict=True) if lo < e <= hi) for ids, ends in ((a, a_ends), (b, b_ends))]
            groups.append("|".join(sides))
        spans = [[(i, e - len(f(i)), e) for i, e in zip(ids, ends, strict=True)] for f, ids, ends in ((a_bytes, a, a_ends), (b_bytes, b, b_ends))]
        test = {"end": lambda x, y: x[2] == y[2], "overlap": lambda x, y: x[1] < y[2] and y[1] < x[2],
                "group": lambda x, y: sum(c < x[2] for c in common) == sum(c < y[2] for c in common)}[kind]
        out.append([doc_id, len(a), len(b), [(x[0], y[0]) for x in spans[0] for y in spans[1] if test(x, y)], ";".join(groups)])
    count = Counter(p for r in out for p in r[3])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return sorted(((d, a, b, g.count("|"), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for d, a, b, p, g in out), key=repr)


def test_query_against_brute_force(spark, tricky, tricky_rows, tmp_path):
    rows = [(d, t) for d, t in [*tricky_rows, *EXTRA]]
    docs = tricky.select("doc_id", "text").union(spark.createDataFrame(EXTRA, "doc_id BIGINT, text STRING"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in queries.op13_alignment(spark, str(tmp_path)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("kind", alignment.LINKS)
def test_kinds_of_links_and_groups(spark, monkeypatch, kind):
    monkeypatch.setattr(alignment, "_memory", alignment._memory.__wrapped__)
    rows = [r for r in EXTRA if len(r[1]) < 100]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    found = alignment.align_documents(docs, queries.BYTE_TOKENIZER, queries.PIECES, kind).collect()
    want = {r[0]: r for r in brute(rows, kind)}
    for r in found:
        assert (r.n_a, r.n_b, r.n_groups, sum(r.times)) == want[r.doc_id][1:5]
        assert (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 == want[r.doc_id][-1]


def test_row_products():
    draw = np.random.default_rng(2)
    for _ in range(20):
        x, y = draw.integers(0, 3, (7, 5)), draw.integers(0, 3, (5, 6))
        left, right = (alignment.Csr.of(*np.nonzero(np.ones_like(m)), m.shape) for m in (x, y))
        left = alignment.Csr(left.indptr, left.indices, x.ravel(), 5)
        right = alignment.Csr(right.indptr, right.indices, y.ravel(), 6)
        for product, dense in ((left.times(right), x @ y), (right.transposed().times(left.transposed()), (x @ y).T)):
            got = np.zeros(dense.shape, dtype=int)
            got[product.row_numbers(), product.indices] = product.data
            assert (got == dense).all()


def test_aligned_tokens_for_any_cuts():
    draw = random.Random(4)
    for _ in range(50):
        size = draw.randrange(1, 30)
        cuts = [sorted({size, *draw.sample(range(1, size + 1), draw.randrange(size))}) for _ in range(2)]
        a, b = (np.diff([0, *c]) for c in cuts)
        overlap = alignment.align(a, b, "overlap")
        want = {(i, j) for i, x in enumerate(cuts[0]) for j, y in enumerate(cuts[1]) if x - a[i] < y and y - b[j] < x}
        assert set(zip(overlap.left.tolist(), overlap.right.tolist(), strict=True)) == want
        end = alignment.align(a, b)
        assert [cuts[0][i] for i in end.left] == [cuts[1][j] for j in end.right] == sorted({*cuts[0]} & {*cuts[1]})


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_alignment(spark, str(tmp_path)).collect() == []
