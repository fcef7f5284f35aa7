import pytest

from spotlake.llm import exact_dedup
from tests.llm.brute import sha


def expected(rows):
    best, size = {}, {}
    for d, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max([best[t], d] if t in best else [d], key=lambda v: -1 if v is None else v)
    return sorted(((d, best[t or ""], size[t or ""], sha(t)) for d, t in rows), key=repr)


@pytest.mark.parametrize("cell_bits", [56, 6, 2])
@pytest.mark.parametrize("block", [1024, 3])
def test_all_texts(spark, tricky, tricky_rows, block, cell_bits):
    """Small cells make many values share one, so that names must be numbered inside cells."""
    docs = tricky if block > 3 else tricky.where("length(coalesce(text, '')) < 200")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = exact_dedup.exact_duplicates(docs, block, cell_bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out), key=repr) == expected(rows)
    assert sum(r.kept for r in out) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_same_blocks_in_another_order(spark):
    texts = ["abcabd", "abdabc", "abcabc", "abc", "abcabcabc", "abcabcabcabc", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    found = exact_dedup.identities(docs, block=3, cell_bits=2).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(texts[r.doc_id] or "", set()).add(r.identity)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({v for s in by_text.values() for v in s}) == len(by_text)


def test_drop_keeps_one_row_and_all_columns(tricky, tricky_rows):
    out = exact_dedup.drop_exact_duplicates(tricky)
    assert out.columns == tricky.columns
    texts = [r.text or "" for r in out.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in tricky_rows})


def test_empty_table(empty):
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty).collect() == []
