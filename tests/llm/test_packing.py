import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spotlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(tricky_rows):
    tokenizer, words = Tokenizer.from_file(PATH), packing.word_ids(PATH)
    draw = random.Random(3)
    odd = ["'S it's. x'll, don't're'", "é. É! é?", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "İx ΣΑΣ. ς", "12.5% 7,8.", "\x85a\xa0b\x1cc\x00d\x7f\xad", "ªµº²³¹¼½¾×÷ÀÞß"]
    odd += ["".join(chr(draw.choice([draw.randrange(256), draw.randrange(32, 127), 39, 32, 115])) for _ in range(50)) for _ in range(500)]
    for text in odd + [t or "" for _, t in tricky_rows]:
        want = tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert np.frombuffer(packing.token_bytes(text, words), "<u4").tolist() == want


def test_binary_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 12345):
        lengths = packing.binary_lengths(n)
        assert sum(lengths) == n and all(x <= 4096 and x & (x - 1) == 0 for x in lengths)
        assert sorted(lengths, reverse=True) == lengths and len({x for x in lengths if x < 4096}) == len([x for x in lengths if x < 4096])


def test_pack(spark, tricky, tricky_rows, tmp_path):
    words = packing.word_ids(PATH)
    out = packing.pack(tricky, PATH).collect()
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    want = sorted((zlib.crc32(packing.token_bytes(t, words)) for _, t in tricky_rows))
    parts, whole = {}, []
    for r in sorted(out, key=lambda r: (repr(r.doc_id), r.doc_tokens, r.start)):
        assert len(r.ids) == 4 * r.length
        parts.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(r.ids)
    for (doc_id, tokens, start), ids in parts.items():
        if start == 0:
            for n in range(len(ids)):
                text, at = b"", 0
                while at < tokens:
                    piece = parts[(doc_id, tokens, at)][n]
                    text, at = text + piece, at + len(piece) // 4
                whole.append(zlib.crc32(text))
    assert sorted(whole) == want
    packing.write_buckets(packing.pack(tricky, PATH), f"{tmp_path}/buckets")
    assert spark.read.parquet(f"{tmp_path}/buckets").count() == len(out)


def test_empty_table(empty):
    assert packing.pack(empty, PATH).collect() == []
