import zlib

import corpus_pipeline
from spotlake.llm import packing, quality_rules
from spotlake.llm.queries import TOKENIZER
from tests.llm.brute import near_copies, quality, secrets, sha


def test_stages_against_brute_force(spark, tmp_path):
    words = [f"w{k * k % 389}" for k in range(900)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words[i * 20:i * 20 + 60])))
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # exact copies
    rows += [(200 + i, rows[i][1].upper()) for i in range(10, 13)]  # near copies
    rows += [(300, " ".join(words[:30]) + " token=abcdefgh12"), (301, "too short"), (302, None), (303, ""), (304, "spam " * 60)]
    rows += [(305, rows[20][1]), (305, rows[20][1])]
    docs = spark.createDataFrame([(d, t, "en", "src", len(t or "")) for d, t in rows], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(d, t) for d, t in rows if not quality(t)["base_failed"]]
    best = {}
    for d, t in kept:
        best[t] = max(best.get(t, d), d)
    kept = [(d, t) for t, d in best.items()]
    kept = [(d, t) for (d, t), least in zip(kept, near_copies(kept), strict=True) if d == least]
    masked = []
    for d, t in kept:
        for s, _, _, e in reversed(secrets(t)):
            t = t[:s] + "[SECRET]" + t[e:]
        masked.append((d, t))
    ids = packing.word_ids(TOKENIZER)
    want = []
    for d, t in masked:
        every, start = packing.token_bytes(t, ids), 0
        for n in packing.binary_lengths(len(every) // 4):
            want.append((d, start, n, zlib.crc32(every[4 * start:4 * (start + n)]), len(every) // 4))
            start += n
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == sorted(want)
    assert len({sha(t) for _, t in masked}) == len(masked) and len(want) > 30


def test_stages_take_empty_and_tricky_tables(spark, tricky, tmp_path):
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality_rules.SAMPLE == 20_000
    for docs in (tricky, tricky.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "packing":
                assert out.columns == docs.columns
            out.collect()
