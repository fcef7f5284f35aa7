import base64
import random

from spotlake.llm import queries, token_counts
from spotlake.llm.queries import VOCABULARY


def greedy(word, first, inner):
    at = n = 0
    while at < len(word):
        entries = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in entries), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_automaton_against_greedy_matching():
    draw = random.Random(1)
    for _ in range(300):
        def entries(draw=draw):
            return {bytes(draw.choices(b"abc", k=draw.randrange(1, 6))) for _ in range(draw.randrange(1, 14))}
        first, inner = entries(), entries()
        automaton = token_counts.LongestMatch(first, inner)
        for _ in range(60):
            word = bytes(draw.choices(b"abcd", k=draw.randrange(1, 14), cum_weights=[10, 20, 30, 31]))
            assert automaton.count(word) == greedy(word, first, inner)


def test_count_tokens(tricky, tricky_rows):
    first, inner = token_counts.read_vocabulary(VOCABULARY)
    longest = max(map(len, first | inner))

    def brute(text):
        words = (text or "").encode().split()
        counts = []
        for w in words:
            at = n = 0
            while at < len(w):
                end = next((e for e in range(min(len(w), at + longest), at, -1) if w[at:e] in (inner if at else first)), None)
                if end is None:
                    n = 0
                    break
                at, n = end, n + 1
            counts.append(n)
        return len(words), sum(max(c, 1) for c in counts), counts.count(0)

    out = token_counts.count_tokens(tricky, VOCABULARY).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_tokens, r.n_unknown) for r in out), key=repr) == sorted(((d, *brute(t)) for d, t in tricky_rows), key=repr)


def test_words_are_cut_with_their_space(spark, tmp_path):
    with open(VOCABULARY, "rb") as lines:
        entries = {base64.b64decode(line.split()[0]) for line in lines}
    longest = max(map(len, entries))

    def pieces(word):
        word, at, n = b" " + word, 0, 0
        while at < len(word):
            at, n = next(e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in entries), n + 1
        return n

    texts = ["\u0441\u0435\u0433\u043e\u0434\u043d\u044f \u043f\u0440\u0438\u0432\u0435\u0442", "\u4e2d" * 10000, "\uc548\ub155 \u0e44\u0e17\u0e22 \U0001f600 plain words, and\u4e2d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in queries.op1_token_counts(spark, str(tmp_path)).collect()}
    assert out == {i: (len(t.split()), sum(pieces(w.encode()) for w in t.split()), 0) for i, t in enumerate(texts)}
    assert out[1][1] > 10000


def test_bare_space_against_greedy_matching():
    draw = random.Random(2)
    for _ in range(200):
        first, inner = ({bytes(draw.choices(b"abc", k=draw.randrange(1, 6))) for _ in range(draw.randrange(1, 14))} for _ in range(2))
        automaton = token_counts.LongestMatch(first, inner, bare=True)
        for _ in range(60):
            word = bytes(draw.choices(b"abcd", k=draw.randrange(1, 14), cum_weights=[10, 20, 30, 31]))
            if any(word.startswith(f) for f in first):
                assert automaton.count(word) == greedy(word, first, inner)
            else:
                rest = greedy(word, inner, inner)
                assert automaton.count(word) == (rest and rest + 1)


def test_empty_table(empty):
    assert token_counts.count_tokens(empty, VOCABULARY).collect() == []
