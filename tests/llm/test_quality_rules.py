import pytest

from spotlake.llm import quality_rules
from tests.llm.brute import quality


def test_statistics(spark, tricky, tricky_rows):
    more = ["a b c d e f g h a b c d e f g h", "a b c d e f g h " * 2 + "x " * 30, " ".join(map(str, range(30))), "l1\n\nl1\n \nl2\nl1"]
    rows = [t for _, t in tricky_rows] + more
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id BIGINT, text STRING")
    for r in quality_rules.judge(docs, []).collect():
        want = quality(rows[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.kept == (not r.base_failed)


@pytest.fixture(scope="module")
def labelled(spark):
    """Bad texts have symbols, or long words; a few labels are wrong, null, repeated or without a document."""
    rows = []
    for i in range(600):
        words = [f"w{(i * 7 + k * k) % 997}" for k in range(40)]
        if i % 3 == 0:
            words = [w + "$$" for w in words]
        elif i % 7 == 0:
            words = [w * 6 for w in words]
        rows.append((i, " ".join(words)))
    labels = [(i, 0 if i % 3 == 0 or i % 7 == 0 else 1, 0) for i in range(600)]
    labels += [(5, None, 0), (None, 1, 0), (9000, 0, 0), (8, 1, 1)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), spark.createDataFrame(labels, "doc_id BIGINT, quality INT, toxic INT")


def test_rules_are_learned_and_emitted(labelled):
    docs, labels = labelled
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and rules == quality_rules.learn_rules(docs.repartition(5), labels.repartition(3))
    out = {r.doc_id: r for r in quality_rules.judge(docs, rules).collect()}
    wrong = [i for i in range(600) if out[i].kept != (i % 3 != 0 and i % 7 != 0)]
    assert len(wrong) <= 12
    assert quality_rules.drop_low_quality(docs, rules).count() == sum(r.kept for r in out.values())


def test_no_rule_without_both_labels(labelled, empty):
    docs, labels = labelled
    assert quality_rules.learn_rules(docs, labels.where("quality = 1")) == []
    assert quality_rules.learn_rules(docs, labels.where("false")) == []
    assert quality_rules.learn_rules(empty, labels) == []
    assert quality_rules.judge(empty, []).collect() == []


def test_all_columns_stay(tricky):
    out = quality_rules.drop_low_quality(tricky.withColumnRenamed("names", "stats").withColumnRenamed("spans", "rule"), [])
    assert out.columns == ["doc_id", "text", "row", "stats", "rule", "text_sha256"]


def test_columns_named_like_features_go_along(spark):
    docs = spark.createDataFrame([(1, "a b c", 7, "x", True)], "doc_id BIGINT, text STRING, words INT, rule STRING, n_words BOOLEAN")
    rules = [(quality_rules.Condition("words", False, 5.0),)]
    out = quality_rules.judge(docs, rules, ("doc_id", "words"))
    assert out.select("doc_id", "words", "rule", "kept").first() == (1, 7, 1, False)
    assert quality_rules.judge(docs, rules, ("doc_id", "rule")).collect()[0][:2] == (1, "x")
    assert quality_rules.drop_low_quality(docs, []).columns == docs.columns
