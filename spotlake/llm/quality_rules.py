"""Quality rules as a learned decision list; DataFrame functions only.

Statistics of a text are Spark expressions. Sequential covering learns from labelled statistics: a rule grows by
the threshold that gains most, is pruned on held-out rows, and takes what it covers out of the table; the counts
behind each choice are one Spark aggregation. The list becomes an ordered chain of conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotlake.llm.tables import WORD, stored

SAMPLE = 20_000  # labelled rows that are learned from, at most
CUTS = 32  # thresholds tried for each feature
BLANK_RUN = r"[\x20\x09-\x0D]+"
WINDOW = 8


def _bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _pair(hashes: Column, reach: int) -> Column:
    """The hash of each element and the one ``reach`` places later (null beyond the end)."""
    return _bind(hashes, lambda h: F.zip_with(h, F.slice(h, reach + 1, F.size(h) - reach), lambda a, b: F.xxhash64(a, b)))


def _repeat_words(words: Column) -> Column:
    """Words that lie in an eight-word window that occurs twice or more; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _bind(by_hash, lambda s: F.transform(
            F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda x: x["i"]))
        return _bind(F.sort_array(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for reach in (1, 2, 4):  # a window of twice the width is a pair of windows
        hashes = _pair(hashes, reach)
    hashes = F.slice(hashes, 1, F.size(words) - (WINDOW - 1))
    found = _bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) >= WINDOW, found).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words are those of the contract; n_lines counts lines
    with a word, n_upper counts A-Z.
    """
    text = F.coalesce(text, F.lit(""))
    by_words = _bind(F.array_remove(F.split(text, BLANK_RUN, -1), ""), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = _bind(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    return _bind(F.struct(by_words.alias("w"), by_lines.alias("l")), lambda s: F.struct(
        *[s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")], *[s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")],
        count(r"[#*$%&|<>]").alias("n_symbols"), count("[A-Z]").alias("n_upper")))


# Feature name, numerator, denominator. A feature of an empty text is 0.
FEATURES = (
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbols_per_word", "n_symbols", "n_words"),
    ("dup_lines", "n_dup_lines", "n_lines"), ("repeated_words", "n_repeat_words", "n_words"), ("upper", "n_upper", "word_chars"),
    ("words_per_line", "n_words", "n_lines"),
)


def features(stats: Column) -> list[Column]:
    def ratio(top: str, under: str | None) -> Column:
        return stats[top].cast("double") if under is None else F.coalesce(F.try_divide(stats[top].cast("double"), stats[under].cast("double")), F.lit(0.0))

    return [ratio(top, under).alias(name) for name, top, under in FEATURES]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > cut, else feature <= cut
    cut: float

    def holds(self, place: str = "") -> Column:
        """Whether the condition holds; ``place`` is the struct with the features, empty where they are columns."""
        value = F.col(place).getField(self.feature) if place else F.col(self.feature)
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _holds(rule: Rule, place: str = "") -> Column:
    out = F.lit(True)
    for condition in rule:
        out = out & condition.holds(place)
    return out


def _any_holds(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | _holds(rule)
    return out


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, max_rules: int = 8, max_conditions: int = 3,
                precision: float = 0.95, support: int = 10) -> list[Rule]:
    """Rules that mark bad texts (quality 0), in the order in which they are tried.

    ``sample`` bounds the labelled rows: those with the least hash of doc_id, the same at every run. Rows without a
    quality or a doc_id are passed over; repeated labels count each. Without labelled rows of both kinds there is no
    rule. A rule is taken while its held-out precision and its held-out hits reach ``precision`` and ``support``.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", (F.col("quality") == 0).alias("bad"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "bad").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "bad", statistics(F.col("text")).alias("s"))
    names = [f[0] for f in FEATURES]
    held_out = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(3)) == 0
    values = stored(rows.select("bad", held_out.alias("held_out"), *features(F.col("s"))), "labelled").coalesce(2)
    grid = values.agg(*[F.percentile(n, [(i + 0.5) / CUTS for i in range(CUTS)]).alias(n) for n in names]).first()
    cuts = {n: sorted(set(grid[n] or ())) for n in names}
    # From here a feature is the number of its cuts below the value, and a condition compares that number.
    place = {n: sum((F.when(F.col(n) > c, 1).otherwise(0) for c in cuts[n]), F.lit(0)) for n in names}
    table = stored(values.select("bad", "held_out", *[place[n].alias(n) for n in names]), "binned")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        left = table.where(~_any_holds(rules))
        rule = _grow(left.where("NOT held_out"), names, max_conditions)
        if rule:
            rule = _prune(left.where("held_out"), rule, precision, support)
        if not rule:
            break
        rules.append(rule)
    return [tuple(Condition(c.feature, c.above, cuts[c.feature][int(c.cut)]) for c in rule) for rule in rules]


def _grow(rows: DataFrame, names: list[str], most: int) -> Rule:
    """Add the condition with the largest gain until no good row is covered, none gains, or there are ``most``."""
    rule: Rule = ()
    while len(rule) < most:
        stacked = rows.where(_holds(rule)).select("bad", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("bin")) for n in names])))
        counts = stacked.groupBy("feature", "bin").agg(F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
        best = _best_condition({(r.feature, r.bin): (r.bad, r.good) for r in counts}, names)
        if best is None:
            break
        rule += (best,)
    return rule


def _best_condition(counts: dict[tuple[str, int], tuple[int, int]], names: list[str]) -> Condition | None:
    """Largest information gain; ``counts`` has (bad, good) for each feature and bin, so at most CUTS + 1 for a feature."""
    all_bad, all_good = (sum(v[i] for (n, _), v in counts.items() if n == names[0]) for i in (0, 1))
    if not all_bad or not all_good:
        return None
    before = math.log2(all_bad / (all_bad + all_good))
    best, found = 1e-9, None
    for n in names:
        bad = good = 0
        for cut in range(CUTS):
            b, g = counts.get((n, cut), (0, 0))
            bad, good = bad + b, good + g
            for above, b, g in ((False, bad, good), (True, all_bad - bad, all_good - good)):
                gain = b * (math.log2(b / (b + g)) - before) if b else 0.0
                if gain > best:
                    best, found = gain, Condition(n, above, cut)
    return found


def _prune(rows: DataFrame, rule: Rule, precision: float, support: int) -> Rule:
    """The beginning of ``rule`` with the best (bad - good) / (bad + good) on held-out rows; none if that is too poor."""
    tries = [rule[:k] for k in range(1, len(rule) + 1)]
    counts = [F.count_if(_holds(t) & (F.col("bad") == F.lit(b))).alias(f"n{k}{b}") for k, t in enumerate(tries) for b in (True, False)]
    seen = rows.agg(*counts).first()
    score, bad, k = max(((seen[2 * k] - seen[2 * k + 1]) / max(1, seen[2 * k] + seen[2 * k + 1]), seen[2 * k], -k) for k in range(len(tries)))
    return tries[-k] if (score + 1) / 2 >= precision and bad >= support else ()


def judge(docs: DataFrame, rules: list[tuple[Condition, ...]], columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` of every row with its statistics, base_failed, rule (number of the first rule that holds) and kept.

    A text fails the base if it has under 20 words or more than 30 in 100 words repeat; a null text has no words.
    """
    own = docs.select(F.struct(*[F.col(c) for c in columns]).alias("own"), statistics(F.col("text")).alias("stats"))
    counted = own.select("own", "stats", F.struct(*features(F.col("stats"))).alias("features"))
    rule = F.lit(None).cast("int")
    for number in range(len(rules), 0, -1):
        rule = F.when(_holds(rules[number - 1], "features"), F.lit(number)).otherwise(rule)
    failed = (F.col("stats.n_words") < 20) | (100 * F.col("stats.n_repeat_words") > 30 * F.col("stats.n_words"))
    counted = counted.select("own", "stats", rule.alias("rule"), failed.alias("base_failed"))
    return counted.select(
        *[F.col("own").getField(c).alias(c) for c in columns], *[F.col("stats").getField(c).alias(c) for c in STATISTICS],
        "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def drop_low_quality(docs: DataFrame, rules: list[tuple[Condition, ...]]) -> DataFrame:
    """The rows of ``docs`` that pass the base and every rule, with all columns."""
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("document"), "text")
    kept = judge(whole, rules, ("document",)).where("kept")
    return kept.select(*[F.col("document").getField(c).alias(c) for c in docs.columns])
