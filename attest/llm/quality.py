"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditional expressions.

Statistics of each text are DataFrame expressions. On a bounded sample of labelled rows the driver learns rules for
low quality: a rule grows by the threshold condition with the highest information gain until it covers no good row,
is pruned back on rows that were held out, and joins the list if it is precise enough there; what it covers is
set aside and the next rule is learned. The list becomes one ``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import let, words_of, written

#: Labelled rows that the rules are learned from.
SAMPLE = 4000
MOST_RULES, MOST_CONDITIONS = 12, 4
#: A rule must be right on this share of the held-out rows that it covers, and cover so many rows in all.
PRECISION, LEAST_COVERED = 0.95, 5
FEATURES = ["n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share",
            "marks_per_word", "digit_share"]


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that the text holds twice or more."""
    n = F.size(words)

    def count(hashes: Column) -> Column:
        # Windows sorted by hash: a repeated one has an equal neighbour. Each covers three words, less what the
        # next one covers.
        paired = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(paired, lambda s: F.sort_array(F.transform(
            F.filter(F.sequence(F.lit(0), n - 3), lambda j: F.coalesce(
                (F.get(s, j)["h"] == F.get(s, j - 1)["h"]), F.lit(False)) | F.coalesce(
                (F.get(s, j)["h"] == F.get(s, j + 1)["h"]), F.lit(False))),
            lambda j: F.get(s, j)["i"])))
        covered = let(repeated, lambda p: F.aggregate(
            F.transform(p, lambda at, k: F.least(F.lit(3), F.get(p, k + 1) - at)), F.lit(0), lambda a, b: a + b))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)

    windows = F.transform(F.sequence(F.lit(0), n - 3),
                          lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 3, 0).otherwise(let(windows, count)).cast("long")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def statistics(text: Column) -> Column:
    """A struct of counts over the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), _count(text, "[#*$%&|<>]").alias("n_symbols"),
                    _count(text, "[A-Z]").alias("n_upper"), _count(text, "[!?]").alias("n_marks"),
                    _count(text, "[0-9]").alias("n_digits"))


def with_statistics(docs: DataFrame, text_col: str = "text", into: str = "_stats") -> DataFrame:
    """``docs`` with a struct column of counts, shares and the base verdict."""
    s = docs.withColumn("_raw", statistics(F.col(text_col)))
    raw, words, lines = F.col("_raw"), F.col("_raw.words"), F.col("_raw.lines")
    n = words["n_words"]

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    return s.withColumn(into, F.struct(
        n.alias("count_words"), words["word_chars"].alias("word_chars"), raw["n_symbols"].alias("n_symbols"),
        lines["n_dup_lines"].alias("n_dup_lines"), words["n_repeat_words"].alias("n_repeat_words"),
        ((n < 50) | (100 * words["n_repeat_words"] > 50 * n)).alias("base_failed"),
        n.cast("double").alias("n_words"), share(words["word_chars"], n).alias("chars_per_word"),
        share(raw["n_symbols"], n).alias("symbols_per_word"),
        share(lines["n_dup_lines"], lines["n_lines"]).alias("dup_line_share"),
        share(words["n_repeat_words"], n).alias("repeat_share"),
        share(raw["n_upper"], words["word_chars"]).alias("upper_share"),
        share(raw["n_marks"], n).alias("marks_per_word"),
        share(raw["n_digits"], words["word_chars"]).alias("digit_share"))).drop("_raw")


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, row: tuple) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature]} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, row: tuple) -> bool:
    return all(c.holds(row) for c in rule)


def _thresholds(bad: list[float], good: list[float]) -> list[float]:
    """Cuts between neighbouring values of different classes, where the best ones are; 24 of them, at equal steps."""
    kinds: dict[float, int] = {}
    for kind, values in ((1, bad), (2, good)):
        for value in values:
            kinds[value] = kinds.get(value, 0) | kind
    distinct = sorted(kinds)
    cuts = [(a + b) / 2 for a, b in zip(distinct, distinct[1:]) if kinds[a] != kinds[b] or kinds[a] == 3]
    return sorted({*cuts[::max(1, math.ceil(len(cuts) / 24))], *cuts[-1:]})


def _grow(bad: list[tuple], good: list[tuple]) -> Rule:
    rule: Rule = ()
    while good and len(rule) < MOST_CONDITIONS:
        before = math.log2(len(bad) / (len(bad) + len(good)))
        best, found = 1e-9, None
        for feature in range(len(FEATURES)):
            for threshold in _thresholds([row[feature] for row in bad], [row[feature] for row in good]):
                for above in (True, False):
                    condition = Condition(feature, above, threshold)
                    p = sum(map(condition.holds, bad))
                    if p:
                        gain = p * (math.log2(p / (p + sum(map(condition.holds, good)))) - before)
                        if gain > best:
                            best, found = gain, condition
        if found is None:
            break
        rule += (found,)
        bad, good = list(filter(found.holds, bad)), list(filter(found.holds, good))
    return rule


def _pruned(rule: Rule, bad: list[tuple], good: list[tuple]) -> Rule:
    """The shortest head of the rule with the best worth on held-out rows."""
    def worth(head: Rule) -> float:
        p, n = (sum(_covers(head, row) for row in rows) for rows in (bad, good))
        return (p - n) / (p + n) if p + n else -1.0
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(rows: list[tuple]) -> list[Rule]:
    """Rules for low quality from ``(feature values..., quality)`` rows; none if a class is missing."""
    grow, hold = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    split = {(name, q): [r[:-1] for r in part if r[-1] == q] for name, part in (("grow", grow), ("hold", hold))
             for q in (0, 1)}
    bad, held = split["grow", 0], split["hold", 0]
    rules: list[Rule] = []
    while bad and split["grow", 1] and len(rules) < MOST_RULES:
        rule = _pruned(_grow(bad, split["grow", 1]), held, split["hold", 1])
        p = sum(_covers(rule, row) for row in bad + held)
        n = sum(_covers(rule, row) for row in split["grow", 1] + split["hold", 1])
        if not rule or p < LEAST_COVERED or p < PRECISION * (p + n):
            break
        rules.append(rule)
        bad, held = ([row for row in part if not _covers(rule, row)] for part in (bad, held))
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        quality_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Learn from ``sample`` labelled rows, the first in order of a hash of the id, that pass the base rules."""
    labels = labels.where(F.col(quality_col).isin(0, 1) & F.col(id_col).isNotNull())
    picked = (labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(quality_col).alias("_quality"))
              .orderBy(F.xxhash64("_id"), "_id").limit(sample))
    # At most ``sample`` ids: the bound of this broadcast.
    rows = written(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(
        F.broadcast(picked), F.col("_doc") == F.col("_id")), "sample")  # else the filter below moves before the join
    judged = with_statistics(rows, "_text").where(~F.col("_stats.base_failed"))
    kept = judged.select(*[F.col(f"_stats.{f}") for f in FEATURES], "_quality", "_id").collect()
    ordered = sorted(kept, key=lambda r: (hash_order(r["_id"]), r["_id"]))
    return learn([tuple(r)[:-1] for r in ordered])


def hash_order(value: object) -> int:
    """A fixed shuffling order, so that held-out rows don't follow the order of ids."""
    from zlib import crc32
    return crc32(str(value).encode())


def verdict(rules: list[Rule], stats: Column) -> Column:
    """The number of the first rule that holds, from 1; null where none does."""
    out = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            value = stats[FEATURES[c.feature]]
            holds = holds & (value > c.threshold if c.above else value <= c.threshold)
        out = F.when(holds, number) if out is None else out.when(holds, number)
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None)).cast("int")


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``rule`` (the first that rejects, else null) and ``kept`` for every row.

    A null, empty or blank text has no words and fails the base rules. Repeated rows are judged alike; a null id
    stays null. An empty table gives no rows; other columns are not read.
    """
    rows = with_statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), "_text")
    s = F.col("_stats")
    return rows.select(
        "doc_id", s["count_words"].alias("n_words"), s["word_chars"].alias("word_chars"),
        s["n_symbols"].alias("n_symbols"), s["n_dup_lines"].alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"), s["base_failed"].alias("base_failed"),
        (~s["base_failed"] & verdict(rules, s).isNull()).alias("kept"), verdict(rules, s).alias("rule"))


def passing(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Null, empty and blank texts have fewer words than the base asks for and go. Repeated rows go or stay together. An
    empty table gives no rows.
    """
    name = "_stats"
    while name in docs.columns or name == text_col:
        name += "_"
    rows = with_statistics(docs, text_col, name)
    kept = ~F.col(name)["base_failed"] & verdict(rules, F.col(name)).isNull()
    return rows.where(kept).select(*docs.columns)
