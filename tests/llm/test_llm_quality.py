import collections
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from edge import edge_table, sentence, texts  # noqa: E402

from attest.llm import quality  # noqa: E402


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            failed)


def test_counts_match_brute_force(spark):
    rows = texts() + [(20, "a b a b a b c a b", None), (21, "x y z q x y z\nx y z\n\nx y z", "s"),
                      (22, sentence(30, 3) + " # $$ <p> " + sentence(40, 3), None)]
    got = quality.judge(edge_table(spark, rows), []).collect()
    seen = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                   for r in got), key=repr)
    assert seen == sorted(((i, *brute(t)) for i, t, _ in rows), key=repr)
    assert all(r.kept != r.base_failed and r["rule"] is None for r in got)


def test_rules_are_learned_pruned_and_applied(spark):
    good = [(i, sentence(60 + i, i), None) for i in range(120)]
    bad = [(1000 + i, " ".join(w + "$$$" for w in sentence(60 + i, i + 500).split()), None) for i in range(60)]
    bad += [(2000 + i, sentence(60 + i, i + 900).upper() + "!" * 40, None) for i in range(60)]
    docs = edge_table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _, _ in good + bad] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert 1 <= len(rules) <= quality.MOST_RULES
    kept = {r.doc_id for r in quality.judge(docs, rules).where("kept").collect()}
    assert kept == set(range(120))
    passed = quality.passing(docs, rules)
    assert passed.columns == docs.columns and {r.doc_id for r in passed.collect()} == kept


def test_no_labels_no_rules(spark):
    docs = edge_table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.fit(docs, none) == [] and quality.judge(edge_table(spark, []), []).collect() == []


def test_pruning_drops_a_condition_that_only_fits_the_growing_rows():
    rule = (quality.Condition(2, True, 0.5), quality.Condition(1, True, 3.0))
    row = [0.0] * len(quality.FEATURES)
    bad = [(0.0, 1.0, 1.0, *row[3:])] * 10
    assert quality._pruned(rule, bad, [tuple(row)] * 10) == rule[:1]
