import itertools
import random
import re
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge import edge_table, sentence, texts  # noqa: E402

from attest.llm.neardup import K, deduplicated, near_duplicates, shingle_sets, signature  # noqa: E402


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> (n_shingles of each of its rows, component)"""
    sets = [(i, shingles(t)) for i, t in rows]
    name = {i: i for i, _ in sets if i is not None}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = find(i), find(j)
            name[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def edited(text, changes, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_edge_rows(spark):
    frame = near_duplicates(edge_table(spark))
    assert result(frame) == brute([(i, t) for i, t, _ in texts()])
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in frame.collect())


def test_empty_table(spark):
    assert near_duplicates(edge_table(spark, [])).collect() == []
    assert deduplicated(edge_table(spark, [])).collect() == []


def test_stars_lose_no_link(spark):
    """More near copies of one text than a small bucket holds, from close to beyond the threshold, and a chain."""
    base = sentence(120, 5)
    rows = [(i, edited(base, i % 9, i)) for i in range(60)]
    chain = sentence(100, 6).split()
    rows += [(100 + i, " ".join(chain[4 * i:] + [f"c{k}" for k in range(4 * i)])) for i in range(12)]
    rows += [(200 + i, sentence(80, 50 + i)) for i in range(10)]
    frame = near_duplicates(edge_table(spark, [(i, t, None) for i, t in rows]))
    assert result(frame) == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = [r for r in texts() if r[0] is not None]
    kept = sorted(r.doc_id for r in deduplicated(edge_table(spark, rows)).collect())
    assert kept == sorted({i for i, _, c in brute([(i, t) for i, t, _ in rows]) if i == c})
    assert deduplicated(edge_table(spark)).where("doc_id is null").count() == 1


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_signature_bins(n):
    (held,) = shingle_sets(pa.array([sentence(n + 4, n).encode()]))
    signed = signature(held)
    assert len(signed) == K and set(signed) <= set(held)
    for k in range(K):
        own = [h for h in held.tolist() if h * K >> 64 == k]
        assert not own or signed[k] == min(own)


def test_signatures_agree_as_often_as_sets_do():
    base = sentence(600, 9)
    a, b = shingle_sets(pa.array([base.encode(), edited(base, 12, 1).encode()]))
    same = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((signature(a) == signature(b)).mean() - same) < 0.15


def test_texts_of_one_id_are_judged_each_by_itself(spark):
    """Text A of id 7 is near id 3 and goes; text B of id 7 is like no other and stays, whatever the order of rows."""
    a, b = sentence(80, 21), sentence(80, 22)
    rows = [(3, a, "x"), (7, edited(a, 1, 1), "x"), (7, b, "x"), (7, b, "x"), (7, "  " + b, "x"), (8, None, "x"), (8, "", "x")]
    for order in (rows, rows[::-1]):
        got = sorted(((r.doc_id, r.text) for r in deduplicated(edge_table(spark, order).repartition(3)).collect()), key=repr)
        assert got == sorted([(3, a), (7, "  " + b), (8, "")], key=repr) or got == sorted([(3, a), (7, "  " + b), (8, None)], key=repr)
    first = sorted(((r.doc_id, r.text) for r in deduplicated(edge_table(spark, rows)).collect()), key=repr)
    assert first == sorted(((r.doc_id, r.text) for r in deduplicated(edge_table(spark, rows[::-1])).collect()), key=repr)


def test_texts_of_single_ids_are_not_read_again(spark):
    """No Python task gets the texts again, and the text's column is shuffled at most once."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(i, sentence(30, i % 7), "x") for i in range(20)] + [(None, "a", "x"), (21, None, "x"), (22, "", "x")]
        got = deduplicated(edge_table(spark, rows))
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = got._jdf.queryExecution().explainString(mode)
        assert "MapInArrow" not in plan
        assert sum("text#" in one for one in re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)) == 1
        assert sorted((r.doc_id for r in got.collect()), key=repr) == sorted([*range(7), None, 21, 22], key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
