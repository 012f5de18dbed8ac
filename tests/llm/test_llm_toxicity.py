import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parent))

from edge import edge_table, sentence, texts  # noqa: E402

from attest.llm import toxicity as T  # noqa: E402
from attest.llm.common import hash_words  # noqa: E402


def labelled(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = sentence(30 + i % 50, seed * 10_000 + i).split()
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["rotten", "beastly"]) + rng.choice(["", "ing", "est", "ly"])
        rows.append((i + seed * 10_000, " ".join(words), toxic))
    return rows


def test_held_out_rows(spark):
    rows = labelled(600, 1)
    docs = edge_table(spark, [(i, t, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net = T.fit(docs, labels)
    fresh = labelled(300, 2)
    got = {r.doc_id: r for r in T.score(edge_table(spark, [(i, t, None) for i, t, _ in fresh]), net).collect()}
    right = sum(got[i].predicted == y for i, _, y in fresh)
    assert right >= 0.97 * len(fresh)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert {r.doc_id for r in T.clean(docs, net).collect()} >= {i for i, _, y in rows if not y}


def test_edge_rows(spark):
    net = T.train([], [], [])
    docs = edge_table(spark)
    got = T.score(docs, net).collect()
    assert len(got) == len(texts()) and all(r.predicted == 0 for r in got)
    assert T.clean(docs, net).columns == docs.columns and T.clean(docs, net).count() == len(texts())
    assert T.score(edge_table(spark, []), net).collect() == []
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert T.score(docs, T.fit(docs, none)).count() == len(texts())


def test_windows_do_not_span_texts():
    """A text scores the same alone and between others."""
    net = T.Network.start(3)
    column = pa.array([t.encode() for t in ("a b c", "", "d", "e f g h i j", " ")])
    words, bounds = T.buckets(column)
    together = net.logits(words, bounds)
    alone = [net.logits(*T.buckets(column.slice(i, 1)))[0] for i in range(len(column))]
    assert np.allclose(together, alone, atol=1e-6)


def test_threshold_is_in_the_middle_of_the_gap():
    assert T._threshold(np.array([0.0, 1.0, 5.0, 6.0]), np.array([0, 0, 1, 1]), 1.0) == 3.0


def test_word_hashes():
    (words, four), bounds = hash_words(pa.array([b"The CAT", None, b"  the\tcat\n", b"cattle", b"", "É é".encode()]), (4,))
    assert bounds.tolist() == [0, 2, 2, 4, 5, 5, 7]
    assert words[0] == words[2] and words[1] == words[3] and words[1] != words[4] and words[5] != words[6]
    long, _ = hash_words(pa.array([b"x" * 300 + b" " + b"x" * 299]))
    assert long[0][0] != long[0][1]


def test_every_labelled_row_and_long_texts_are_trained_on(spark, monkeypatch):
    """Words of rows beyond the first group, and behind the 4,000th word, are known afterwards."""
    monkeypatch.setattr(T, "FIRST", 40)
    monkeypatch.setattr(T, "GROUP", 100)
    rows = [(i, sentence(20, i) + " ", int(i % 2 == 0)) for i in range(800)]
    rows = [(i, t + ("vile" if y else "kind"), y) for i, t, y in rows]
    rows += [(i, sentence(20, i) + " " + "w " * 4100 + ("foul" if i % 2 else "fair"), i % 2) for i in range(1000, 1040)]
    seen = []
    real = T._averaged
    monkeypatch.setattr(T, "_averaged", lambda docs, labels, *rest: (seen.append(labels.count()), real(docs, labels, *rest)))
    docs = edge_table(spark, [(i, t, None) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    net = T.fit(docs, labels)
    assert seen and seen[0] > 500
    got = net.scores(*T.buckets(pa.array([sentence(20, 5000 + i) + w for i, w in enumerate((" vile", " kind"))])))
    assert got[0] >= 0.5 > got[1]
    got = net.logits(*T.buckets(pa.array([("w " * 4100 + w).encode() for w in ("foul", "fair")])))
    assert got[0] > got[1] + 1
    again = T.fit(docs.repartition(5), labels)
    assert np.array_equal(net.table, again.table) and np.array_equal(net.thresholds, again.thresholds)


def test_no_cut_between_equal_margins():
    assert T._threshold(np.array([0.0, 1.0, 1.0, 2.0]), np.array([0, 0, 1, 1]), 1.0, np.array([5, 1, 2, 5])) == 0.5
