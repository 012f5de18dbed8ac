"""A small table with what operators must stand: nulls, blanks, long and repeated rows, and names that clash."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, "
          "shard int, bin string, rule string, _text string, component_id long, size long")


def sentence(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(90))
                    for _ in range(n))


def texts() -> list[tuple]:
    """(doc_id, text, source)"""
    base = sentence(60, 1)
    return [(1, base, "a"), (2, base + " tail", "a"), (3, base, None), (3, base, None), (4, None, "b"), (5, "", "b"),
            (6, " \t\n ", None), (7, "one two", "a"), (8, "One TWO", "c"), (None, base, "a"), (9, sentence(9000, 2), "c"),
            (10, "x" * 5000, "c"), (11, "Ünï ▁ ☃ 🎉\x00end", None), (12, "\n".join([base] * 3), "b")]


def edge_table(spark, rows: list[tuple] | None = None):
    full = [(i, t, "en", s, None, False, 9.0, 99, "no", "no", "no", -5, -1) for i, t, s in
            (texts() if rows is None else rows)]
    return spark.createDataFrame(full, SCHEMA)
