"""License scan: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Texts and templates are cut into words without punctuation, and their 5-word shingles are hashed. A template of ``m``
shingles is looked for in every window of ``m + m // 4`` shingles, so words may be changed, left out or inserted. Of
all windows only those that begin with one of the template's shingles are built: any other can be moved right to the
first one without losing any. A window that holds ``SHARE`` of the template has a similarity of 0.5 or more, and with
``BANDS`` bands of one row it collides with the template in some band with probability ``1 - 0.5**BANDS``, above
0.999999. It can only collide if it holds the template's least shingle of a band; windows without one are dropped,
which loses nothing. Every collision is then verified: the window must hold ``SHARE`` of the template's shingles. All
of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm.common import let, written

WORDS = 5
BANDS = 20
SHARE = 0.75
#: Notices by which public licenses are declared, and the licenses' SPDX names.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
]


def _words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and inner signs; quotes, brackets and closing marks don't count."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D.,;:!?()\[\]\"'*#>|/]+", " ")
    return F.array_remove(F.split(plain, " "), "")


def _shingles(words: Column) -> Column:
    """Hashes of the 5-word shingles in order; none if there are fewer words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WORDS),
                         lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)]))
    return F.when(F.size(words) >= WORDS, hashes).otherwise(F.array().cast("array<bigint>"))


def _least(shingles: Column) -> Column:
    """For each band, the least of its hash over a set of shingles and the shingle that has it."""
    def of(band: int) -> Column:
        return F.array_min(F.transform(
            shingles, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("value"), h.alias("shingle"))))
    return F.array(*[of(band) for band in range(BANDS)])


def templates(spark: SparkSession, notices: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """``template, license, shingles, size, least``; as many rows as there are notices of five words or more."""
    rows = F.array(*[F.struct(F.lit(number).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
                     for number, (name, text) in enumerate(notices)])
    one = spark.range(1).select(F.inline(rows))
    held = one.select("template", "license", F.array_distinct(_shingles_of(F.col("text"))).alias("shingles"))
    return (held.withColumn("size", F.size("shingles")).where("size > 0")
            .withColumn("least", _least(F.col("shingles"))))


def _shingles_of(text: Column) -> Column:
    return let(_words(text), _shingles)


def license_matches(docs: DataFrame, notices: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, license, template, word, share``: for each text and template that it holds, the fullest window.

    ``word`` is the place of the window's first word among the text's words, ``share`` the part of the template's
    shingles that the window holds. Windows begin with a shingle of the template; of equal ones the first counts. Notices of fewer than five words are left out.
    Null, empty and short texts match nothing. Rows of one id count as one document; rows without an id share a null
    id. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    known = templates(spark, notices)
    listed = known.select("size", "shingles", F.col("least.shingle").alias("anchors")).collect()  # as many as notices
    texts = docs.select(F.col(id_col).alias("doc_id"), _shingles_of(F.col(text_col)).alias("_s"))
    every = _literal({h for row in listed for h in row["anchors"]})
    held = written(texts.where(F.arrays_overlap("_s", every)), "held")  # read once per size of template
    least = known.select("template", "license", "shingles", "size", F.posexplode("least.value").alias("_band", "_value"))
    found = None
    for size in sorted({row["size"] for row in listed}):
        firsts, anchors = ({h for row in listed if row["size"] == size for h in row[k]} for k in ("shingles", "anchors"))
        windows = _windows(held, size, firsts, anchors).withColumn("_least", _least(F.col("_window")))
        keyed = windows.select("doc_id", "word", "_window", F.posexplode("_least.value").alias("_band", "_value"))
        # The right side has BANDS rows for each notice, whatever the number of documents.
        met = keyed.join(F.broadcast(least.where(F.col("size") == size)), ["_band", "_value"])
        share = F.size(F.array_intersect("_window", "shingles")) / F.col("size")
        begun = F.array_contains("shingles", F.get("_window", 0))
        met = met.where(begun).withColumn("share", share).where(F.col("share") >= SHARE)
        found = met if found is None else found.unionByName(met)
    best = found.groupBy("doc_id", "license", "template").agg(
        F.max(F.struct("share", (-F.col("word")).alias("back"))).alias("best"))
    return best.select("doc_id", "license", "template", (-F.col("best.back")).alias("word"), F.col("best.share").alias("share"))


def _literal(hashes: set[int]) -> Column:
    return F.array(*[F.lit(h).cast("long") for h in sorted(hashes)]).cast("array<bigint>")


def _windows(held: DataFrame, size: int, firsts: set[int], anchors: set[int]) -> DataFrame:
    """Windows for templates of ``size`` shingles that begin with one of ``firsts`` and hold one of ``anchors``:
    ``doc_id, word, _window``."""
    first, wanted = _literal(firsts), _literal(anchors)

    def starts(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.array_contains(first, F.get(s, i)))

    some = held.where(F.arrays_overlap("_s", wanted))
    return (some.select("doc_id", "_s", F.explode(let(F.col("_s"), starts)).alias("_k"))
            .select("doc_id", F.col("_k").cast("long").alias("word"),
                    F.slice("_s", F.col("_k") + 1, F.lit(size + size // 4)).alias("_window"))
            .where(F.arrays_overlap("_window", wanted)))
