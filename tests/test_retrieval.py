import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attest.operators import retrieval as rt


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The heart beats. Breathing moves the heart rate! Nothing else.", "breathing, breathing; Herzschlag", "no match here",
             "Élan vital: the heart", ""]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_fusion_reproduces_recorded_scores(spark):
    legs = {"fts": spark.createDataFrame([("a", 4), ("b", 1)], "doc_id string, rank long"),
            "knn": spark.createDataFrame([("a", 1), ("b", 5), ("c", 2)], "doc_id string, rank long")}
    got = {r.doc_id: (r.score, r.relevance) for r in rt.rrf(legs).collect()}
    assert got["a"] == (.032018, .9765) and got["b"] == (.031778, .9692) and got["c"] == (round(1 / 62, 6), pytest.approx(.4919))


def test_hashed_vectors_match_brute_force(spark, docs):
    terms, dims = ["heart", "breathing"], 16
    words = {r.w: r.b for r in docs.select(F.explode(rt.tokens(F.col("text"))).alias("w")).distinct()
             .select("w", F.pmod(F.xxhash64("w"), F.lit(dims)).alias("b")).collect()}
    got = {r.doc_id: r.score for r in rt.hashed_cosine_scores(docs, terms, dims).collect()}
    query = Counter(words[t] for t in terms)
    for row in docs.collect():
        have = Counter(words[w] for w in re.split(r"[\W_]+", row.text.lower()) if w)
        dot = sum(n * have[b] for b, n in query.items())
        size = math.sqrt(sum(n * n for n in have.values()) * sum(n * n for n in query.values()))
        assert got.get(row.doc_id, 0.0) == pytest.approx(dot / size if size else 0.0)


def test_sentences_and_their_verification(spark, docs):
    terms = rt.query_terms("Heart, breathing!")
    found = rt.extract_sentences(docs, terms)
    best = {r.doc_id: r for r in found.collect()}
    assert best[0].quote == "Breathing moves the heart rate!" and (best[0].start, best[0].end) == (17, 48) and set(best) == {0, 1, 3}
    assert best[0].matched_terms == ["breathing", "heart"]
    cited = found.select("doc_id", F.lit("text").alias("field"), "start", "end", "quote")
    assert rt.excerpt_counts(rt.verify_excerpts(cited, docs)).first().ok
    rows = [(0, "text", 0, 3, "The"), (0, "text", 4, 7, "The"), (0, "text", 0, 3, "xyz"), (9, "text", 0, 1, "a"), (0, "title", 0, 1, "a"), (0, "text", 3, 3, ""), (0, "text", 0, 9, "The")]
    states = rt.verify_excerpts(spark.createDataFrame(rows, "doc_id long, field string, start int, end int, quote string"), docs).collect()
    assert Counter(r.status for r in states) == Counter(["verified", "relocated", "drifted", "missing-document", "missing-field", "invalid-excerpt", "invalid-excerpt"])


def test_highlights_wrap_whole_words(docs):
    got = {r.doc_id: r.highlighted for r in rt.highlight(docs, ["the", "heart"]).collect()}
    assert got[0].startswith("<em>The</em> <em>heart</em> beats.") and got[3] == "Élan vital: <em>the</em> <em>heart</em>"
    assert "<em>" not in got[2]


def test_ranks_cover_every_match(docs):
    rows = rt.lexical_rank(docs, ["heart", "breathing"]).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_coverage_keeps_missing_terms(docs):
    got = {r.term: (r.documents, r.matched) for r in rt.term_coverage(docs, ["heart", "absent"]).collect()}
    assert got == {"heart": (2, True), "absent": (0, False)}


def test_quotes_must_stand_in_their_line(spark, docs):
    lines = rt.corpus_lines(spark.createDataFrame([("f", "one line\nand another")], "doc_id string, text string"))
    quotes = spark.createDataFrame([("f", 1, "one"), ("f", 2, "one"), ("f", 3, "x")], "file string, line int, quote string")
    row = rt.quote_summary(rt.audit_quotes(quotes, lines)).first()
    assert (row.checked, row.verified, row.passed) == (3, 1, False)


def test_hits_keep_their_shape(spark):
    hits = spark.createDataFrame([(.5, {"fts": 1}, "d", "t", "s", None, None, None, None, None, None, None, None)],
                                 "score double, explanation map<string,int>, id string, title string, source string, url string, pdf_url string, "
                                 "published string, version string, abstract string, authors array<string>, highlights array<string>, relevance double")
    row = rt.record_hits(hits).first()
    assert (row.document.url, row.document.authors, row.highlights, row.relevance) == ("", [], [], None)
