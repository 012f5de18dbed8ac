"""Hybrid document retrieval with excerpts that can be verified.

Texts are tokenised row by row and only counts leave the scan, so a query
never shuffles text. Ranks come from range-sorted positions, not from a
global window.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.ordering import ordered_index
from attest.functions.spread import spread
from attest.operators.lineage import canonical
from attest.session import cut_lineage

K1, B = 1.2, 0.75  # usual BM25 constants
RRF_K = 60
WORD = r"[\p{L}\p{N}]"
GAP = r"[^\p{L}\p{N}]+"
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), GAP), "")


def query_terms(query: str) -> list[str]:
    """Distinct lower-case words of a query, in order."""
    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def _terms(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def term_counts(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens and how often each term occurs; one pass over the text."""
    rows = spread(docs.select(key, text), key).select(key, tokens(F.col(text)).alias("_t"))
    hits = rows.select(key, F.size("_t").alias("n_tokens"),
                       F.filter("_t", lambda t: F.array_contains(_terms(terms), t)).alias("_h"))
    return hits.select(key, "n_tokens", F.transform(_terms(terms), lambda q: F.size(F.filter("_h", lambda t: t == q))).alias("tf"))


def lexical_scores(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """BM25 score of every document that holds at least one term."""
    counts = cut_lineage(term_counts(docs, terms, key, text))
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean"),
                       *[F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    norm = F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * F.col("n_tokens") / F.lit(float(stats["mean"] or 1.0)))
    parts = []
    for i in range(len(terms)):
        df = F.lit(float(stats[f"df{i}"]))
        idf = F.ln(F.lit(1.0) + (F.lit(float(stats["n"])) - df + 0.5) / (df + 0.5))
        tf = F.col("tf")[i].cast("double")
        parts.append(idf * (tf * F.lit(K1 + 1.0)) / (tf + norm))
    matched = F.exists("tf", lambda x: x > 0)
    return counts.where(matched).select(key, reduce(lambda a, b: a + b, parts).alias("score"))


def ranked(scores: DataFrame, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Add the rank (from 1) by descending score, ties by key."""
    placed = ordered_index(scores, [F.col(score).desc(), F.col(key).asc()], pos="_pos")
    return placed.withColumn("rank", F.col("_pos") + 1).drop("_pos")


def lexical_rank(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    return ranked(lexical_scores(docs, terms, key, text), key)


def cosine_scores(vectors: DataFrame, query: Sequence[float], key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Cosine of every vector with the query; row-local."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return vectors.select(key, F.try_divide(dot, norm * F.lit(size)).alias("score")).where("score IS NOT NULL")


def hashed_cosine_scores(docs: DataFrame, terms: Sequence[str], dims: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Cosine of hashed token counts with those of the query; row-local, and no token leaves the JVM.

    The norm of a document comes from the run lengths of its sorted buckets.
    """
    spark = docs.sparkSession
    bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int")
    slots = spark.range(1).select(F.transform(_terms(terms), bucket).alias("s")).first()["s"]  # one row per query
    weights = [float(slots.count(i)) for i in range(dims)]
    size = sum(w * w for w in weights) ** 0.5
    q = F.array(*[F.lit(w) for w in weights])
    rows = spread(docs.select(key, text), key).select(key, F.array_sort(F.transform(tokens(F.col(text)), bucket)).alias("_b"))
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sq"), F.lit(0.0).alias("dot"))
    def step(acc: Column, x: Column) -> Column:
        same = acc["last"] == x
        run = F.when(same, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("last"), run.alias("run"), (acc["sq"] + 2 * run - 1).alias("sq"), (acc["dot"] + F.get(q, x)).alias("dot"))
    state = F.aggregate("_b", start, step)
    scored = rows.select(key, state.alias("_s"))
    return scored.select(key, F.try_divide(F.col("_s.dot"), F.sqrt(F.col("_s.sq").cast("double")) * F.lit(size)).alias("score")) \
        .where("score > 0")


def rrf(legs: dict[str, DataFrame], key: str = "doc_id", k: int = RRF_K) -> DataFrame:
    """Fuse ranked legs: sum of ``1 / (k + rank)``, rounded to six digits, with the ranks behind it.

    Relevance is the score's share of what two first places would give.
    """
    rows = reduce(DataFrame.unionByName, [leg.select(key, F.lit(name).alias("leg"), F.col("rank").cast("long").alias("rank"))
                                          for name, leg in legs.items()])
    part = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    fused = rows.groupBy(key).agg(F.sum(part).alias("_s"), *[
        F.max(F.when(F.col("leg") == name, F.col("rank"))).alias(f"rank_{name}") for name in legs])
    score = F.round("_s", 6)
    ceiling = len(legs) / (k + 1)
    return fused.select(key, score.alias("score"), F.round(score / F.lit(ceiling), 4).alias("relevance"),
                        *[f"rank_{name}" for name in legs])


def top_hits(fused: DataFrame, per_page: int, key: str = "doc_id") -> DataFrame:
    """The first page of hits."""
    return fused.orderBy(F.col("score").desc(), F.col(key).asc()).limit(per_page)


def highlight(df: DataFrame, terms: Sequence[str], text: str = "text", out: str = "highlighted") -> DataFrame:
    """Wrap whole-word occurrences of the terms in ``<em>``."""
    words = "|".join(re.escape(t) for t in terms)
    return df.withColumn(out, F.regexp_replace(text, rf"(?iu)(?<!{WORD})({words})(?!{WORD})", "<em>$1</em>"))


def extract_sentences(docs: DataFrame, terms: Sequence[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Best sentence of each document: most distinct terms, then the earliest, with code-point offsets and its terms.

    One running state walks the sentences of a text, so no sentence list is copied or shuffled.
    """
    rows = spread(docs.select(key, text), key).select(key, F.col(text).alias("_text"), F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), 1).alias("_sents"))
    zero = F.lit(0)
    start = F.struct(zero.alias("at"), zero.alias("best"), zero.alias("s"), zero.alias("e"))
    def step(acc: Column, sentence: Column) -> Column:
        found = F.size(F.array_intersect(tokens(sentence), _terms(terms)))
        stop = acc["at"] + F.length(sentence)
        better = found > acc["best"]
        return F.struct(stop.alias("at"), F.when(better, found).otherwise(acc["best"]).alias("best"),
                        F.when(better, acc["at"]).otherwise(acc["s"]).alias("s"), F.when(better, stop).otherwise(acc["e"]).alias("e"))
    best = rows.select(key, "_text", F.aggregate("_sents", start, step).alias("_b")).where("_b.best > 0")
    quote = F.substr("_text", F.col("_b.s") + 1, F.col("_b.e") - F.col("_b.s"))
    lead = F.length(quote) - F.length(F.ltrim(quote))  # spaces before the sentence are not quoted
    out = best.select(key, "_text", (F.col("_b.s") + lead).alias("start"), F.col("_b.e").alias("end"))
    quoted = out.withColumn("quote", F.substr("_text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("_text")
    return quoted.withColumn("matched_terms", F.array_sort(F.array_intersect(_terms(terms), tokens(F.col("quote")))))


EXCERPT_STATES = ("verified", "relocated", "drifted", "missing-document", "missing-field", "invalid-excerpt")


def verify_excerpts(excerpts: DataFrame, docs: DataFrame, fields: Sequence[str] = ("text",), key: str = "doc_id") -> DataFrame:
    """Re-read every excerpt: does the quote still stand where it was cited, elsewhere in the field, or nowhere?"""
    theirs = docs.select(key, *[F.col(f).alias(f"_f_{f}") for f in fields], F.lit(True).alias("_found"))
    rows = excerpts.join(theirs, key, "left")
    value = F.lit(None).cast("string")
    for f in fields:
        value = F.when(F.col("field") == f, F.col(f"_f_{f}")).otherwise(value)
    bad = (F.col("quote").isNull() | (F.col("quote") == "") | F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0)
           | (F.col("end") - F.col("start") != F.length("quote")))
    here = F.substr("_value", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("quote")
    status = (F.when(bad, "invalid-excerpt").when(F.col("_found").isNull(), "missing-document").when(F.col("_value").isNull(), "missing-field")
              .when(here, "verified").when(F.contains("_value", F.col("quote")), "relocated").otherwise("drifted"))
    rows = rows.withColumn("_value", value)
    return rows.withColumn("status", status).drop("_found", "_value", *[f"_f_{f}" for f in fields])


def excerpt_counts(verified: DataFrame) -> DataFrame:
    """Number of excerpts per status (zeros included) and whether all are verified."""
    counts = verified.agg(*[F.count_if(F.col("status") == s).alias(s.replace("-", "_")) for s in EXCERPT_STATES], F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("ok", F.col("verified") == F.col("_n")).drop("_n")


def verify_seal(records: DataFrame, columns: Sequence[str], declared: str = "content_sha256") -> DataFrame:
    """Does each record still hash to what it declares?"""
    computed = F.sha2(canonical(records, columns), 256)
    return records.withColumn("computed", computed).withColumn("matches", F.col("computed").eqNullSafe(F.col(declared)))


def audit_quotes(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """Is every quote part of the line it names? Columns: file, line, quote; lines: file, line, text."""
    there = lines.select("file", "line", F.col("text").alias("_line"))
    rows = quotes.join(there, ["file", "line"], "left")
    return rows.withColumn("verbatim", F.coalesce(F.contains("_line", F.col("quote")), F.lit(False))).drop("_line")


def quote_summary(audited: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = audited.groupBy(*by).agg(F.count(F.lit(1)).alias("checked"), F.count_if("verbatim").alias("verified"))
    return sums.withColumn("passed", F.col("checked") == F.col("verified"))


def corpus_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lines of each document, numbered from 1."""
    return docs.select(F.col(key).alias("file"), F.posexplode(F.split(text, "\n")).alias("_p", "text")) \
        .select("file", (F.col("_p") + 1).alias("line"), "text")


def term_coverage(docs: DataFrame, terms: Sequence[str], text: str = "text") -> DataFrame:
    """Documents per query term, zero for terms the corpus lacks."""
    found = docs.select(F.explode(F.array_intersect(tokens(F.col(text)), _terms(terms))).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    asked = docs.sparkSession.range(1).select(F.explode(_terms(terms)).alias("term"))
    return asked.join(found, "term", "left").select("term", F.coalesce("documents", F.lit(0).cast("long")).alias("documents"),
                                                    F.col("documents").isNotNull().alias("matched"))


def ingest_report(batches: DataFrame) -> DataFrame:
    """Documents indexed and failed per query; one bad row or query never hides the rest."""
    return batches.groupBy("query").agg(F.count_if(F.col("error").isNull()).alias("indexed"),
                                        F.count_if(F.col("error").isNotNull()).alias("failed"),
                                        F.min("error").alias("error"))


RECORD_TEXT = ("url", "pdf_url", "published", "version", "abstract")


def record_hits(hits: DataFrame) -> DataFrame:
    """The fields a record keeps of each hit: absent texts become empty, absent lists empty; relevance only if known."""
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in RECORD_TEXT]
    empty = F.array().cast("array<string>")
    doc = F.struct("id", "title", "source", *texts, F.coalesce("authors", empty).alias("authors"))
    return hits.select("score", "explanation", doc.alias("document"), F.coalesce("highlights", empty).alias("highlights"), "relevance")
