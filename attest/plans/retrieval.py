"""Retrieval queries over documents, vectors, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import retrieval as rt
from attest.plans import views as v
from attest.plans.registry import query

TERMS = ["the", "elle", "than", "ersten", "and"]
_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_TOK = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tok(column: str = "text") -> str:
    return _TOK.format(t=column)


_BM25 = f"""tk AS (SELECT doc_id, {tok()} AS t FROM documents),
tf AS (SELECT doc_id, CAST(len(t) AS DOUBLE) AS n, {', '.join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS f{i}" for i, w in enumerate(TERMS))} FROM tk),
st AS (SELECT CAST(count(*) AS DOUBLE) AS nd, avg(n) AS mean, {', '.join(f'CAST(count(*) FILTER (f{i} > 0) AS DOUBLE) AS d{i}' for i in range(len(TERMS)))} FROM tf),
lex AS (SELECT doc_id, {' + '.join(f'ln(1 + (nd - d{i} + 0.5) / (d{i} + 0.5)) * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * n / mean))' for i in range(len(TERMS)))} AS score
  FROM tf, st WHERE {' OR '.join(f'f{i} > 0' for i in range(len(TERMS)))}),
lexr AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM lex)"""


def _lexical(spark, sf):
    scores = rt.lexical_scores(v.table(spark, sf, "documents"), TERMS).withColumn("score", F.round("score", 9))
    return rt.ranked(scores)


@query("lexical_rank", f"WITH {_BM25} SELECT doc_id, round(score, 9) AS score, rank FROM lexr")
def lexical_rank(spark, sf):
    return _lexical(spark, sf)


QUERY_VECTOR = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_QV = "[" + ", ".join(f"CAST({x} AS DOUBLE)" for x in QUERY_VECTOR) + "]"
_COS = f"""cs AS (SELECT vec_id AS doc_id, list_dot_product(CAST(embedding AS DOUBLE[]), {_QV}) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))
  / sqrt(list_dot_product({_QV}, {_QV})) AS score FROM embeddings),
cosr AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM cs)"""


def _cosine(spark, sf):
    e = v.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return rt.ranked(rt.cosine_scores(e, QUERY_VECTOR).withColumn("score", F.round("score", 9)))


@query("cosine_rank", f"WITH {_COS} SELECT doc_id, round(score, 9) AS score, rank FROM cosr")
def cosine_rank(spark, sf):
    return _cosine(spark, sf)


@query("hashed_vector_rank")
def hashed_vector_rank(spark, sf):
    return rt.ranked(rt.hashed_cosine_scores(v.table(spark, sf, "documents"), TERMS).withColumn("score", F.round("score", 9)))


_RRF = f"""WITH {_BM25}, {_COS},
fused AS (SELECT doc_id, round(sum(part), 6) AS score, max(r1) AS rank_fts, max(r2) AS rank_knn FROM (
  SELECT doc_id, CAST(1 AS DOUBLE) / (60 + rank) AS part, rank AS r1, NULL AS r2 FROM lexr UNION ALL
  SELECT doc_id, CAST(1 AS DOUBLE) / (60 + rank), NULL, rank FROM cosr) u GROUP BY doc_id)
SELECT doc_id, score, round(score / (CAST(2 AS DOUBLE) / 61), 4) AS relevance, rank_fts, rank_knn FROM fused"""


@query("rrf", _RRF)
def rrf(spark, sf):
    return rt.rrf({"fts": _lexical(spark, sf), "knn": _cosine(spark, sf)})


@query("top_hits", _RRF + " ORDER BY score DESC, doc_id LIMIT 8")
def top_hits(spark, sf):
    return rt.top_hits(rrf(spark, sf), 8)


@query("highlight", f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+'),
  lambda x: CASE WHEN list_contains({_LIST}, lower(x)) THEN concat('<em>', x, '</em>') ELSE x END), '') AS highlighted FROM documents""")
def highlight(spark, sf):
    return rt.highlight(v.table(spark, sf, "documents"), TERMS).select("doc_id", "highlighted")


_SENT = f"""s AS (SELECT doc_id, text, unnest(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+')) AS q, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]+|[^.!?]+'), 1) AS i FROM documents),
o AS (SELECT doc_id, i, q, sum(length(q)) OVER (PARTITION BY doc_id ORDER BY i) - length(q) AS st, len(list_intersect({tok('q')}, {_LIST})) AS found FROM s),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY found DESC, i) AS rn FROM o WHERE found > 0) x WHERE rn = 1)"""


@query("extract_sentences", f"""WITH {_SENT} SELECT doc_id, CAST(st + length(q) - length(ltrim(q, ' ')) AS INTEGER) AS start, CAST(st + length(q) AS INTEGER) AS "end", ltrim(q, ' ') AS quote,
  array_to_string(list_sort(list_intersect({tok('q')}, {_LIST})), ' ') AS matched_terms FROM b""")
def extract_sentences(spark, sf):
    rows = rt.extract_sentences(v.table(spark, sf, "documents"), TERMS)
    return rows.withColumn("matched_terms", F.array_join("matched_terms", " "))


_EXC = ["doc_id + CASE WHEN doc_id % 23 = 0 THEN 100000000 ELSE 0 END AS doc_id", "doc_id AS cite",
        "CASE WHEN doc_id % 19 = 0 THEN 'abstract' ELSE 'text' END AS field",
        "CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 5 END AS start", "CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 5 END + CASE WHEN doc_id % 17 = 0 THEN 4 ELSE 20 END AS \"end\"",
        "CASE WHEN doc_id % 5 = 0 THEN concat(substr(text, 6, 19), '#') ELSE substr(text, 6, 20) END AS quote"]


@query("verify_excerpts", f"""WITH e AS (SELECT {', '.join(_EXC)} FROM documents)
SELECT e.cite, CASE WHEN e.quote IS NULL OR e.quote = '' OR e."end" - e.start <> length(e.quote) THEN 'invalid-excerpt' WHEN d.doc_id IS NULL THEN 'missing-document'
  WHEN e.field <> 'text' THEN 'missing-field' WHEN substr(d.text, e.start + 1, e."end" - e.start) = e.quote THEN 'verified'
  WHEN contains(d.text, e.quote) THEN 'relocated' ELSE 'drifted' END AS status FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id""")
def verify_excerpts(spark, sf):
    docs = v.table(spark, sf, "documents")
    excerpts = docs.selectExpr(*[c.replace('"end"', "`end`") for c in _EXC])
    return rt.verify_excerpts(excerpts, docs).select("cite", "status")


@query("excerpt_counts", f"""WITH e AS (SELECT {', '.join(_EXC)} FROM documents),
r AS (SELECT CASE WHEN e.quote IS NULL OR e.quote = '' OR e."end" - e.start <> length(e.quote) THEN 'invalid-excerpt' WHEN d.doc_id IS NULL THEN 'missing-document'
  WHEN e.field <> 'text' THEN 'missing-field' WHEN substr(d.text, e.start + 1, e."end" - e.start) = e.quote THEN 'verified'
  WHEN contains(d.text, e.quote) THEN 'relocated' ELSE 'drifted' END AS status FROM e LEFT JOIN documents d ON d.doc_id = e.doc_id)
SELECT {', '.join(f"CAST(count(*) FILTER (status = '{s}') AS BIGINT) AS {s.replace('-', '_')}" for s in rt.EXCERPT_STATES)},
  count(*) FILTER (status = 'verified') = count(*) AS ok FROM r""")
def excerpt_counts(spark, sf):
    docs = v.table(spark, sf, "documents")
    return rt.excerpt_counts(rt.verify_excerpts(docs.selectExpr(*[c.replace('"end"', "`end`") for c in _EXC]), docs))


_SEALED = """concat('{"lang":"', lang, '","n_chars":', n_chars, ',"source":"', source, '"}')"""


@query("verify_seal", f"""SELECT doc_id, sha256({_SEALED}) AS computed, doc_id % 9 <> 0 AS matches FROM documents""")
def verify_seal(spark, sf):
    docs = v.table(spark, sf, "documents").withColumn("content_sha256", F.expr(
        f"CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE sha2({_SEALED}, 256) END"))
    return rt.verify_seal(docs, ["source", "lang", "n_chars"]).select("doc_id", "computed", "matches")


@query("audit_quotes", """WITH l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
q AS (SELECT file, CAST(line + CASE WHEN line % 4 = 0 THEN 1 ELSE 0 END AS INTEGER) AS line, CASE WHEN line % 3 = 0 THEN concat(substr(text, 3, 12), '~') ELSE substr(text, 3, 12) END AS quote FROM l)
SELECT q.file, CAST(count(*) AS BIGINT) AS checked, CAST(count(*) FILTER (coalesce(contains(l.text, q.quote), false)) AS BIGINT) AS verified,
  count(*) = count(*) FILTER (coalesce(contains(l.text, q.quote), false)) AS passed
FROM q LEFT JOIN l ON l.file = q.file AND l.line = q.line GROUP BY q.file""")
def audit_quotes(spark, sf):
    lines = rt.corpus_lines(v.table(spark, sf, "documents"))
    quotes = lines.selectExpr("file", "CAST(line + CASE WHEN line % 4 = 0 THEN 1 ELSE 0 END AS INT) AS line",
                              "CASE WHEN line % 3 = 0 THEN concat(substr(text, 3, 12), '~') ELSE substr(text, 3, 12) END AS quote")
    return rt.quote_summary(rt.audit_quotes(quotes, lines), ["file"])


_ASKED = [*TERMS, "resonance"]


@query("term_coverage", f"""WITH t AS (SELECT doc_id, list_distinct({tok()}) AS t FROM documents), u AS (SELECT doc_id, unnest(t) AS term FROM t)
SELECT a.term, CAST(count(u.doc_id) AS BIGINT) AS documents, count(u.doc_id) > 0 AS matched
FROM (VALUES {', '.join(f"('{t}')" for t in _ASKED)}) AS a(term) LEFT JOIN u ON u.term = a.term GROUP BY a.term""")
def term_coverage(spark, sf):
    return rt.term_coverage(v.table(spark, sf, "documents"), _ASKED)


@query("ingest_report", """SELECT source AS query, CAST(count(*) FILTER (NOT (n_chars < 50 AND lang <> 'en')) AS BIGINT) AS indexed, CAST(count(*) FILTER (n_chars < 50 AND lang <> 'en') AS BIGINT) AS failed,
  min(CASE WHEN n_chars < 50 AND lang <> 'en' THEN concat('too short: ', doc_id) END) AS error FROM documents GROUP BY source""")
def ingest_report(spark, sf):
    docs = v.table(spark, sf, "documents").selectExpr("source AS query", "CASE WHEN n_chars < 50 AND lang <> 'en' THEN concat('too short: ', doc_id) END AS error")
    return rt.ingest_report(docs)


@query("record_hits", """SELECT CAST(page_id AS DOUBLE) / 1000 AS score, concat('page:', page_id) AS id, url, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS abstract,
  CASE WHEN page_id % 2 = 0 THEN 0 ELSE 1 END AS authors, 0 AS highlights, CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(page_id AS DOUBLE) / 2000 END AS relevance FROM pages""")
def record_hits(spark, sf):
    hits = v.table(spark, sf, "pages").selectExpr(
        "CAST(page_id AS DOUBLE) / CAST(1000 AS DOUBLE) AS score", "map('fts', page_id) AS explanation", "concat('page:', page_id) AS id", "'t' AS title", "'web' AS source", "url",
        "CAST(NULL AS STRING) AS pdf_url", "CAST(NULL AS STRING) AS published", "CAST(NULL AS STRING) AS version",
        "CASE WHEN page_id % 3 = 0 THEN NULL ELSE html END AS abstract", "CASE WHEN page_id % 2 = 0 THEN NULL ELSE array('a') END AS authors",
        "CAST(NULL AS ARRAY<STRING>) AS highlights", "CASE WHEN page_id % 4 = 0 THEN NULL ELSE CAST(page_id AS DOUBLE) / CAST(2000 AS DOUBLE) END AS relevance")
    return rt.record_hits(hits).select("score", "document.id", "document.url", "document.abstract", F.size("document.authors").alias("authors"),
                                       F.size("highlights").alias("highlights"), "relevance")
