"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import (
    lexical,
    licenses,
    neardup,
    negatives,
    packing,
    pieces,
    quality,
    sharding,
    tokencount,
    tokenids,
    topk,
    toxicity,
    urls,
)
from attest.llm.common import table

QueryFn = Callable[[SparkSession, str], DataFrame]

#: Where the public vocabulary files are; a parameter of the operators.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# The exact links by a prefix filter: linked sets share one of the rarest quarter of their shingles.
_NEAR_SQL = r"""
WITH RECURSIVE word_lists AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM word_lists),
classes AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY min(doc_id)) AS c, min(doc_id) AS rep, list_sort(s) AS s FROM sets
  WHERE len(s) > 0 GROUP BY list_sort(s)),
items AS MATERIALIZED (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
ranked AS (
  SELECT c, n, x, row_number() OVER (PARTITION BY c ORDER BY f, x) AS r
  FROM items JOIN (SELECT x, count(*) AS f FROM items GROUP BY x) USING (x)),
heads AS MATERIALIZED (SELECT c, n, x FROM ranked WHERE r <= n - (3 * n + 3) // 4 + 1),
pairs AS MATERIALIZED (
  SELECT DISTINCT a.c AS a, b.c AS b FROM heads a JOIN heads b ON a.x = b.x AND a.c < b.c
  AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM pairs JOIN classes a ON a.c = pairs.a JOIN classes b ON b.c = pairs.b
  WHERE 7 * len(list_intersect(a.s, b.s)) >= 3 * (len(a.s) + len(b.s))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION SELECT reached.node, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.other),
names AS (SELECT node, min(other) AS name FROM reached GROUP BY node)
SELECT sets.doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(name, sets.doc_id) AS component_id,
       coalesce(name, sets.doc_id) = sets.doc_id AS kept
FROM sets LEFT JOIN classes ON classes.s = list_sort(sets.s) AND len(sets.s) > 0 LEFT JOIN names ON node = rep
"""


@query("op2_near_duplicates", _NEAR_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_best_fit")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(table(spark, sf_dir, "documents"))


_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT
           isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
           FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op8_top_k", _TOP_SQL)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op9_byte_shards")
def byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.byte_shards(table(spark, sf_dir, "documents"))


@query("op4_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose checksum of the id is divisible by 5 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return toxicity.score(docs, net).select("doc_id", held_out.alias("held_out"), "score", "predicted", "guessed_lang")


#: The filter's rules, longest match first.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


@query("op5_url_filter")
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs that a rule covers are the labelled ones; the trees trained on them judge the rest."""
    pages = table(spark, sf_dir, "pages")
    found = urls.rule_for(URL_RULES, urls.host_of(F.col("url")), urls.path_of(F.col("url")))
    return urls.judge(pages, URL_RULES, urls.fit(pages, (found["verdict"] == "block").cast("int"), found["rule"]))


@query("op6_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_licenses")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


@query("op7_round_trip")
def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", seed=1)


@query("op10_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"),
                                   *tokencount.vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model"))


@query("op11_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ids with the end id 0 after each text, written as blocks and read back."""
    with open(f"{TOKENIZERS}/byte_bpe_50k.json", encoding="utf-8") as file:
        definition = file.read()
    return tokenids.round_trip(table(spark, sf_dir, "documents"), definition)


_NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7 the label is the next of ten."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), label=label)


_RANKED_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
asked AS MATERIALIZED (
  SELECT item_id, term, count(*) AS repeats FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
whole AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM words),
docs AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * n_docs) // n_terms) AS m FROM words, whole WHERE len(w) > 0),
tf AS MATERIALIZED (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
            FROM tf, whole GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, CAST(sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN docs USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op13_ranked_search", _RANKED_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
