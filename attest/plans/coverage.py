"""Coverage queries over the ledger and request views."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import coverage as cov
from attest.plans import views as v
from attest.plans.registry import query

_COVER_SQL = """
hits AS (
  SELECT w.req_id, w.start_b AS ws, w.end_b AS we, greatest(l.start_b, w.start_b) AS s, least(l.end_b, w.end_b) AS e
  FROM v_wanted w JOIN v_ledger l ON l.url = w.url AND l.start_b <= w.end_b AND l.end_b >= w.start_b{extra}),
ahead AS (
  SELECT req_id, s, e, max(e) OVER (PARTITION BY req_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
  FROM hits),
cover AS (
  SELECT req_id, CAST(sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS BIGINT) AS covered FROM ahead GROUP BY req_id)
"""
_EXACT_SQL = """
exact AS (
  SELECT url, start_b, end_b, sha256, first_read_at, first_read_by FROM (
    SELECT *, row_number() OVER (PARTITION BY url, start_b, end_b ORDER BY first_read_at, first_read_by, sha256) AS rn
    FROM v_ledger) q WHERE rn = 1)
"""


@query("ledger_scan", v.sql("v_ledger", "SELECT url, start_b, end_b, sha256, first_read_at, first_read_by FROM v_ledger"))
def ledger_scan(spark, sf):
    return v.ledger(spark, sf).select(*cov.LEDGER)


@query("exact_entry", v.sql("v_ledger v_wanted", f"""WITH {_EXACT_SQL},
asked AS (SELECT order_no, line_no, url, start_b, CASE WHEN line_no % 3 = 0 THEN end_b + 1 ELSE end_b END AS end_b FROM v_ledger)
SELECT a.order_no, a.line_no, a.url, a.start_b, a.end_b, x.sha256, x.first_read_at, x.first_read_by
FROM asked a LEFT JOIN exact x ON x.url = a.url AND x.start_b = a.start_b AND x.end_b = a.end_b"""))
def exact_entry(spark, sf):
    ledger = v.ledger(spark, sf)
    asked = ledger.selectExpr("order_no", "line_no", "url", "start_b",
                              "CASE WHEN line_no % 3 = 0 THEN end_b + 1 ELSE end_b END AS end_b")
    return cov.exact_entry(asked, ledger).select("order_no", "line_no", "url", "start_b", "end_b", "sha256",
                                                 "first_read_at", "first_read_by")


@query("overlap_bytes", v.sql("v_ledger v_wanted", """
SELECT w.req_id, w.exp_id, CAST(count(l.url) AS BIGINT) AS overlapping,
       CAST(coalesce(sum(CASE WHEN l.url IS NOT NULL THEN least(l.end_b, w.end_b) - greatest(l.start_b, w.start_b) + 1 END), 0) AS BIGINT) AS shared
FROM v_wanted w LEFT JOIN v_ledger l ON l.url = w.url AND l.start_b <= w.end_b AND l.end_b >= w.start_b
GROUP BY w.req_id, w.exp_id"""))
def overlap_bytes(spark, sf):
    return cov.overlap_bytes(v.wanted(spark, sf), v.ledger(spark, sf)).select("req_id", "exp_id", "overlapping", "shared")


@query("coverage_union", v.sql("v_ledger v_wanted", f"""WITH {_COVER_SQL.format(extra='')}
SELECT w.req_id, w.url, coalesce(c.covered, 0) AS covered FROM v_wanted w LEFT JOIN cover c ON c.req_id = w.req_id"""))
def coverage_union(spark, sf):
    return cov.covered_bytes(v.wanted(spark, sf), v.ledger(spark, sf)).select("req_id", "url", "covered")


@query("bytes_unseen", v.sql("v_ledger v_wanted", f"""WITH {_COVER_SQL.format(extra='')}
SELECT w.url, CAST(count(*) AS BIGINT) AS requests, CAST(sum(w.end_b - w.start_b + 1) AS BIGINT) AS asked_bytes,
       CAST(sum(w.end_b - w.start_b + 1 - coalesce(c.covered, 0)) AS BIGINT) AS unseen_bytes
FROM v_wanted w LEFT JOIN cover c ON c.req_id = w.req_id GROUP BY w.url"""))
def bytes_unseen(spark, sf):
    rows = cov.bytes_unseen(v.wanted(spark, sf), v.ledger(spark, sf))
    return rows.groupBy("url").agg(F.count(F.lit(1)).alias("requests"), F.sum(cov.length()).alias("asked_bytes"),
                                   F.sum("unseen").alias("unseen_bytes"))


@query("bytes_read_before", v.sql("v_ledger v_wanted",
                                  f"""WITH {_COVER_SQL.format(extra=' AND l.first_read_at < w.moment')}
SELECT w.req_id, w.exp_id, coalesce(c.covered, 0) AS read_before FROM v_wanted w LEFT JOIN cover c ON c.req_id = w.req_id"""))
def bytes_read_before(spark, sf):
    rows = cov.bytes_read_before(v.wanted(spark, sf), v.ledger(spark, sf), "moment")
    return rows.select("req_id", "exp_id", "read_before")


_READS_SQL = """reads AS (
  SELECT order_no * 10 + line_no AS read_id, url, CASE WHEN line_no = 2 THEN start_b + 5 ELSE start_b END AS start_b,
         CASE WHEN line_no = 3 THEN end_b + 4000 ELSE end_b END AS end_b,
         CASE WHEN line_no = 4 THEN sha256('changed') ELSE sha256 END AS sha256
  FROM v_ledger)"""


def _reads(spark, sf):
    return v.ledger(spark, sf).select(
        (F.col("order_no") * 10 + F.col("line_no")).alias("read_id"), "url",
        F.expr("CASE WHEN line_no = 2 THEN start_b + 5 ELSE start_b END").alias("start_b"),
        F.expr("CASE WHEN line_no = 3 THEN end_b + 4000 ELSE end_b END").alias("end_b"),
        F.expr("CASE WHEN line_no = 4 THEN sha2('changed', 256) ELSE sha256 END").alias("sha256"))


_SEEN_TAIL = """
hits AS (
  SELECT w.url, w.start_b AS ws, w.end_b AS we, greatest(l.start_b, w.start_b) AS s, least(l.end_b, w.end_b) AS e
  FROM (SELECT DISTINCT url, start_b, end_b FROM {reads}) w
  JOIN v_ledger l ON l.url = w.url AND l.start_b <= w.end_b AND l.end_b >= w.start_b),
ahead AS (
  SELECT url, ws, we, s, e, max(e) OVER (PARTITION BY url, ws, we ORDER BY s, e
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hits),
cover AS (SELECT url, ws, we, sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS covered
          FROM ahead GROUP BY url, ws, we)"""


@query("seen_gate", v.sql("v_ledger", f"""WITH {_READS_SQL}, {_EXACT_SQL}, {_SEEN_TAIL.format(reads='reads')}
SELECT r.read_id, r.url, r.start_b, r.end_b,
  CAST(r.end_b - r.start_b + 1 - coalesce(c.covered, 0) AS BIGINT) AS unseen,
  CASE WHEN r.end_b - r.start_b + 1 - coalesce(c.covered, 0) > 0 THEN 'unseen'
       WHEN x.sha256 IS NULL THEN 'ok_covered' WHEN x.sha256 <> r.sha256 THEN 'content_changed' ELSE 'ok_exact' END AS gate
FROM reads r LEFT JOIN cover c ON c.url = r.url AND c.ws = r.start_b AND c.we = r.end_b
LEFT JOIN exact x ON x.url = r.url AND x.start_b = r.start_b AND x.end_b = r.end_b"""))
def seen_gate(spark, sf):
    return cov.require_seen(_reads(spark, sf), v.ledger(spark, sf)).select(
        "read_id", "url", "start_b", "end_b", "unseen", "gate")


@query("run_data_check", v.sql("v_ledger", f"""WITH {_READS_SQL}, {_EXACT_SQL}, {_SEEN_TAIL.format(reads='reads')}
SELECT r.read_id, r.url,
  CASE WHEN x.sha256 IS NOT NULL AND x.sha256 <> r.sha256 THEN 'content_differs'
       WHEN x.sha256 IS NULL AND r.end_b - r.start_b + 1 - coalesce(c.covered, 0) > 0 THEN 'never_logged' ELSE 'ok' END AS state
FROM reads r LEFT JOIN cover c ON c.url = r.url AND c.ws = r.start_b AND c.we = r.end_b
LEFT JOIN exact x ON x.url = r.url AND x.start_b = r.start_b AND x.end_b = r.end_b"""))
def run_data_check(spark, sf):
    return cov.check_run_data(_reads(spark, sf), v.ledger(spark, sf)).select("read_id", "url", "state")


def _batch(spark, sf):
    """Orders as an ordered batch of reads against the ledger of returned items."""
    rows = v.wanted(spark, sf).selectExpr("req_id AS seq", "url", "start_b - 37 AS start_b", "end_b", "exp_id",
                                          "sha2(concat(url, '#', start_b, exp_id), 256) AS sha256")
    return rows.union(rows.selectExpr("seq + 1000000000000 AS seq", "url", "start_b", "end_b", "exp_id",
                                      "CASE WHEN seq % 5 = 0 THEN sha2('changed', 256) ELSE sha256 END AS sha256"))


# A read is new if some byte of it is neither in the ledger nor in an earlier read.
@query("record_reads", v.sql("v_ledger v_wanted", f"""WITH {_EXACT_SQL}, first_pass AS (
  SELECT req_id AS seq, url, start_b - 37 AS start_b, end_b, sha256(concat(url, '#', start_b, exp_id)) AS sha256 FROM v_wanted),
reads AS (SELECT * FROM first_pass UNION ALL SELECT seq + 1000000000000, url, start_b, end_b,
  CASE WHEN seq % 5 = 0 THEN sha256('changed') ELSE sha256 END FROM first_pass),
spans AS (SELECT url, start_b, end_b, CAST(-1 AS BIGINT) AS m FROM v_ledger UNION ALL SELECT url, start_b, end_b, seq FROM reads),
hits AS (SELECT r.seq, greatest(l.start_b, r.start_b) AS s, least(l.end_b, r.end_b) AS e
  FROM reads r JOIN spans l ON l.url = r.url AND l.start_b <= r.end_b AND l.end_b >= r.start_b AND l.m < r.seq),
ahead AS (SELECT seq, s, e, max(e) OVER (PARTITION BY seq ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hits),
cover AS (SELECT seq, sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS covered FROM ahead GROUP BY seq),
judged AS (SELECT r.*, r.end_b - r.start_b + 1 > coalesce(c.covered, 0) AS fresh FROM reads r LEFT JOIN cover c ON c.seq = r.seq),
opener AS (SELECT url, start_b, end_b, CASE WHEN fresh THEN sha256 END AS sha256 FROM (
  SELECT *, row_number() OVER (PARTITION BY url, start_b, end_b ORDER BY seq) AS rn FROM judged) q WHERE rn = 1),
told AS (SELECT j.url, j.end_b - j.start_b + 1 AS bytes, CASE WHEN x.sha256 IS NULL AND j.fresh THEN 'appended'
    WHEN coalesce(x.sha256, o.sha256) IS NULL THEN 'covered' WHEN coalesce(x.sha256, o.sha256) <> j.sha256 THEN 'content_changed'
    ELSE 'known' END AS outcome
  FROM judged j LEFT JOIN exact x ON x.url = j.url AND x.start_b = j.start_b AND x.end_b = j.end_b
  LEFT JOIN opener o ON o.url = j.url AND o.start_b = j.start_b AND o.end_b = j.end_b)
SELECT url, outcome, CAST(count(*) AS BIGINT) AS reads, CAST(sum(bytes) AS BIGINT) AS bytes FROM told GROUP BY url, outcome"""))
def record_reads(spark, sf):
    judged = cov.judge_reads(v.ledger(spark, sf), _batch(spark, sf))
    return judged.groupBy("url", "outcome").agg(F.count(F.lit(1)).alias("reads"), F.sum(cov.length()).alias("bytes"))


_LATER_SQL = """later AS (
  SELECT url, start_b, end_b, CASE WHEN (start_b + end_b) % 7 = 0 THEN first_read_at + INTERVAL 1 DAY ELSE first_read_at END
           AS first_read_at,
         CASE WHEN (start_b + end_b) % 5 = 0 THEN 'EXP-X' ELSE first_read_by END AS first_read_by, sha256
  FROM exact WHERE end_b % 11 <> 0)"""
_EXTENDS_SELECT = """
SELECT e.url, e.start_b, e.end_b,
  CASE WHEN l.url IS NULL THEN concat(split_part(e.url, '/', 2), ' [', e.start_b, ', ', e.end_b, ']: entry removed')
       ELSE concat(split_part(e.url, '/', 2), ' [', e.start_b, ', ', e.end_b, ']: ',
            CASE WHEN l.first_read_at <> e.first_read_at AND l.first_read_by <> e.first_read_by THEN 'first_read_at, first_read_by'
                 WHEN l.first_read_at <> e.first_read_at THEN 'first_read_at' ELSE 'first_read_by' END, ' changed') END AS problem
FROM exact e LEFT JOIN later l ON l.url = e.url AND l.start_b = e.start_b AND l.end_b = e.end_b
WHERE l.url IS NULL OR l.first_read_at <> e.first_read_at OR l.first_read_by <> e.first_read_by"""


def _later(entries):
    return entries.where("end_b % 11 <> 0").selectExpr(
        "url", "start_b", "end_b", "sha256",
        "CASE WHEN (start_b + end_b) % 7 = 0 THEN first_read_at + INTERVAL 1 DAY ELSE first_read_at END AS first_read_at",
        "CASE WHEN (start_b + end_b) % 5 = 0 THEN 'EXP-X' ELSE first_read_by END AS first_read_by")


@query("ledger_extends", v.sql("v_ledger", f"WITH {_EXACT_SQL}, {_LATER_SQL} {_EXTENDS_SELECT}"))
def ledger_extends(spark, sf):
    entries = cov.distinct_entries(v.ledger(spark, sf))
    return cov.extends(entries, _later(entries)).select("url", "start_b", "end_b", "problem")


_STEP_SQL = """SELECT {b} AS seq, e.url, e.start_b, e.end_b,
  concat(split_part(e.url, '/', 2), ' [', e.start_b, ', ', e.end_b, ']: ',
    CASE WHEN l.url IS NULL THEN 'entry removed' ELSE 'first_read_by changed' END) AS problem
FROM v{a} e LEFT JOIN v{b} l ON l.url = e.url AND l.start_b = e.start_b AND l.end_b = e.end_b
WHERE l.url IS NULL OR l.first_read_by <> e.first_read_by"""


@query("ledger_history", v.sql("v_ledger", f"""WITH {_EXACT_SQL.replace("exact AS (", "exact AS MATERIALIZED (")},
v1 AS (SELECT * FROM exact WHERE first_read_at < TIMESTAMP '1999-01-01'),
v4 AS (SELECT * FROM exact WHERE end_b % 13 <> 0),
v6 AS (SELECT url, start_b, end_b, CASE WHEN start_b % 900 = 0 THEN 'EXP-Y' ELSE first_read_by END AS first_read_by FROM exact)
{_STEP_SQL.format(a=1, b=4)} UNION ALL {_STEP_SQL.format(a=4, b=6)}"""))
def ledger_history(spark, sf):
    entries = cov.distinct_entries(v.ledger(spark, sf))
    # All versions come from one pass over the entries.
    held = F.expr("array_compact(array(CASE WHEN first_read_at < TIMESTAMP_NTZ '1999-01-01' THEN 1 END, CASE WHEN end_b % 13 <> 0 THEN 4 END, 6))")
    versions = entries.withColumn("seq", F.explode(held)).withColumn("first_read_by", F.expr(
        "CASE WHEN seq = 6 AND start_b % 900 = 0 THEN 'EXP-Y' ELSE first_read_by END"))
    return cov.history_extends(versions).select("seq", "url", "start_b", "end_b", "problem")


@query("ledger_accounted", v.sql("v_ledger v_wanted", """WITH known AS (
  SELECT DISTINCT concat('EXP-', c_custkey % 5) AS exp_id FROM customer),
rows_ AS (SELECT order_no, line_no, url, start_b, end_b,
    CASE WHEN line_no = 7 THEN 'exploration' ELSE first_read_by END AS first_read_by FROM v_ledger),
consumed AS (SELECT first_read_by AS exp_id, url, start_b, CASE WHEN line_no = 1 THEN end_b - 1 ELSE end_b END AS end_b
  FROM rows_),
spans AS (SELECT DISTINCT first_read_by, url, start_b, end_b FROM rows_),
hits AS (SELECT s.first_read_by, s.url, s.start_b AS ws, s.end_b AS we, greatest(c.start_b, s.start_b) AS s,
    least(c.end_b, s.end_b) AS e FROM spans s JOIN consumed c ON c.exp_id = s.first_read_by AND c.url = s.url
    AND c.start_b <= s.end_b AND c.end_b >= s.start_b),
ahead AS (SELECT *, max(e) OVER (PARTITION BY first_read_by, url, ws, we ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM hits),
cover AS (SELECT first_read_by, url, ws, we, sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS used
    FROM ahead GROUP BY first_read_by, url, ws, we)
SELECT r.first_read_by, CASE WHEN r.first_read_by = 'exploration' THEN 'foreign'
    WHEN k.exp_id IS NULL OR coalesce(c.used, 0) <> r.end_b - r.start_b + 1 THEN 'unaccounted' ELSE 'accounted' END AS state,
  CAST(count(*) AS BIGINT) AS entries, CAST(sum(r.end_b - r.start_b + 1) AS BIGINT) AS bytes
FROM rows_ r LEFT JOIN known k ON k.exp_id = r.first_read_by
LEFT JOIN cover c ON c.first_read_by = r.first_read_by AND c.url = r.url AND c.ws = r.start_b AND c.we = r.end_b
GROUP BY 1, 2"""))
def ledger_accounted(spark, sf):
    rows = v.ledger(spark, sf).withColumn("first_read_by", F.expr(
        "CASE WHEN line_no = 7 THEN 'exploration' ELSE first_read_by END"))
    consumed = rows.selectExpr("first_read_by AS exp_id", "url", "start_b",
                               "CASE WHEN line_no = 1 THEN end_b - 1 ELSE end_b END AS end_b")
    experiments = v.table(spark, sf, "customer").selectExpr("concat('EXP-', c_custkey % 5) AS exp_id")
    judged = cov.ledger_accounted(rows, consumed, experiments)
    return judged.groupBy("first_read_by", "state").agg(F.count(F.lit(1)).alias("entries"),
                                                        F.sum(cov.length()).alias("bytes"))


@query("exploration_data_check", v.sql("v_ledger v_wanted",
                                       f"""WITH {_COVER_SQL.format(extra=" AND l.first_read_at < w.moment + INTERVAL 1 SECOND")}
SELECT w.req_id, coalesce(c.covered, 0) = w.end_b - w.start_b + 1 AS seen_before
FROM v_wanted w LEFT JOIN cover c ON c.req_id = w.req_id"""))
def exploration_data_check(spark, sf):
    files = v.wanted(spark, sf).withColumn("sha256", F.lit("-"))
    return cov.check_exploration_data(files, v.ledger(spark, sf), "req_id", "moment").select("req_id", "seen_before")


_RESERVED_SQL = """reserved AS (SELECT concat('R-', c_custkey) AS exp_id, concat('obj/', c_nationkey) AS url,
    c_custkey * 90 AS start_b, c_custkey * 90 + 60 + c_custkey % 97 AS end_b FROM customer)"""


def _reserved(spark, sf):
    return v.table(spark, sf, "customer").selectExpr(
        "concat('R-', c_custkey) AS exp_id", "concat('obj/', c_nationkey) AS url",
        "c_custkey * 90 AS start_b", "c_custkey * 90 + 60 + c_custkey % 97 AS end_b")


@query("unacknowledged", v.sql("v_wanted", f"""WITH {_RESERVED_SQL},
asked AS (SELECT concat('obj/', s_nationkey) AS url, s_suppkey * 1000 AS start_b, s_suppkey * 1000 + 500 AS end_b FROM supplier),
ack AS (SELECT concat('R-', o_custkey) AS exp_id FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 4 = 0)
SELECT DISTINCT r.exp_id FROM reserved r JOIN asked a ON a.url = r.url AND a.start_b <= r.end_b AND a.end_b >= r.start_b
WHERE r.exp_id NOT IN (SELECT exp_id FROM ack)"""))
def unacknowledged(spark, sf):
    asked = v.table(spark, sf, "supplier").selectExpr("concat('obj/', s_nationkey) AS url", "s_suppkey * 1000 AS start_b",
                                                      "s_suppkey * 1000 + 500 AS end_b")
    ack = v.table(spark, sf, "orders").where("o_orderstatus = 'F' AND o_custkey % 4 = 0") \
        .selectExpr("concat('R-', o_custkey) AS exp_id")
    return cov.unacknowledged(asked, _reserved(spark, sf), ack)


@query("holdout_families", v.sql("v_wanted", f"""WITH RECURSIVE {_RESERVED_SQL},
spread AS (SELECT exp_id, concat('obj/', CAST(substr(exp_id, 3) AS BIGINT) % 2) AS url, start_b, end_b FROM reserved
  UNION ALL SELECT exp_id, url, start_b, end_b FROM reserved),
edges AS (SELECT DISTINCT a.exp_id AS a, b.exp_id AS b FROM spread a JOIN spread b ON a.url = b.url
  AND a.start_b <= b.end_b AND b.start_b <= a.end_b AND a.exp_id <> b.exp_id),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
named AS (SELECT node AS exp_id, min(seen) AS family FROM reach GROUP BY node)
SELECT family, exp_id FROM named"""))
def holdout_families(spark, sf):
    reserved = _reserved(spark, sf)
    spread = reserved.withColumn("url", F.expr("concat('obj/', CAST(substr(exp_id, 3) AS BIGINT) % 2)"))
    return cov.holdout_families(spread.unionByName(reserved))


@query("range_totals", v.sql("v_wanted", """SELECT exp_id, CAST(count(*) AS BIGINT) AS ranges,
  CAST(sum(end_b - start_b + 1) AS BIGINT) AS bytes FROM v_wanted GROUP BY exp_id"""))
def range_totals(spark, sf):
    return cov.range_totals(v.wanted(spark, sf), ["exp_id"])
