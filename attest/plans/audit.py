"""Comparison, audit and lineage queries: orders as runs, customers as experiments, line items as files."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from attest.operators import audit as au
from attest.operators import compare as cm
from attest.operators import coverage as cov
from attest.operators import lineage as ln
from attest.operators import rows as rw
from attest.plans import coverage as pc
from attest.plans import views as v
from attest.plans.registry import ORACLES, QUERIES, query


def _spark(text: str) -> str:
    text = re.sub(r"DAY<(.+?)>", r"(TIMESTAMP_NTZ '1996-01-01 00:00:00' + make_dt_interval(CAST(\1 AS INT)))", text)
    return re.sub(r"SHA<(.+?)>", r"sha2(\1, 256)", text)


def _duck(text: str) -> str:
    text = re.sub(r"DAY<(.+?)>", r"(TIMESTAMP '1996-01-01 00:00:00' + to_days(CAST(\1 AS INTEGER)))", text)
    return re.sub(r"SHA<(.+?)>", r"sha256(\1)", text)


VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_exp": ("customer", [
        "c_custkey", "concat('X-', c_custkey) AS exp_id", "c_name AS title", "DAY<c_custkey % 1500> AS created_at",
        "SHA<concat('X-', c_custkey)> AS definition_sha256", "c_custkey % 3 = 0 AS holdout"]),
    "v_run": ("orders", [
        "o_orderkey", "concat('R-', o_orderkey) AS run_id", "concat('X-', o_custkey) AS exp_id",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'error' ELSE 'inconclusive' END END AS status",
        "CASE o_orderstatus WHEN 'F' THEN 'not_supported' WHEN 'O' THEN 'supported' ELSE 'insufficient_evidence' END AS verdict",
        "o_orderdate AS started_at", "o_totalprice AS total", "o_custkey % 40 AS seed",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'other' ELSE SHA<concat('X-', o_custkey)> END AS definition_sha256",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE concat('c', o_custkey % 200) END AS commit_id",
        "CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 3 > 0 THEN 'origin/main' END AS pushed_to",
        "concat('src', o_custkey % 70) AS source_sha256", "concat('sub', o_orderkey) AS submission_sha256",
        "SHA<concat('result', o_orderkey)> AS result_sha256"]),
    "v_art": ("lineitem", [
        "concat('R-', l_orderkey) AS run_id", "concat('f', l_linenumber, '-', l_suppkey) AS name",
        "CASE WHEN l_suppkey % 41 = 0 THEN NULL ELSE concat('runs/', l_orderkey, '/', l_partkey) END AS uri",
        "SHA<concat('x', l_partkey)> AS sha256", "l_partkey * 10 AS bytes", "l_linenumber = 7 AS stored"]),
    "v_inv": ("lineitem", [
        "concat('runs/', l_orderkey, '/', l_partkey) AS uri", "SHA<concat(CASE WHEN l_partkey % 17 = 0 THEN 'y' ELSE 'x' END, l_partkey)> AS sha256",
        "CASE WHEN l_partkey % 19 = 0 THEN 1 ELSE l_partkey * 10 END AS bytes"]),
    "v_ver": ("lineitem", [
        "concat('X-', l_partkey % 1600) AS doc", "l_orderkey * 10 + l_linenumber AS seq", "concat('c', l_suppkey % 200) AS commit_id",
        "l_shipdate AS committed_at", "CASE WHEN l_partkey % 4 = 0 THEN concat('v', l_returnflag) ELSE 'v' END AS content"]),
}


def view(spark, sf, name):
    base, columns = VIEWS[name]
    return v.table(spark, sf, base).selectExpr(*[_spark(c) for c in columns])


def sql(names: str, body: str) -> str:
    heads = [f"{n} AS (SELECT {', '.join(_duck(c) for c in VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names.split()]
    body = body.strip()
    recursive = body.lower().startswith("with recursive ")
    rest = body[15:] if recursive else body[5:] if body.lower().startswith("with ") else None
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(heads)
    return _duck(head + (",\n" + rest if rest else "\n" + body))


def inventory(spark, sf):
    """Files found: one row per path, gone where the part number ends in 3."""
    rows = view(spark, sf, "v_inv").where("NOT uri LIKE '%3'").withColumn("_h", F.unhex("sha256"))  # hashes move in half their length
    return rows.groupBy("uri").agg(F.min(F.struct("_h", "bytes")).alias("f")).select("uri", F.lower(F.hex("f._h")).alias("sha256"), "f.bytes")


_INV = "inv AS (SELECT uri, min(sha256) AS sha256, min(bytes) AS bytes FROM v_inv WHERE NOT uri LIKE '%3' GROUP BY uri)"


@query("artifact_hashes", sql("v_art v_inv", f"""WITH {_INV}
SELECT a.run_id, a.name, a.uri, CASE WHEN a.stored THEN 'stored' WHEN i.uri IS NULL THEN 'missing'
  WHEN i.sha256 <> a.sha256 OR i.bytes <> a.bytes THEN 'changed' ELSE 'ok' END AS state FROM v_art a LEFT JOIN inv i ON i.uri = a.uri"""))
def artifact_hashes(spark, sf):
    return au.check_artifacts(view(spark, sf, "v_art"), inventory(spark, sf)).select("run_id", "name", "uri", "state")


_ART_CHECK = """judged AS (SELECT a.run_id, coalesce(a.uri, a.name) AS label, CASE WHEN a.stored THEN 'stored' WHEN i.uri IS NULL THEN 'missing'
  WHEN i.sha256 <> a.sha256 OR i.bytes <> a.bytes THEN 'changed' ELSE 'ok' END AS state FROM v_art a LEFT JOIN inv i ON i.uri = a.uri),
agg AS (SELECT run_id, count(*) FILTER (state <> 'stored') AS checked, count(*) FILTER (state IN ('missing', 'changed')) AS bad,
  array_to_string(list_sort(list(concat(label, ' ', state)) FILTER (state IN ('missing', 'changed')))[1:5], '; ') AS texts FROM judged GROUP BY run_id)"""


@query("run_artifact_checks", sql("v_run v_art v_inv", f"""WITH {_INV}, {_ART_CHECK}
SELECT 'run.artifacts' AS name, r.run_id AS subject, CASE WHEN g.bad > 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN g.bad > 0 THEN concat(g.texts, CASE WHEN g.bad > 5 THEN concat('; and ', g.bad - 5, ' more') ELSE '' END)
    ELSE concat(coalesce(g.checked, 0), ' artifacts match their recorded SHA-256') END AS detail
FROM v_run r LEFT JOIN agg g ON g.run_id = r.run_id"""))
def run_artifact_checks(spark, sf):
    return au.artifact_checks(view(spark, sf, "v_run"), view(spark, sf, "v_art"), inventory(spark, sf))


_FIELDS = ["total", "seed", "started_at", "exp_id"]


def _submissions(spark, sf):
    return view(spark, sf, "v_run").where("o_orderkey % 21 <> 0").withColumn(
        "total", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN total + 1 ELSE total END")).withColumn(
        "seed", F.expr("CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE seed END"))


_DIVERGED = ("CASE WHEN o_orderkey % 21 = 0 THEN NULL ELSE concat_ws(', ', CASE WHEN o_orderkey % 9 = 0 THEN 'seed' END, "
             "CASE WHEN o_orderkey % 6 = 0 THEN 'total' END) END")


@query("record_divergence", sql("v_run", f"SELECT run_id, {_DIVERGED} AS diverged FROM v_run"))
def record_divergence(spark, sf):
    rows = au.record_divergence(view(spark, sf, "v_run"), _submissions(spark, sf), _FIELDS)
    return rows.withColumn("diverged", F.array_join("diverged", ", "))


@query("run_submission_checks", sql("v_run", f"""WITH d AS (SELECT run_id, {_DIVERGED} AS x FROM v_run)
SELECT 'run.submission' AS name, run_id AS subject, CASE WHEN x = '' THEN 'ok' ELSE 'fail' END AS status,
  CASE WHEN x IS NULL THEN 'no submission hashes to the recorded submission_sha256' WHEN x <> '' THEN concat('the record''s ', x, ' differ from its submission')
  ELSE 'the record still says what its submission said' END AS detail FROM d"""))
def run_submission_checks(spark, sf):
    return au.submission_checks(view(spark, sf, "v_run"), _submissions(spark, sf), _FIELDS)


@query("unrecorded_runs", sql("v_run v_art", """SELECT 'runs.unrecorded' AS name, a.run_id AS subject, 'warn' AS status, 'an attempt with no record' AS detail
FROM (SELECT DISTINCT run_id FROM v_art) a WHERE a.run_id NOT IN (SELECT run_id FROM v_run WHERE o_orderkey % 8 <> 0)"""))
def unrecorded_runs(spark, sf):
    return au.unrecorded(view(spark, sf, "v_art"), view(spark, sf, "v_run").where("o_orderkey % 8 <> 0"), "run_id", "runs.unrecorded",
                         "an attempt with no record")


@query("run_timing_checks", sql("v_run v_exp", """SELECT 'run.timing' AS name, r.run_id AS subject,
  CASE WHEN e.created_at <= r.started_at THEN 'ok' ELSE 'fail' END AS status,
  CASE WHEN e.created_at <= r.started_at THEN 'the registration existed before the run started' ELSE 'the run started before its registration existed' END AS detail
FROM v_run r JOIN v_exp e ON e.exp_id = r.exp_id"""))
def run_timing_checks(spark, sf):
    return au.timing_checks(view(spark, sf, "v_run"), view(spark, sf, "v_exp"))


def versions(spark, sf):
    return view(spark, sf, "v_ver").withColumnRenamed("commit_id", "commit")


def anchored(spark, sf):
    docs = view(spark, sf, "v_exp").select(F.col("exp_id").alias("doc"))
    return au.anchors(docs, versions(spark, sf))


_FIRST = """f AS (SELECT doc, commit_id, committed_at FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq, commit_id, committed_at) AS rn FROM v_ver) q WHERE rn = 1),
c AS (SELECT doc, count(DISTINCT content) AS contents FROM v_ver GROUP BY doc),
anch AS (SELECT e.exp_id AS doc, f.commit_id AS commit, f.committed_at, CAST(c.contents AS BIGINT) AS contents,
  CASE WHEN f.doc IS NULL THEN 'not_anchored' WHEN c.contents > 1 THEN 'changed' ELSE 'anchored' END AS state
  FROM v_exp e LEFT JOIN f ON f.doc = e.exp_id LEFT JOIN c ON c.doc = e.exp_id)"""


@query("registration_anchor", sql("v_exp v_ver", f"WITH {_FIRST} SELECT * FROM anch"))
def registration_anchor(spark, sf):
    return anchored(spark, sf)


@query("registration_history_checks", sql("v_exp v_ver", f"""WITH {_FIRST} SELECT 'registration.history' AS name, doc AS subject,
  CASE state WHEN 'anchored' THEN 'ok' WHEN 'changed' THEN 'fail' ELSE 'warn' END AS status,
  CASE state WHEN 'anchored' THEN concat('first committed in ', commit, ', unchanged since') WHEN 'changed' THEN
    concat('changed after its first commit (', contents, ' versions)') ELSE 'not committed: no timestamp proves when it was written' END AS detail FROM anch"""))
def registration_history_checks(spark, sf):
    return au.history_checks(anchored(spark, sf))


@query("anchor_cutoff", """SELECT event_id, date_trunc('second', ts) + INTERVAL 1 SECOND AS cutoff FROM events""")
def anchor_cutoff(spark, sf):
    return v.table(spark, sf, "events").select("event_id", au.anchor_cutoff(F.col("ts")).cast("timestamp_ntz").alias("cutoff"))


def _digests(spark, sf):
    return view(spark, sf, "v_ver").selectExpr("concat('src', seq % 60) AS digest", "seq", "commit_id AS commit")


_DIGESTS = """dg AS (SELECT digest, commit_id FROM (SELECT concat('src', seq % 60) AS digest, commit_id,
  row_number() OVER (PARTITION BY seq % 60 ORDER BY seq, commit_id) AS rn FROM v_ver) q WHERE rn = 1)"""


@query("resolve_digest", sql("v_run v_ver", f"WITH {_DIGESTS} SELECT r.run_id, r.source_sha256, d.commit_id AS source_commit FROM v_run r LEFT JOIN dg d ON d.digest = r.source_sha256"))
def resolve_digest(spark, sf):
    return au.resolve_digest(view(spark, sf, "v_run"), _digests(spark, sf)).select("run_id", "source_sha256", "source_commit")


@query("run_code_checks", sql("v_run v_ver", f"""WITH {_DIGESTS} SELECT 'run.code' AS name, r.run_id AS subject, CASE WHEN d.commit_id IS NULL THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN d.commit_id IS NULL THEN 'the source is in no commit: the run used uncommitted code' ELSE concat('source is commit ', d.commit_id) END AS detail
FROM v_run r LEFT JOIN dg d ON d.digest = r.source_sha256"""))
def run_code_checks(spark, sf):
    return au.code_checks(view(spark, sf, "v_run"), _digests(spark, sf))


def _held(spark, sf):
    """What each commit held of a document: one row per (doc, commit)."""
    rows = view(spark, sf, "v_exp").withColumn("commit", F.expr("concat('c', c_custkey % 200)")).where("c_custkey % 11 <> 0")
    return rows.select(F.col("exp_id").alias("doc"), "commit", F.col("created_at").alias("committed_at"), "definition_sha256",
                       F.expr("c_custkey % 14 <> 0").alias("in_history"))


def _anchored_runs(spark, sf):
    return view(spark, sf, "v_run").withColumn("doc", F.col("exp_id")).withColumnRenamed("commit_id", "commit")


@query("run_anchor_checks", sql("v_run v_exp", """WITH h AS (SELECT exp_id AS doc, concat('c', c_custkey % 200) AS commit_id, created_at AS committed_at, definition_sha256,
    c_custkey % 14 <> 0 AS in_history FROM v_exp WHERE c_custkey % 11 <> 0),
j AS (SELECT r.run_id, r.commit_id, CASE WHEN h.doc IS NULL THEN 'it is not in this repository' ELSE concat_ws('; ',
    CASE WHEN h.definition_sha256 <> r.definition_sha256 THEN 'it does not hold this registration' END,
    CASE WHEN NOT h.in_history THEN 'it is not in the history' END,
    CASE WHEN h.committed_at > r.started_at THEN 'it was committed after the run started' END) END AS p
  FROM v_run r LEFT JOIN h ON h.doc = r.exp_id AND h.commit_id = r.commit_id)
SELECT 'run.anchor' AS name, run_id AS subject, CASE WHEN commit_id IS NULL THEN 'warn' WHEN p <> '' THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN commit_id IS NULL THEN 'the registration was not anchored before this run' ELSE concat('anchor ', commit_id, ': ',
    CASE WHEN p <> '' THEN p ELSE 'holds the registration, is in history, and predates the run' END) END AS detail FROM j"""))
def run_anchor_checks(spark, sf):
    return au.anchor_checks(_anchored_runs(spark, sf), _held(spark, sf))


@query("run_published_checks", sql("v_run", """SELECT 'run.published' AS name, run_id AS subject, CASE WHEN pushed_to IS NULL THEN 'warn' ELSE 'ok' END AS status,
  CASE WHEN pushed_to IS NULL THEN 'the anchor had not been pushed when the run started' ELSE concat('the anchor was on ', pushed_to, ' when the run started') END AS detail
FROM v_run WHERE commit_id IS NOT NULL"""))
def run_published_checks(spark, sf):
    return au.published_checks(_anchored_runs(spark, sf))


@query("run_summary_checks", sql("v_run", """SELECT 'run.summary' AS name, run_id AS subject, CASE WHEN o_orderkey % 10 = 0 THEN 'warn' WHEN o_orderkey % 7 = 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'disagrees with the record' ELSE 'agrees with the record' END AS detail FROM v_run"""))
def run_summary_checks(spark, sf):
    runs = view(spark, sf, "v_run")
    copies = runs.where("o_orderkey % 10 <> 0").withColumn("verdict", F.expr("CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE verdict END"))
    return au.field_checks(runs, copies, "run.summary", ["status", "verdict", "total"])


@query("run_report_checks", sql("v_run", """SELECT 'run.report' AS name, run_id AS subject, CASE o_orderkey % 5 WHEN 0 THEN 'warn' WHEN 1 THEN 'fail' WHEN 2 THEN 'fail' ELSE 'ok' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'the report is missing' WHEN 1 THEN 'the report states another outcome' WHEN 2 THEN 'the report states another outcome'
  ELSE 'the report states the recorded outcome' END AS detail FROM v_run"""))
def run_report_checks(spark, sf):
    runs = view(spark, sf, "v_run")
    heading = F.expr("""CASE o_orderkey % 5 WHEN 1 THEN concat('# ', run_id, ': OTHER') WHEN 2 THEN concat('# ', run_id, '0: ', upper(status))
        WHEN 3 THEN concat('# ', run_id, ': ', upper(status)) ELSE concat('# ', exp_id, ' ', run_id, ': ', upper(status)) END""")
    return au.report_checks(runs, runs.where("o_orderkey % 5 <> 0").withColumn("heading", heading))


# Comparison
_REC = [("total", "total"), ("seed", "CAST(seed AS DOUBLE)")]


def _measured(spark, sf, replay: bool):
    rows = view(spark, sf, "v_run")
    if replay:
        rows = rows.where("o_orderkey % 10 <> 0").withColumn("total", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN total + 0.5 ELSE total END"))
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("value")) for n, e in _REC])
    return rows.select("o_orderkey", "run_id", F.inline(pairs)).where("NOT (name = 'seed' AND o_orderkey % 4 = 1)" if replay else "true").drop("o_orderkey")


_CMP = """a AS (SELECT run_id, 'total' AS name, total AS value FROM v_run UNION ALL SELECT run_id, 'seed', CAST(seed AS DOUBLE) FROM v_run),
b AS (SELECT run_id, 'total' AS name, CASE WHEN o_orderkey % 6 = 0 THEN total + 0.5 ELSE total END AS value FROM v_run WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT run_id, 'seed', CAST(seed AS DOUBLE) FROM v_run WHERE o_orderkey % 10 <> 0 AND o_orderkey % 4 <> 1),
cmp AS (SELECT coalesce(a.run_id, b.run_id) AS run_id, coalesce(a.name, b.name) AS name, a.value AS recorded, b.value AS replayed,
  a.value IS NOT DISTINCT FROM b.value AS identical, round(b.value - a.value, 6) AS difference FROM a FULL JOIN b ON a.run_id = b.run_id AND a.name = b.name)"""


@query("compare_measurements", sql("v_run", f"WITH {_CMP} SELECT * FROM cmp"))
def compare_measurements(spark, sf):
    return cm.compare_measurements(_measured(spark, sf, False), _measured(spark, sf, True)).withColumn("difference", F.round("difference", 6))


def _series(spark, sf, replay: bool):
    rows = v.table(spark, sf, "orders").selectExpr("o_custkey AS run_id", "o_orderstatus AS name", "o_orderkey AS idx", "o_totalprice AS value")
    if replay:
        rows = rows.where("NOT (run_id % 5 = 0 AND idx % 9 = 0)").withColumn("value", F.expr(
            "CASE WHEN run_id % 7 = 0 AND idx % 3 = 0 THEN value + 0.25 ELSE value END"))
    return rows


_SERIES = """sa AS (SELECT o_custkey AS run_id, o_orderstatus AS name, o_orderkey AS idx, o_totalprice AS value FROM orders),
sb AS (SELECT run_id, name, idx, CASE WHEN run_id % 7 = 0 AND idx % 3 = 0 THEN value + 0.25 ELSE value END AS value FROM sa WHERE NOT (run_id % 5 = 0 AND idx % 9 = 0)),
scmp AS (SELECT sa.run_id, sa.name, CAST(count(*) AS BIGINT) AS recorded_n, CASE WHEN count(sb.idx) > 0 THEN CAST(count(sb.idx) AS BIGINT) END AS replayed_n,
  bool_and(sb.idx IS NOT NULL AND sa.value IS NOT DISTINCT FROM sb.value) AS identical,
  CASE WHEN count(*) = count(sb.idx) THEN round(max(abs(sa.value - sb.value)), 6) END AS max_abs_difference
  FROM sa LEFT JOIN sb ON sa.run_id = sb.run_id AND sa.name = sb.name AND sa.idx = sb.idx GROUP BY sa.run_id, sa.name)"""


@query("compare_series", f"WITH {_SERIES} SELECT * FROM scmp")
def compare_series(spark, sf):
    return cm.compare_series(_series(spark, sf, False), _series(spark, sf, True)).withColumn("max_abs_difference", F.round("max_abs_difference", 6))


def _document(spark, sf, replay: bool):
    o = v.table(spark, sf, "orders")
    k = "o_orderkey"
    total = f"CASE WHEN {k} % 4 = 0 THEN 2 * o_totalprice ELSE o_totalprice END" if replay else "o_totalprice"
    status = f"CASE WHEN {k} % 9 = 0 THEN NULL ELSE o_orderstatus END" if replay else "o_orderstatus"
    listed = f"CASE WHEN {k} % 7 = 0 THEN array(o_custkey, {k}, {k}) ELSE array(o_custkey, CASE WHEN {k} % 5 = 0 THEN -1 ELSE {k} END) END" \
        if replay else f"array(o_custkey, {k})"
    return o.select(F.col(k).alias("doc"), F.expr(f"to_json(struct(struct({total} AS k, {status} AS s) AS a, {listed} AS list, 'x' AS t))").alias("text"))


@query("diff_documents", """WITH d AS (SELECT o_orderkey AS doc, o_orderkey % 4 = 0 AND o_totalprice <> 0 AS k, o_orderkey % 9 = 0 AS s, o_orderkey % 7 = 0 AS l, o_orderkey % 7 <> 0 AND o_orderkey % 5 = 0 AS e,
  o_totalprice AS price FROM orders)
SELECT doc, NOT (k OR s OR l OR e) AS identical, CAST(k::INT + s::INT + l::INT + e::INT AS BIGINT) AS differing_values,
  concat_ws(' ', CASE WHEN k THEN '/a/k' END, CASE WHEN s THEN '/a/s' END, CASE WHEN l THEN '/list' END, CASE WHEN e THEN '/list/1' END) AS first_differences,
  CASE WHEN l THEN NULL ELSE round(greatest(CASE WHEN k THEN price ELSE 0 END, CASE WHEN e THEN CAST(doc + 1 AS DOUBLE) ELSE 0 END), 6) END AS max_abs_difference FROM d""")
def diff_documents(spark, sf):
    a, b = (cm.flatten_json(_document(spark, sf, r), ["doc"], "text") for r in (False, True))
    rows = cm.diff_documents(a, b, ["doc"])
    return rows.withColumn("first_differences", F.coalesce(F.array_join("first_differences", " "), F.lit(""))) \
        .withColumn("max_abs_difference", F.round("max_abs_difference", 6))


def _files(spark, sf):
    return v.ledger(spark, sf).select(F.col("order_no").alias("run_id"), "line_no", "url", "start_b", "end_b", F.expr(
        "CASE WHEN line_no = 2 THEN sha2('changed', 256) ELSE sha256 END").alias("sha256"))


@query("compare_data", v.sql("v_ledger", """WITH files AS (SELECT order_no AS run_id, line_no, url, CASE WHEN line_no = 3 THEN start_b + 1 ELSE start_b END AS start_b, end_b,
    CASE WHEN line_no = 2 THEN sha256('changed') ELSE sha256 END AS sha256 FROM v_ledger),
used AS (SELECT DISTINCT order_no AS run_id, url, start_b, end_b, sha256 FROM v_ledger WHERE line_no <> 5),
logged AS (SELECT DISTINCT url, start_b, end_b, sha256 FROM v_ledger)
SELECT f.run_id, CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (coalesce(l.sha256, f.sha256) = f.sha256) AS BIGINT) AS ledger_matches,
  CAST(count(*) FILTER (coalesce(u.sha256 = f.sha256, false)) AS BIGINT) AS run_matches
FROM files f LEFT JOIN logged l ON l.url = f.url AND l.start_b = f.start_b AND l.end_b = f.end_b
LEFT JOIN used u ON u.run_id = f.run_id AND u.url = f.url AND u.start_b = f.start_b AND u.end_b = f.end_b GROUP BY f.run_id"""))
def compare_data(spark, sf):
    files = _files(spark, sf).withColumn("start_b", F.expr("CASE WHEN line_no = 3 THEN start_b + 1 ELSE start_b END"))
    used = v.ledger(spark, sf).where("line_no <> 5").select(F.col("order_no").alias("run_id"), "url", "start_b", "end_b", "sha256").distinct()
    rows = cm.compare_data(files, v.ledger(spark, sf), used)
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("files"), F.count_if("matches_ledger").alias("ledger_matches"),
                                      F.count_if("matches_run").alias("run_matches"))


_FACTS = ["o_orderkey % 31 = 0 AS error", "o_orderkey % 11 <> 0 AS same_status", "o_orderkey % 13 <> 0 AS same_verdict",
          "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 17 <> 0 END AS data_identical", "o_orderkey % 5 <> 0 AS measurements_identical",
          "o_orderkey % 7 <> 0 AS series_identical", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 9 <> 0 END AS report_identical"]
_OUTCOME = """CASE WHEN error THEN 'error' WHEN NOT same_status OR NOT same_verdict THEN 'verdict-differs'
  WHEN NOT coalesce(data_identical, true) OR NOT measurements_identical THEN 'verdict-reproduced'
  WHEN series_identical AND coalesce(report_identical, true) THEN 'reproduced' ELSE 'measurements-reproduced' END"""


@query("outcome", f"SELECT o_orderkey AS run_id, {_OUTCOME} AS outcome FROM (SELECT o_orderkey, {', '.join(_FACTS)} FROM orders) q")
def outcome(spark, sf):
    facts = v.table(spark, sf, "orders").selectExpr("o_orderkey AS run_id", *_FACTS)
    return facts.select("run_id", cm.outcome().alias("outcome"))


@query("comparison_facts", sql("v_run", f"""WITH {_CMP}, {_SERIES},
m AS (SELECT run_id, bool_and(identical) AS measurements_identical FROM cmp GROUP BY run_id),
s AS (SELECT concat('R-', run_id) AS run_id, bool_and(identical) AS series_identical FROM scmp GROUP BY run_id)
SELECT coalesce(m.run_id, s.run_id) AS run_id, measurements_identical, series_identical FROM m FULL JOIN s ON s.run_id = m.run_id"""))
def comparison_facts(spark, sf):
    series = cm.compare_series(_series(spark, sf, False), _series(spark, sf, True)).withColumn("run_id", F.concat(F.lit("R-"), "run_id"))
    return cm.comparison_facts(cm.compare_measurements(_measured(spark, sf, False), _measured(spark, sf, True)), series)


@query("receipt_checks", sql("v_run", f"""WITH f AS (SELECT o_orderkey, {', '.join(_FACTS)} FROM orders),
q AS (SELECT r.o_orderkey, r.run_id, {_OUTCOME} AS implied FROM v_run r JOIN f ON f.o_orderkey = r.o_orderkey),
p AS (SELECT *, CASE WHEN o_orderkey % 8 = 0 THEN 'reproduced' ELSE implied END AS stated FROM q),
t AS (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN concat(run_id, ' is not recorded') ELSE concat_ws('; ',
    CASE WHEN o_orderkey % 6 = 0 THEN 'the run record changed since the replay' END,
    CASE WHEN implied <> stated THEN concat('its comparison implies ''', implied, ''', not ''', stated, '''') END) END AS problem FROM p)
SELECT 'receipt.binding' AS name, concat('replays/', o_orderkey) AS subject, CASE WHEN problem = '' THEN 'ok' ELSE 'fail' END AS status,
  CASE WHEN problem = '' THEN concat(run_id, ': ', stated) ELSE problem END AS detail FROM t"""))
def receipt_checks(spark, sf):
    facts = v.table(spark, sf, "orders").selectExpr("o_orderkey", *_FACTS)
    runs = view(spark, sf, "v_run")
    receipts = runs.select("o_orderkey", "run_id", "result_sha256").join(facts, "o_orderkey").withColumn("_i", cm.outcome())
    receipts = receipts.withColumn("outcome", F.expr("CASE WHEN o_orderkey % 8 = 0 THEN 'reproduced' ELSE _i END")) \
        .withColumn("result_sha256", F.expr("CASE WHEN o_orderkey % 6 = 0 THEN 'old' ELSE result_sha256 END")) \
        .withColumn("receipt", F.concat(F.lit("replays/"), "o_orderkey"))
    return cm.check_receipts(receipts, runs.where("o_orderkey % 50 <> 0"))


@query("latest_completed", sql("v_run", """SELECT exp_id, run_id, status, started_at FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY started_at DESC, run_id DESC) AS rn
FROM v_run WHERE status <> 'error') q WHERE rn = 1"""))
def latest_completed(spark, sf):
    return cm.latest_completed(view(spark, sf, "v_run"))


@query("first_problems", """SELECT l_suppkey, array_to_string(list_slice(list_sort(list(concat('p', l_partkey, '/', l_orderkey, '/', l_linenumber))), 1, 5), ' ') AS problems,
  CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY l_suppkey""")
def first_problems(spark, sf):
    p = v.table(spark, sf, "lineitem").selectExpr("l_suppkey", "concat('p', l_partkey, '/', l_orderkey, '/', l_linenumber) AS problem")
    few = cm.first_rows(p, ["l_suppkey"], "problem", 5, "problems").withColumn("problems", F.array_join("problems", " "))
    return few.join(p.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")), "l_suppkey")


# Holdout, data and ledger checks on the byte-range views
def _reserved(spark, sf):
    return v.wanted(spark, sf).selectExpr("concat('X-', req_id % 1500) AS exp_id", "url", "start_b", "end_b")


_RES = "res AS (SELECT DISTINCT concat('X-', req_id % 1500) AS exp_id, url, start_b, end_b FROM v_wanted)"


def _early_sql(name: str, times: str, what: str, missing: str) -> str:
    return f"""SELECT '{name}' AS name, s.exp_id AS subject, CASE WHEN t.at IS NULL THEN 'warn' WHEN s2.early > 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN t.at IS NULL THEN '{missing}' ELSE concat(s2.early, ' of ', s2.total, ' holdout bytes were first read before {what}') END AS detail
FROM (SELECT DISTINCT exp_id FROM res) s LEFT JOIN {times} t ON t.exp_id = s.exp_id
LEFT JOIN (SELECT r.exp_id, sum(coalesce(c.covered, 0)) AS early, sum(r.end_b - r.start_b + 1) AS total FROM res r
  LEFT JOIN {times}_cover c ON c.exp_id = r.exp_id AND c.url = r.url AND c.ws = r.start_b AND c.we = r.end_b GROUP BY r.exp_id) s2 ON s2.exp_id = s.exp_id"""


def _times_cover(times: str) -> str:
    return f"""{times}_hits AS (SELECT r.exp_id, r.url, r.start_b AS ws, r.end_b AS we, greatest(l.start_b, r.start_b) AS s, least(l.end_b, r.end_b) AS e
  FROM res r JOIN {times} t ON t.exp_id = r.exp_id JOIN v_ledger l ON l.url = r.url AND l.start_b <= r.end_b AND l.end_b >= r.start_b AND l.first_read_at < t.at),
{times}_ahead AS (SELECT *, max(e) OVER (PARTITION BY exp_id, url, ws, we ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {times}_hits),
{times}_cover AS (SELECT exp_id, url, ws, we, sum(greatest(0, e - greatest(s, coalesce(m + 1, s)) + 1)) AS covered FROM {times}_ahead GROUP BY 1, 2, 3, 4)"""


def _merge(first: str, second: str) -> str:
    """Join two WITH heads into one."""
    return first.rstrip() + ",\n" + second


@query("holdout_checks", _merge(sql("v_exp v_ver", f"WITH {_FIRST}, x AS (SELECT 1)"), v.sql(
    "v_ledger v_wanted", f"""WITH {_RES}, reg AS (SELECT exp_id, created_at AS at FROM v_exp),
anc AS (SELECT doc AS exp_id, date_trunc('second', committed_at) + INTERVAL 1 SECOND AS at FROM anch WHERE committed_at IS NOT NULL),
{_times_cover('reg')}, {_times_cover('anc')}
{_early_sql('holdout.before_registration', 'reg', 'the registration', 'no time')} UNION ALL
{_early_sql('holdout.before_anchor', 'anc', 'the anchor', 'the registration is not committed, so it has no anchor')}""")[5:]))
def holdout_checks(spark, sf):
    first = anchored(spark, sf).withColumnRenamed("doc", "exp_id")
    return au.holdout_checks(view(spark, sf, "v_exp"), _reserved(spark, sf), v.ledger(spark, sf), first)


@query("snapshot_checks")
def snapshot_checks(spark, sf):
    ledger = cov.distinct_entries(v.ledger(spark, sf))
    snaps = ledger.withColumn("snapshot", F.explode(F.array(F.lit("clean"), F.lit("full"), F.lit("broken")))) \
        .where("snapshot <> 'clean' OR url = 'part/0'") \
        .withColumn("first_read_by", F.expr("CASE WHEN snapshot = 'broken' AND end_b % 10 = 9 THEN 'EXP-Z' ELSE first_read_by END"))
    bound = view(spark, sf, "v_exp").selectExpr("exp_id", "c_custkey % 6 <> 0 AS has_binding", """CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'clean'
        WHEN 2 THEN 'full' WHEN 3 THEN 'broken' ELSE 'lost' END AS snapshot""")
    return au.snapshot_checks(bound, snaps, _reserved(spark, sf), ledger)


def _problems_sql(name: str, subjects: str, fine: str) -> str:
    """One check per row of ``subjects(subject)`` from ``bad(subject, problem)``: the first five problems and how many there are."""
    return f"""SELECT '{name}' AS name, s.subject, CASE WHEN b.n > 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN b.n > 0 THEN concat(b.shown, CASE WHEN b.n > 5 THEN concat('; and ', b.n - 5, ' more') ELSE '' END) ELSE {fine} END AS detail
FROM {subjects} s LEFT JOIN (SELECT subject, count(*) AS n, string_agg(problem, '; ' ORDER BY problem) FILTER (rn <= 5) AS shown FROM (
  SELECT *, row_number() OVER (PARTITION BY subject ORDER BY problem) AS rn FROM bad) q GROUP BY subject) b ON b.subject = s.subject"""


@query("run_data_checks", v.sql("v_ledger", sql("v_run", f"""WITH {pc._EXACT_SQL}, reads AS (
  SELECT concat('R-', order_no) AS subject, concat('rec', line_no) AS record, url, start_b, CASE WHEN line_no = 3 THEN end_b + 4000 ELSE end_b END AS end_b,
    CASE WHEN line_no = 2 THEN sha256('changed') ELSE sha256 END AS sha256 FROM v_ledger),
{pc._SEEN_TAIL.format(reads='reads')}, judged AS (
  SELECT r.subject, concat(r.record, CASE WHEN x.sha256 <> r.sha256 THEN ': content differs from the ledger'
    WHEN x.sha256 IS NULL AND r.end_b - r.start_b + 1 > coalesce(c.covered, 0) THEN ': bytes the ledger never logged' END) AS problem, x.sha256 <> r.sha256 OR
    (x.sha256 IS NULL AND r.end_b - r.start_b + 1 > coalesce(c.covered, 0)) AS broken
  FROM reads r LEFT JOIN cover c ON c.url = r.url AND c.ws = r.start_b AND c.we = r.end_b
  LEFT JOIN exact x ON x.url = r.url AND x.start_b = r.start_b AND x.end_b = r.end_b),
bad AS (SELECT subject, problem FROM judged WHERE broken),
sizes AS (SELECT r.run_id AS subject, count(*) AS files FROM v_run r JOIN reads f ON f.subject = r.run_id GROUP BY r.run_id)
{_problems_sql('run.data', 'sizes', "concat(s.files, ' byte ranges logged in the ledger with identical content')")}
UNION ALL SELECT 'run.data', run_id, CASE WHEN status = 'error' THEN 'warn' ELSE 'fail' END, 'the run records no dataset files' FROM v_run
WHERE run_id NOT IN (SELECT subject FROM sizes)""")))
def run_data_checks(spark, sf):
    files = _files(spark, sf).selectExpr("concat('R-', run_id) AS run_id", "concat('rec', line_no) AS record", "url", "start_b",
                                         "CASE WHEN line_no = 3 THEN end_b + 4000 ELSE end_b END AS end_b", "sha256")
    return au.run_data_checks(view(spark, sf, "v_run"), files, v.ledger(spark, sf))


@query("ledger_checks", v.sql("v_ledger", f"""WITH bad AS (SELECT 'ledger' AS subject, problem FROM ({ORACLES["ledger_history"]}) h),
one AS (SELECT 'ledger' AS subject), states AS (
  SELECT count(*) FILTER (first_read_by = 'exploration') AS f, count(*) FILTER (first_read_by <> 'exploration' AND first_read_by NOT IN (
    SELECT concat('EXP-', s_suppkey % 7) FROM supplier)) AS u FROM v_ledger)
{_problems_sql('ledger.history', 'one', "'append-only across all versions'")}
UNION ALL SELECT 'ledger.accounted', 'ledger', CASE WHEN f > 0 THEN 'fail' WHEN u > 0 THEN 'warn' ELSE 'ok' END,
  CASE WHEN f > 0 THEN concat('an exploration is the first reader of ', f, ' ranges') WHEN u > 0 THEN concat(u, ' first reads are consumed by no recorded run')
  ELSE 'every first read belongs to a recorded run of its experiment' END FROM states"""))
def ledger_checks(spark, sf):
    problems = pc.ledger_history(spark, sf).select("problem")
    rows = v.ledger(spark, sf)
    consumed = rows.selectExpr("first_read_by AS exp_id", "url", "start_b", "end_b")
    experiments = v.table(spark, sf, "supplier").selectExpr("concat('EXP-', s_suppkey % 7) AS exp_id")
    return au.union_checks([au.ledger_history_check(problems),
                            au.accounting_check(cov.ledger_accounted(rows, consumed, experiments))])


_DOS = "c_custkey % 20 <> 0"


@query("dossier_checks", sql("v_exp v_inv", f"""WITH {_INV}, e AS (SELECT *, SHA<concat('corpus', c_custkey)> AS corpus_sha256, CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS parent_sha256 FROM v_exp),
files AS (SELECT concat('X-', l_suppkey * 7) AS exp_id, concat('f', l_linenumber) AS name, concat('runs/', l_orderkey, '/', l_partkey) AS uri, SHA<concat('x', l_partkey)> AS sha256, l_partkey * 10 AS bytes FROM lineitem),
bad AS (SELECT f.exp_id, concat(f.name, ' ', CASE WHEN i.uri IS NULL THEN 'missing' ELSE 'changed' END) AS problem FROM files f LEFT JOIN inv i ON i.uri = f.uri
  WHERE i.uri IS NULL OR i.sha256 <> f.sha256 OR i.bytes <> f.bytes),
bads AS (SELECT exp_id, count(*) AS n, array_to_string(list_sort(list(problem))[1:5], '; ') AS texts FROM bad GROUP BY exp_id)
SELECT 'framing.manifest' AS name, exp_id AS subject, CASE WHEN NOT ({_DOS}) THEN 'warn' WHEN c_custkey % 30 = 1 OR c_custkey % 9 = 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN NOT ({_DOS}) THEN '0 framing dossiers; expected one' WHEN c_custkey % 30 = 1 THEN '2 framing dossiers; expected one'
  WHEN c_custkey % 9 = 0 THEN 'the dossier names another registration' ELSE 'registration unchanged since framing' END AS detail FROM e
UNION ALL SELECT 'framing.files', e.exp_id, CASE WHEN b.n > 0 THEN 'fail' ELSE 'ok' END, CASE WHEN b.n > 0 THEN concat(b.texts, CASE WHEN b.n > 5 THEN concat('; and ', b.n - 5, ' more') ELSE '' END)
  ELSE 'files match their recorded SHA-256' END FROM e LEFT JOIN bads b ON b.exp_id = e.exp_id WHERE {_DOS} AND c_custkey % 30 <> 1
UNION ALL SELECT 'framing.corpus', exp_id, CASE WHEN c_custkey % 8 = 0 THEN 'fail' ELSE 'ok' END, CASE WHEN c_custkey % 8 = 0 THEN 'the panel corpus is missing or changed' ELSE 'the panel corpus bound by hash' END
  FROM e WHERE {_DOS} AND c_custkey % 30 <> 1
UNION ALL SELECT 'lineage.parent', exp_id, CASE WHEN c_custkey % 10 = 0 THEN 'fail' ELSE 'ok' END, CASE WHEN c_custkey % 10 = 0 THEN 'the parent result is missing or changed' ELSE 'the parent result bound by hash' END
  FROM e WHERE {_DOS} AND c_custkey % 30 <> 1 AND parent_sha256 IS NOT NULL"""))
def dossier_checks(spark, sf):
    experiments = view(spark, sf, "v_exp").selectExpr("*", "sha2(concat('corpus', c_custkey), 256) AS corpus_sha256", "CASE WHEN c_custkey % 2 = 0 THEN 'p' END AS parent_sha256",
                                                      "CASE WHEN c_custkey % 10 = 0 THEN 'q' ELSE 'p' END AS parent_now", "CAST(NULL AS STRING) AS exploration_sha256", "CAST(NULL AS STRING) AS exploration_now")
    manifests = experiments.where(_DOS).withColumn("copy", F.explode(F.expr("CASE WHEN c_custkey % 30 = 1 THEN array(1, 2) ELSE array(1) END"))).selectExpr(
        "exp_id", "concat('d', exp_id, copy) AS dossier", "CASE WHEN c_custkey % 9 = 0 THEN 'other' ELSE definition_sha256 END AS definition_sha256",
        "CASE WHEN c_custkey % 8 = 0 THEN 'moved' ELSE corpus_sha256 END AS corpus_now")
    files = v.table(spark, sf, "lineitem").selectExpr("concat('X-', l_suppkey * 7) AS exp_id", "concat('f', l_linenumber) AS name", "concat('runs/', l_orderkey, '/', l_partkey) AS uri",
                                                      "sha2(concat('x', l_partkey), 256) AS sha256", "l_partkey * 10 AS bytes")
    return au.dossier_checks(experiments, manifests, files, inventory(spark, sf))


@query("spec_checks", """SELECT 'registration.spec' AS name, concat('X-', c_custkey) AS subject, CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 5 = 0 THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN c_custkey % 4 = 0 OR c_nationkey % 5 = 0 THEN concat('edited after registration (', concat_ws(', ', CASE WHEN c_custkey % 4 = 0 THEN 'criteria' END,
    CASE WHEN c_nationkey % 5 = 0 THEN 'title' END), ')') ELSE 'the specification still says exactly what was registered' END AS detail FROM customer""")
def spec_checks(spark, sf):
    c = v.table(spark, sf, "customer")
    stored = c.selectExpr("concat('X-', c_custkey) AS exp_id", "c_name AS title", "array(c_custkey) AS criteria")
    draft = c.selectExpr("concat('X-', c_custkey) AS exp_id", "CASE WHEN c_nationkey % 5 = 0 THEN 'new' ELSE c_name END AS title",
                         "CASE WHEN c_custkey % 4 = 0 THEN array(-1L) ELSE array(c_custkey) END AS criteria")
    return au.spec_checks(rw.drift(stored, draft, "exp_id"))


@query("exploration_checks", v.sql("v_ledger v_wanted", f"""WITH {pc._COVER_SQL.format(extra=" AND l.first_read_at < w.moment + INTERVAL 1 SECOND")},
bad AS (SELECT concat('explorations/', w.req_id % 3000) AS subject, concat('rec', w.req_id, ': not all bytes were seen before') AS problem
  FROM v_wanted w LEFT JOIN cover c ON c.req_id = w.req_id WHERE coalesce(c.covered, 0) < w.end_b - w.start_b + 1),
paths AS (SELECT concat('explorations/', req_id % 3000) AS subject, min(req_id) % 7 = 0 AS draft FROM v_wanted GROUP BY 1)
SELECT 'exploration.label' AS name, subject, CASE WHEN draft THEN 'fail' ELSE 'ok' END AS status,
  CASE WHEN draft THEN 'not labelled as exploratory' ELSE 'labelled exploratory: not evidence' END AS detail FROM paths
UNION ALL {_problems_sql('exploration.data', 'paths', "'all ranges seen before'")}"""))
def exploration_checks(spark, sf):
    files = v.wanted(spark, sf).selectExpr("concat('explorations/', req_id % 3000) AS path", "req_id", "concat('rec', req_id) AS record",
                                           "url", "start_b", "end_b", "'-' AS sha256", "moment")
    judged = cov.check_exploration_data(files, v.ledger(spark, sf), "req_id", "moment")
    explorations = files.groupBy("path").agg(F.when(F.min("req_id") % 7 == 0, "DRAFT").otherwise("EXPLORATORY").alias("label"))
    return au.exploration_checks(explorations, judged, "EXPLORATORY")


@query("novelty", sql("v_exp v_run", """WITH rec AS (SELECT DISTINCT concat('X-', o_custkey) AS exp_id, o_orderkey % 400 AS record FROM orders),
used AS (SELECT r.record, min(e.created_at) AS first FROM rec r JOIN v_exp e ON e.exp_id = r.exp_id WHERE e.exp_id IN (SELECT exp_id FROM v_run WHERE status = 'passed') GROUP BY r.record)
SELECT r.exp_id, CAST(count(*) AS BIGINT) AS records, CAST(count(*) FILTER (u.first < e.created_at) AS BIGINT) AS analysed_earlier
FROM rec r JOIN v_exp e ON e.exp_id = r.exp_id LEFT JOIN used u ON u.record = r.record GROUP BY r.exp_id"""))
def novelty(spark, sf):
    return _novelty(spark, sf)


def _novelty(spark, sf):
    records = v.table(spark, sf, "orders").selectExpr("concat('X-', o_custkey) AS exp_id", "o_orderkey % 400 AS record").groupBy("exp_id").agg(
        F.collect_set("record").alias("records"))
    return au.novelty(view(spark, sf, "v_exp").join(records, "exp_id"), view(spark, sf, "v_run").where("status = 'passed'"))


_KEY = ["o_custkey", "o_orderkey"]


@query("results_table", sql("v_exp v_run", """WITH last AS (SELECT exp_id, run_id, status, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY exp_id ORDER BY started_at DESC, run_id DESC) AS rn
    FROM v_run WHERE status <> 'error') q WHERE rn = 1),
k AS (SELECT exp_id, concat('rate = ', CASE WHEN o_orderkey % 9 = 0 THEN 'not measured' ELSE printf('%.6f', CAST(o_orderkey % 100 AS DOUBLE) / 100) END, ' (needs ≥ ', printf('%.6f', 0.5), '); gap = ',
    printf('%.6f', CAST(o_orderkey % 8 AS DOUBLE) / 8), ' (needs < ', printf('%.6f', 0.25), ')') AS key_measurement FROM last),
n AS (SELECT exp_id, count(*) AS runs FROM v_run GROUP BY exp_id)
SELECT e.exp_id, e.title, coalesce(upper(l.status), 'PLANNED') AS result, k.key_measurement, CAST(coalesce(n.runs, 0) AS BIGINT) AS runs
FROM v_exp e LEFT JOIN last l ON l.exp_id = e.exp_id LEFT JOIN k ON k.exp_id = e.exp_id LEFT JOIN n ON n.exp_id = e.exp_id"""))
def results_table(spark, sf):
    runs = view(spark, sf, "v_run")
    latest = cm.latest_completed(runs)
    shown = latest.join(runs.select("run_id", "o_orderkey"), "run_id").select("exp_id", F.inline(F.array(
        F.expr("""struct(0 AS ord, 'rate' AS metric, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) END AS observed, '>=' AS op, CAST(0.5 AS DOUBLE) AS value)"""),
        F.expr("struct(1 AS ord, 'gap' AS metric, CAST(o_orderkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS observed, '<' AS op, CAST(0.25 AS DOUBLE) AS value)"))))
    return au.results_table(view(spark, sf, "v_exp"), latest, shown, runs.groupBy("exp_id").agg(F.count(F.lit(1)).alias("runs")))


@query("status_counts", sql("v_run", "SELECT status, CAST(count(*) AS BIGINT) AS runs FROM v_run GROUP BY status"))
def status_counts(spark, sf):
    return view(spark, sf, "v_run").groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


# The published page has lost some rows and has another result in some.
_PUBLISHED = "CASE WHEN CAST(substr(exp_id, 3) AS BIGINT) % 5 = 0 AND result = 'PASSED' THEN 'FAILED' ELSE result END AS result"


@query("results_checks", f"""WITH c AS ({ORACLES['results_table']}),
p AS (SELECT exp_id, title, {_PUBLISHED}, key_measurement, runs FROM c WHERE CAST(substr(exp_id, 3) AS BIGINT) % 11 <> 0)
SELECT 'results.page' AS name, exp_id AS subject, 'fail' AS status, 'missing or stale' AS detail FROM (SELECT * FROM c EXCEPT SELECT * FROM p) a
UNION ALL SELECT 'results.page', exp_id, 'fail', 'not what the records give' FROM (SELECT * FROM p EXCEPT SELECT * FROM c) b""")
def results_checks(spark, sf):
    rendered = results_table(spark, sf)
    published = rendered.where("CAST(substr(exp_id, 3) AS BIGINT) % 11 <> 0").selectExpr("exp_id", "title", _PUBLISHED, "key_measurement", "runs")
    return au.results_checks(published, rendered)


# All run checks, levels and claims
def all_run_checks(spark, sf):
    runs = view(spark, sf, "v_run")
    return au.union_checks([run_submission_checks(spark, sf), run_artifact_checks(spark, sf), run_summary_checks(spark, sf),
                            run_report_checks(spark, sf), run_timing_checks(spark, sf), run_anchor_checks(spark, sf),
                            run_published_checks(spark, sf), run_code_checks(spark, sf), run_data_checks(spark, sf)])


_RUN_CHECKS = ["submission", "artifact", "summary", "report", "timing", "anchor", "published", "code", "data"]


@query("run_checks", " UNION ALL ".join(f"SELECT name, subject, status, detail FROM ({ORACLES[f'run_{c}_checks']}) {c}_checks" for c in _RUN_CHECKS))
def run_checks(spark, sf):
    return all_run_checks(spark, sf)


_OTHER_CHECKS = ["holdout_checks", "dossier_checks", "spec_checks", "ledger_checks", "exploration_checks", "registration_history_checks",
                 "unrecorded_runs", "results_checks"]


def every_check(spark, sf, names=tuple(_OTHER_CHECKS)):
    """The checks of runs, experiments, ledger, explorations and the results page, to be read once: they are not kept."""
    return au.union_checks([all_run_checks(spark, sf), *(QUERIES[name](spark, sf) for name in names)])


#: Families with checks of runs and experiments; the others' subjects are the ledger and explorations, which no claim names.
_OF_CLAIMS = tuple(name for name in _OTHER_CHECKS if name not in ("ledger_checks", "exploration_checks"))


_EVERY = " UNION ALL ".join(f"SELECT name, subject, status, detail FROM ({ORACLES[name]}) {name}_rows" for name in ["run_checks", *_OTHER_CHECKS])


@query("check_counts", f"""SELECT CAST(count(*) FILTER (status = 'ok') AS BIGINT) AS ok, CAST(count(*) FILTER (status = 'fail') AS BIGINT) AS fail,
  CAST(count(*) FILTER (status = 'warn') AS BIGINT) AS warn, CAST(count(*) FILTER (status = 'skip') AS BIGINT) AS skip,
  count(*) FILTER (status IN ('fail', 'skip')) = 0 AS passed FROM ({_EVERY}) c""")
def check_counts(spark, sf):
    return au.check_counts(every_check(spark, sf), strict=True)


def _claimed_runs(spark, sf):
    return view(spark, sf, "v_run").select("run_id", "exp_id").join(view(spark, sf, "v_exp").select("exp_id", "holdout"), "exp_id")


_LEVELS = f"""every AS MATERIALIZED ({_EVERY}),
flags AS (SELECT subject, bool_or(status = 'fail') AS failed, bool_or(name = 'run.anchor' AND status = 'ok') AS anchored,
  bool_or(name = 'run.published' AND status = 'ok') AS published, coalesce(bool_and(CASE WHEN name LIKE 'holdout.%' THEN status = 'ok' END), true) AS clean
  FROM every GROUP BY subject),
lv AS (SELECT r.run_id, r.exp_id, e.holdout, CASE WHEN coalesce(a.failed, false) OR coalesce(b.failed, false) THEN 'unverified'
  WHEN coalesce(a.anchored, false) AND coalesce(a.published, false) AND e.holdout AND coalesce(a.clean, true) AND coalesce(b.clean, true) THEN 'confirmatory'
  WHEN coalesce(a.anchored, false) THEN 'preregistered' ELSE 'registered' END AS level
  FROM v_run r JOIN v_exp e ON e.exp_id = r.exp_id LEFT JOIN flags a ON a.subject = r.run_id LEFT JOIN flags b ON b.subject = r.exp_id)"""


@query("evidence_levels", sql("v_run v_exp", f"""WITH {_LEVELS} SELECT lv.run_id, lv.exp_id, lv.holdout, lv.level,
  CASE WHEN coalesce(a.anchored, false) AND coalesce(a.published, false) AND lv.holdout AND coalesce(a.clean, true) AND coalesce(b.clean, true) THEN 'confirmatory'
  WHEN coalesce(a.anchored, false) THEN 'preregistered' ELSE 'registered' END AS level_without_failures
FROM lv LEFT JOIN flags a ON a.subject = lv.run_id LEFT JOIN flags b ON b.subject = lv.exp_id"""))
def evidence_levels(spark, sf):
    """Levels as the checks stand, and what they would be if no failed check ruled a run out."""
    rows = au.evidence_levels(every_check(spark, sf, _OF_CLAIMS), _claimed_runs(spark, sf), "level_without_failures")
    return rows.select("run_id", "exp_id", "holdout", "level", "level_without_failures")


@query("claims", v.sql("v_wanted", sql("v_run v_exp", f"""WITH RECURSIVE {_LEVELS},
links AS (SELECT r.run_id, c.status, concat(c.name, ': ', c.detail) AS link FROM v_run r JOIN every c ON c.subject IN (r.run_id, r.exp_id) WHERE c.status IN ('fail', 'warn')),
linked AS (SELECT run_id, array_to_string(list_sort(list(link) FILTER (status = 'fail')), ' | ') AS broken,
  array_to_string(list_sort(list(link) FILTER (status = 'warn')), ' | ') AS weaker FROM links GROUP BY run_id),
{_RES}, touching AS (SELECT DISTINCT a.exp_id AS a, b.exp_id AS b FROM res a JOIN res b ON a.url = b.url AND a.start_b <= b.end_b AND b.start_b <= a.end_b
  AND a.exp_id <> b.exp_id),
reach AS (SELECT a AS node, a AS seen FROM touching UNION SELECT r.node, t.b FROM reach r JOIN touching t ON t.a = r.seen),
families AS (SELECT node AS exp_id, min(seen) AS family FROM reach GROUP BY node),
novel AS ({ORACLES['novelty']}), facts AS ({ORACLES['rehearsal_summary']})
SELECT lv.run_id, lv.exp_id, lv.level, coalesce(l.broken, '') AS broken_links, coalesce(l.weaker, '') AS weaker_links, f.family,
  CASE WHEN CAST(substr(lv.run_id, 3) AS BIGINT) % 4 = 0 THEN r.status ELSE '' END AS replays, n.records, n.analysed_earlier,
  CASE WHEN CAST(substr(lv.exp_id, 3) AS BIGINT) % 4 = 0 THEN (SELECT string_agg(concat(fact, ': ', subject), ', ' ORDER BY concat(fact, ': ', subject)) FROM facts) END AS rehearsal
FROM lv JOIN v_run r ON r.run_id = lv.run_id LEFT JOIN linked l ON l.run_id = lv.run_id LEFT JOIN families f ON f.exp_id = lv.exp_id
LEFT JOIN novel n ON n.exp_id = lv.exp_id""")))
def claims(spark, sf):
    exps, corpus = view(spark, sf, "v_exp"), _corpus(spark, sf)
    facts = QUERIES["rehearsal_summary"](spark, sf)  # a few rows of one rehearsal, which the dossiers of these experiments hold
    rehearsed = corpus["dossier_files"].where("is_rehearsal").select("exp_id").crossJoin(F.broadcast(facts))
    rows = au.claims(every_check(spark, sf, _OF_CLAIMS), _claimed_runs(spark, sf), cov.holdout_families(_reserved(spark, sf)), corpus["receipts"],
                     _novelty(spark, sf), rehearsed)
    return rows.select("run_id", "exp_id", "level", F.array_join("broken_links", " | ").alias("broken_links"),
                       F.array_join("weaker_links", " | ").alias("weaker_links"), "family", F.array_join("replays", ",").alias("replays"),
                       "records", "analysed_earlier", F.array_join("rehearsal", ", ").alias("rehearsal"))


# Runs as texts, some of them malformed: a moment that is none, a zero to divide by, a document that is cut short.
_TEXTS = ["run_id", "exp_id", "CASE WHEN o_orderkey % 17 = 0 THEN 'last week' WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(started_at AS {s}) END AS started",
          "CASE WHEN o_orderkey % 23 = 0 THEN '12,5' ELSE CAST(o_orderkey % 7 AS {s}) END AS hits", "CAST(o_orderkey % 11 AS {s}) AS trials",
          """CASE WHEN o_orderkey % 29 = 0 THEN '{{"seed": 1' WHEN o_orderkey % 31 = 0 THEN '{{"seed": "x"}}' WHEN o_orderkey % 37 = 0 THEN '{{}}'
          ELSE concat('{{"seed": ', o_orderkey % 5, '}}') END AS report"""]


def _row_problems(*cases: tuple[str, str]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {when} THEN {text} END" for when, text in cases) + ")"


_ODD_SEED = """CASE WHEN json_valid(report) THEN report = '{"seed": "x"}' END"""
_SEED = "CASE WHEN json_valid(report) THEN TRY_CAST(json_extract_string(report, '$.seed') AS BIGINT) END"
_ROW_CHECKS_SQL = f"""texts AS (SELECT {', '.join(t.format(s='VARCHAR') for t in _TEXTS)} FROM v_run),
told AS (
SELECT 'run.started' AS name, run_id AS subject, {_row_problems(("started IS NOT NULL AND TRY_CAST(started AS TIMESTAMP) IS NULL", "concat('started is no timestamp_ntz: ', started)"))} AS bad,
  CASE WHEN TRY_CAST(started AS TIMESTAMP) >= TIMESTAMP '1995-06-01' THEN 'ok' WHEN TRY_CAST(started AS TIMESTAMP) IS NOT NULL THEN 'warn' END AS st, 'a known time' AS fine, 'started' AS none FROM texts
UNION ALL SELECT 'run.rate', run_id, {_row_problems(("TRY_CAST(hits AS BIGINT) IS NULL", "concat('hits is no bigint: ', hits)"), ("TRY_CAST(hits AS BIGINT) IS NOT NULL AND trials = '0'", "'hits per trial divides by zero'"))},
  CASE WHEN trials <> '0' AND TRY_CAST(hits AS DOUBLE) / CAST(trials AS DOUBLE) <= 1 THEN 'ok' WHEN trials <> '0' AND TRY_CAST(hits AS DOUBLE) IS NOT NULL THEN 'fail' END, 'hits per trial', 'rate' FROM texts
UNION ALL SELECT 'run.seed', run_id, {_row_problems(("NOT json_valid(report)", "'report is no document'"), (_ODD_SEED, "'report has no bigint at $.seed'"))},
  CASE WHEN {_SEED} < 4 THEN 'ok' WHEN {_SEED} IS NOT NULL THEN 'warn' END, 'a seed', 'seed' FROM texts)"""


def row_guarded_checks(spark, sf):
    texts = view(spark, sf, "v_run").selectExpr(*[t.format(s="STRING") for t in _TEXTS])
    started = au.row_checks(texts, "run.started", "run_id", {"started": au.reading("started", "timestamp_ntz")}, lambda started: (
        F.when(started >= F.lit("1995-06-01").cast("timestamp_ntz"), "ok").when(started.isNotNull(), "warn"), F.lit("a known time")))
    rate = au.ratio(au.reading("hits", "bigint"), au.reading("trials", "bigint"), "hits per trial")
    rates = au.row_checks(texts, "run.rate", "run_id", {"rate": rate}, lambda rate: (
        F.when(rate <= 1, "ok").when(rate.isNotNull(), "fail"), F.lit("hits per trial")))
    seeds = au.row_checks(texts, "run.seed", "run_id", {"seed": au.member("report", "$.seed", "bigint")}, lambda seed: (
        F.when(seed < 4, "ok").when(seed.isNotNull(), "warn"), F.lit("a seed")))
    return au.union_checks([started, rates, seeds])


# Checks that cannot be planned, and checks whose rows cannot be read, are failed checks among the others.
@query("guarded_checks", sql("v_run v_exp", f"""WITH {_ROW_CHECKS_SQL}
SELECT name, subject, CASE WHEN bad <> '' THEN 'fail' ELSE coalesce(st, 'fail') END AS status,
  CASE WHEN bad <> '' THEN concat('not checked: ', bad) WHEN st IS NULL THEN concat('not checked: no ', none) ELSE fine END AS detail FROM told
UNION ALL SELECT 'run.broken', 'runs', 'fail', 'not checked: UNRESOLVED_COLUMN.WITH_SUGGESTION'
UNION ALL SELECT name, subject, status, detail FROM ({ORACLES['run_timing_checks']}) t"""))
def guarded_checks(spark, sf):
    good = au.guarded("run.timing", "runs", lambda: run_timing_checks(spark, sf), spark)
    broken = au.guarded("run.broken", "runs", lambda: au.timing_checks(view(spark, sf, "v_run").drop("started_at"), view(spark, sf, "v_exp")), spark)
    return au.null_as_fail(au.union_checks([good, broken, row_guarded_checks(spark, sf)]))


# Fingerprints and graph
@query("row_fingerprint", """SELECT c_custkey, sha256(concat('{"c_custkey":', c_custkey, ',"c_mktsegment":"', c_mktsegment, '","c_name":"', c_name, '"}')) AS fingerprint FROM customer""")
def row_fingerprint(spark, sf):
    return ln.row_fingerprint(v.table(spark, sf, "customer"), ["c_name", "c_mktsegment", "c_custkey"]).select("c_custkey", "fingerprint")


def _tree_sql(hashes: str) -> str:
    """The prefix tree over ``hashes(hash)`` in SQL."""
    steps = [f"t0 AS (SELECT hash AS k, concat(hash, ':', count(*)) AS val FROM ({hashes}) q GROUP BY hash)"]
    for i, size in enumerate((6, 3, 0)):
        steps.append(f"t{i + 1} AS (SELECT substr(k, 1, {size}) AS k, sha256(string_agg(val, chr(10) ORDER BY k)) AS val FROM t{i} GROUP BY 1)")
    return ", ".join(s.replace("ORDER BY k)", f"ORDER BY t{i - 1}.k)") if i else s for i, s in enumerate(steps)) + " SELECT val AS digest FROM t3"


@query("table_fingerprint", "WITH " + _tree_sql(
    """SELECT sha256(concat('{"o_custkey":', o_custkey, ',"o_orderkey":', o_orderkey, ',"o_orderstatus":"', o_orderstatus, '"}')) AS hash FROM orders"""))
def table_fingerprint(spark, sf):
    return ln.table_fingerprint(v.table(spark, sf, "orders"), ["o_orderstatus", "o_orderkey", "o_custkey"])


@query("ordered_digest", sql("v_art", """WITH f AS (SELECT DISTINCT run_id, uri, sha256 FROM v_art WHERE uri IS NOT NULL)
SELECT run_id, sha256(string_agg(concat(uri, chr(0), sha256, chr(10)), '' ORDER BY uri)) AS digest FROM f GROUP BY run_id"""))
def ordered_digest(spark, sf):
    files = view(spark, sf, "v_art").where("uri IS NOT NULL").select("run_id", "uri", "sha256").distinct()
    return ln.ordered_digest(files, ["run_id"], "uri")


# Modules of a package as texts, some with other line ends: the digest is the same for both.
@query("source_digest", """WITH f AS (SELECT doc_id % 50 AS package, concat('m', doc_id, '.py') AS path, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents)
SELECT package, sha256(string_agg(concat(path, chr(0), text), '' ORDER BY path)) AS digest FROM f GROUP BY package""")
def source_digest(spark, sf):
    files = v.table(spark, sf, "documents").select((F.col("doc_id") % 50).alias("package"), F.concat(F.lit("m"), "doc_id", F.lit(".py")).alias("path"),
                                                   F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text")).alias("text"))
    return ln.source_digest(files, ["package"])


def _corpus(spark, sf):
    exps, runs = view(spark, sf, "v_exp"), view(spark, sf, "v_run").withColumnRenamed("commit_id", "commit")
    return {
        "registrations": exps.withColumns({"follows": F.expr("CASE WHEN c_custkey % 5 = 0 THEN concat('R-', c_custkey) END"),
                                           "exploration": F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('explorations/', c_custkey % 50) END"),
                                           "spec": F.expr("CASE WHEN c_custkey % 3 = 0 THEN concat('specs/', c_custkey % 100) END")}),
        "dossier_files": exps.selectExpr("exp_id", "concat('framing/', c_custkey) AS path", "definition_sha256 AS sha256", "c_custkey % 4 = 0 AS is_rehearsal",
                                         "concat('explorations/', c_custkey % 50) AS rehearses"),
        "reserved": _reserved(spark, sf),
        "runs": runs.withColumns({"committed_at": F.lit(None).cast("timestamp_ntz"), "version": F.lit("1")}),
        "consumed": v.ledger(spark, sf).selectExpr("concat('R-', order_no) AS run_id", "url", "start_b", "end_b"),
        "artifacts": view(spark, sf, "v_art").withColumn("kind", F.lit("report")),
        "receipts": runs.where("o_orderkey % 4 = 0").selectExpr("concat('replays/', o_orderkey) AS receipt", "run_id", "result_sha256 AS sha256", "status AS outcome"),
        "explorations": v.table(spark, sf, "supplier").selectExpr("concat('explorations/', s_suppkey) AS path", "s_name AS sha256", "concat('src', s_suppkey % 9) AS source_sha256", "'1' AS version"),
        "explored": v.table(spark, sf, "supplier").selectExpr("concat('explorations/', s_suppkey) AS path", "concat('part/', s_nationkey) AS url", "s_suppkey AS start_b", "s_suppkey + 9 AS end_b"),
        "ledger": v.ledger(spark, sf),
    }


_EDGES = """ed AS (SELECT DISTINCT * FROM (
  SELECT concat('exploration:explorations/', s_suppkey) AS src, 'executed' AS relation, concat('code:src', s_suppkey % 9) AS dst FROM supplier
  UNION ALL SELECT concat('exploration:explorations/', s_suppkey), 'consumed', concat('data:part/', s_nationkey, '#', s_suppkey, '-', s_suppkey + 9) FROM supplier
  UNION ALL SELECT concat('registration:', exp_id), 'follows', concat('run:R-', c_custkey) FROM v_exp WHERE c_custkey % 5 = 0
  UNION ALL SELECT concat('registration:', exp_id), 'motivated_by', concat('exploration:explorations/', c_custkey % 50) FROM v_exp WHERE c_custkey % 2 = 0
  UNION ALL SELECT concat('registration:', exp_id), 'specified_by', concat('file:specs/', c_custkey % 100) FROM v_exp WHERE c_custkey % 3 = 0
  UNION ALL SELECT concat('registration:', exp_id), 'binds', concat('file:framing/', c_custkey) FROM v_exp
  UNION ALL SELECT concat('file:framing/', c_custkey), 'rehearses_on', concat('exploration:explorations/', c_custkey % 50) FROM v_exp WHERE c_custkey % 4 = 0
  UNION ALL SELECT concat('registration:X-', o_orderkey % 1500), 'reserves', concat('data:part/', o_custkey % 60, '#', (o_orderkey % 5000) * 100 + 37, '-', (o_orderkey % 5000) * 100 + 137 + (o_custkey % 400)) FROM orders
  UNION ALL SELECT concat('run:', run_id), 'tests', concat('registration:', exp_id) FROM v_run
  UNION ALL SELECT concat('verdict:', run_id), 'evaluates', concat('run:', run_id) FROM v_run
  UNION ALL SELECT concat('run:', run_id), 'anchored_by', concat('commit:', commit_id) FROM v_run WHERE commit_id IS NOT NULL
  UNION ALL SELECT concat('run:', run_id), 'executed', concat('code:', source_sha256) FROM v_run
  UNION ALL SELECT concat('run:R-', l_orderkey), 'consumed', concat('data:part/', l_partkey % 50, '#', (l_orderkey % 5000) * 100, '-', (l_orderkey % 5000) * 100 + CAST(l_quantity AS BIGINT) * 20 - 1) FROM lineitem
  UNION ALL SELECT concat('run:', run_id), 'produced', concat('file:', uri) FROM v_art WHERE uri IS NOT NULL
  UNION ALL SELECT concat('receipt:replays/', o_orderkey), 'replays', concat('run:', run_id) FROM v_run WHERE o_orderkey % 4 = 0) q)"""


@query("graph_edges", sql("v_exp v_run v_art", f"WITH {_EDGES} SELECT * FROM ed"))
def graph_edges(spark, sf):
    return ln.evidence_graph(_corpus(spark, sf))[1]


_NODES = """ranges AS (SELECT DISTINCT url, start_b, end_b FROM (
  SELECT concat('part/', s_nationkey) AS url, s_suppkey AS start_b, s_suppkey + 9 AS end_b FROM supplier
  UNION ALL SELECT concat('part/', o_custkey % 60), (o_orderkey % 5000) * 100 + 37, (o_orderkey % 5000) * 100 + 137 + (o_custkey % 400) FROM orders
  UNION ALL SELECT url, start_b, end_b FROM v_ledger) q),
first_reads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url, start_b, end_b ORDER BY first_read_at, first_read_by, sha256) AS rn FROM v_ledger) q
  WHERE rn = 1),
mentions AS (
  SELECT concat('exploration:explorations/', s_suppkey) AS id, 'exploration' AS kind, 'observation (not evidence)' AS role, s_name AS sha256 FROM supplier
  UNION ALL BY NAME SELECT concat('code:src', s_suppkey % 9) AS id, 'code' AS kind, 'implementation' AS role, '1' AS version FROM supplier
  UNION ALL BY NAME SELECT concat('registration:', exp_id) AS id, 'registration' AS kind, 'criteria' AS role, title, CAST(created_at AS VARCHAR) AS created_at, definition_sha256 AS sha256 FROM v_exp
  UNION ALL BY NAME SELECT concat('file:specs/', c_custkey % 100) AS id, 'spec' AS kind, 'intent' AS role FROM v_exp WHERE c_custkey % 3 = 0
  UNION ALL BY NAME SELECT concat('file:framing/', c_custkey) AS id, CASE WHEN c_custkey % 4 = 0 THEN 'rehearsal' ELSE 'framing' END AS kind,
    CASE WHEN c_custkey % 4 = 0 THEN 'design (not evidence)' ELSE 'context (not evidence)' END AS role, definition_sha256 AS sha256 FROM v_exp
  UNION ALL BY NAME SELECT concat('run:', run_id) AS id, 'run' AS kind, 'measurement' AS role, result_sha256 AS sha256, CAST(started_at AS VARCHAR) AS started_at FROM v_run
  UNION ALL BY NAME SELECT concat('verdict:', run_id) AS id, 'verdict' AS kind, 'evaluation' AS role, status, verdict FROM v_run
  UNION ALL BY NAME SELECT concat('commit:', commit_id) AS id, 'git-commit' AS kind, 'temporal anchor' AS role, CAST(NULL AS VARCHAR) AS committed_at FROM v_run WHERE commit_id IS NOT NULL
  UNION ALL BY NAME SELECT concat('code:', source_sha256) AS id, 'code' AS kind, 'implementation' AS role, '1' AS version FROM v_run
  UNION ALL BY NAME SELECT concat('file:', uri) AS id, 'report' AS kind, 'artifact' AS role, sha256 FROM v_art WHERE uri IS NOT NULL
  UNION ALL BY NAME SELECT concat('receipt:replays/', o_orderkey) AS id, 'replay-receipt' AS kind, 'reproduction' AS role, result_sha256 AS sha256, status AS outcome FROM v_run WHERE o_orderkey % 4 = 0
  UNION ALL BY NAME SELECT concat('data:', r.url, '#', r.start_b, '-', r.end_b) AS id, 'data-range' AS kind, 'input' AS role,
    CAST(f.first_read_at AS VARCHAR) AS first_read_at, f.first_read_by, f.sha256 FROM ranges r LEFT JOIN first_reads f ON f.url = r.url AND f.start_b = r.start_b AND f.end_b = r.end_b),
nd AS (SELECT id, min(kind) AS kind, min(role) AS role, min(sha256) AS sha256, min(title) AS title, min(created_at) AS created_at, min(started_at) AS started_at,
  min(status) AS status, min(verdict) AS verdict, min(first_read_at) AS first_read_at, min(first_read_by) AS first_read_by, min(committed_at) AS committed_at,
  min(version) AS version, min(outcome) AS outcome FROM mentions GROUP BY id)"""
def _graph_sql(body: str) -> str:
    return v.sql("v_ledger", sql("v_exp v_run v_art", body))


@query("graph_nodes", _graph_sql(f"WITH {_NODES} SELECT * FROM nd"))
def graph_nodes(spark, sf):
    return ln.evidence_graph(_corpus(spark, sf))[0]


@query("merge_nodes", """WITH m AS (SELECT concat('n', l_partkey) AS id, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS kind, l_linestatus AS role,
    CASE WHEN l_suppkey % 3 = 0 THEN concat('s', l_suppkey) END AS attr FROM lineitem)
SELECT k.id, k.kind, r.role, a.attr FROM (SELECT id, kind FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, kind) AS rn FROM m) q WHERE rn = 1) k
JOIN (SELECT id, role FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, role) AS rn FROM m) q WHERE rn = 1) r ON r.id = k.id
LEFT JOIN (SELECT id, attr FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, attr) AS rn FROM m WHERE attr IS NOT NULL) q WHERE rn = 1) a ON a.id = k.id""")
def merge_nodes(spark, sf):
    m = v.table(spark, sf, "lineitem").selectExpr("concat('n', l_partkey) AS id", "l_orderkey * 10 + l_linenumber AS seq", "l_returnflag AS kind", "l_linestatus AS role",
                                                  "CASE WHEN l_suppkey % 3 = 0 THEN concat('s', l_suppkey) END AS attr")
    return ln.merge_nodes(m, ["attr"])


_NODE_JSON = "concat('n:{', " + ", ',', ".join(
    f"""'"{c}":', coalesce('"' || {c} || '"', 'null')""" for c in sorted(["id", "kind", "role", *ln.NODE_ATTRS])) + ", '}')"


@query("graph_digest", _graph_sql(f"WITH {_EDGES}, {_NODES}, " + _tree_sql(
    f"""SELECT sha256({_NODE_JSON}) AS hash FROM nd UNION ALL
    SELECT sha256(concat('e:{{"dst":"', dst, '","relation":"', relation, '","src":"', src, '"}}')) FROM ed""")))
def graph_digest(spark, sf):
    return ln.graph_digest(*ln.evidence_graph(_corpus(spark, sf), distinct=False))


@query("neighbourhood", _graph_sql(f"""WITH {_EDGES}, {_NODES} SELECT ed.relation, nd.kind, nd.role, CAST(count(*) AS BIGINT) AS edges
FROM ed LEFT JOIN nd ON nd.id = ed.dst GROUP BY 1, 2, 3"""))
def neighbourhood(spark, sf):
    rows = ln.neighbourhood(*ln.evidence_graph(_corpus(spark, sf), attrs=()))  # kinds and roles alone
    return rows.groupBy("relation", "kind", "role").agg(F.count(F.lit(1)).alias("edges"))


@query("lineage_ancestors", sql("v_exp v_run v_art", f"""WITH RECURSIVE {_EDGES}, walk AS (
  SELECT concat('verdict:', run_id) AS start, concat('verdict:', run_id) AS node, 0 AS hops FROM v_run
  UNION SELECT w.start, e.dst, w.hops + 1 FROM walk w JOIN ed e ON e.src = w.node WHERE w.hops < 40)
SELECT start, node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY start, node"""))
def lineage_ancestors(spark, sf):
    edges = ln.evidence_graph(_corpus(spark, sf), distinct=False)[1]
    starts = view(spark, sf, "v_run").select(F.concat(F.lit("verdict:"), "run_id").alias("id"))
    return ln.ancestors(edges, starts)
