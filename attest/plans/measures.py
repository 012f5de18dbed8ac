"""Measures, criteria and rehearsal queries over the test views."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions.draws import bucket_sql, draw_sql
from attest.functions.expressions import Arm, Contrast, Criterion, Settings, Stratum, arm_lag, detected, stratum_of
from attest.operators import criteria as cr
from attest.operators import measures as m
from attest.operators import rehearse as rh
from attest.plans import views as v
from attest.plans.registry import query

ALL_ARMS = [Arm(name, lag) for _, name, lag in v.ARMS]
STRATA = [Stratum(*s) for s in v.STRATA]
CONTRASTS = [Contrast("slow_gain_long_vs_short", "slow_detection_rate", "long", "short"),
             Contrast("normal_change_long_vs_short", "normal_detection_rate", "long", "short"),
             Contrast("mismatched_long_vs_short", "mismatched_detection_rate", "long", "short"),
             Contrast("normal_lag_long_vs_short", "normal_median_lag_s", "long", "short")]
STUDY = Settings(v.ALPHA, v.FS, ALL_ARMS, STRATA, CONTRASTS)
REGISTERED = Settings(v.ALPHA, v.FS, ALL_ARMS[:2], STRATA, CONTRASTS)
STRICT = Settings(0.02, v.FS, ALL_ARMS[1:3], [Stratum("low", None, 0.2), Stratum("high", 0.2, None)],
                  [Contrast("low_resonant_vs_long", "low_detection_rate", "resonant", "long")])
CRITERIA = [Criterion("guards", "G1", "windows_analyzed", ">=", 1000),
            Criterion("guards", "G2", "holdout_bytes_read_before_anchor", "<=", 0),
            Criterion("guards", "G3", "synthetic_null_false_positive_rate_short", "<=", 0.15),
            Criterion("success", "S1", "normal_detection_rate_long", ">=", 0.72),
            Criterion("success", "S2", "mismatched_detection_rate_long", "<=", 0.055),
            Criterion("failure", "F1", "normal_change_long_vs_short", "<=", 0.0)]
ASIDE = ("G1", "G2")
APPLIED = [c for c in CRITERIA if c.id not in ASIDE]


def _stratum_sql(settings: Settings) -> str:
    parts = []
    for s in settings.strata:
        low = f"freq_hz >= CAST({s.min_hz or 0.0} AS DOUBLE)"
        high = f" AND freq_hz < CAST({s.below_hz} AS DOUBLE)" if s.below_hz is not None else ""
        parts.append(f"WHEN {low}{high} THEN '{s.name}'")
    return f"CASE {' '.join(parts)} END"


def _rated(settings: Settings) -> str:
    return (f"rated AS (SELECT *, {_stratum_sql(settings)} AS band, "
            f"fwd_adj_p <= CAST({settings.alpha} AS DOUBLE) AS won FROM v_tests)")


def _measure_sql(settings: Settings, swap: dict[str, str] | None = None) -> dict[str, str]:
    """Scalar subquery per measurement name; ``swap`` reads a target arm's tests from another arm."""
    swap = swap or {}
    avg = "SELECT avg(CAST(won AS DOUBLE)) FROM rated WHERE kind = '{k}' AND arm = '{a}'"
    out = {"windows_analyzed": f"SELECT CAST(count(*) AS DOUBLE) FROM rated WHERE kind = 'real' AND arm = '{settings.arms[0].name}'"}
    for s in settings.strata:
        base = f"FROM rated WHERE kind = 'real' AND arm = '{settings.arms[0].name}' AND band = '{s.name}'"
        out[f"{s.name}_windows"] = f"SELECT CAST(count(*) AS DOUBLE) {base}"
        out[f"{s.name}_subjects"] = f"SELECT CAST(count(DISTINCT record) AS DOUBLE) {base}"
    for arm in settings.arms:
        a = swap.get(arm.name, arm.name)
        out[f"window_detection_rate_{arm.name}"] = avg.format(k="real", a=a)
        out[f"mismatched_detection_rate_{arm.name}"] = avg.format(k="mismatched", a=a)
        for s in settings.strata:
            band = f" AND band = '{s.name}'"
            out[f"{s.name}_detection_rate_{arm.name}"] = (
                "SELECT avg(own) FROM (SELECT avg(CAST(won AS DOUBLE)) AS own FROM rated WHERE kind = 'real' "
                f"AND arm = '{a}'{band} GROUP BY record) q")
            out[f"mismatched_{s.name}_detection_rate_{arm.name}"] = avg.format(k="mismatched", a=a) + band
            out[f"{s.name}_median_lag_s_{arm.name}"] = (
                f"SELECT median(CAST(fwd_lag AS DOUBLE) / CAST({settings.fs} AS DOUBLE)) FROM rated "
                f"WHERE kind = 'real' AND arm = '{a}' AND won{band}")
        for kind, metric in m.CONTROL_METRICS.items():
            out[f"{metric}_{arm.name}"] = avg.format(k=kind, a=a)
    for c in settings.contrasts:
        out[c.name] = f"SELECT ({out[f'{c.metric}_{c.arm}']}) - ({out[f'{c.metric}_{c.minus}']})"
    return {name: out[name] for name in m.output_names(settings)}


def _long_sql(settings: Settings) -> str:
    rows = [f"SELECT {i} AS ord, '{name}' AS name, round(({q}), 9) AS value"
            for i, (name, q) in enumerate(_measure_sql(settings).items())]
    return v.sql("v_tests", f"WITH {_rated(settings)} " + " UNION ALL ".join(rows))


def _rounded(df):
    return df.withColumn("value", F.round("value", 9))


@query("assign_stratum", v.sql("v_windows", f"SELECT window_id, freq_hz, {_stratum_sql(STUDY)} AS stratum FROM v_windows"))
def assign_stratum(spark, sf):
    return v.view(spark, sf, "v_windows").select("window_id", "freq_hz", stratum_of(F.col("freq_hz"), STRATA).alias("stratum"))


LAG_ARMS = [Arm("fixed", 6.0), Arm("tiny", 0.1), Arm("derived", 8.0, "half_period", 1.0)]


@query("arm_lag", v.sql("v_windows", """WITH f AS (SELECT window_id, CASE WHEN window_id % 17 = 0 THEN NULL ELSE freq_hz END AS freq_hz
  FROM v_windows)
SELECT window_id, arm, CAST(CASE arm WHEN 'fixed' THEN 24 WHEN 'tiny' THEN 1 ELSE
  CASE WHEN freq_hz IS NULL OR freq_hz = 0 THEN 32
       ELSE least(32, greatest(4, CAST(ceil(CAST(4 AS DOUBLE) / (2 * freq_hz)) AS BIGINT) + 1)) END END AS BIGINT) AS max_lag
FROM f CROSS JOIN (VALUES ('fixed'), ('tiny'), ('derived')) AS a(arm)"""))
def arm_lag_query(spark, sf):
    w = v.view(spark, sf, "v_windows").withColumn("freq_hz", F.expr("CASE WHEN window_id % 17 = 0 THEN NULL ELSE freq_hz END"))
    lags = F.array(*[F.struct(F.lit(a.name).alias("arm"), arm_lag(a, F.col("freq_hz"), v.FS).alias("max_lag")) for a in LAG_ARMS])
    return w.select("window_id", F.inline(lags))


@query("detection_flag", v.sql("v_real", "SELECT window_id, arm, fwd_adj_p <= CAST(0.05 AS DOUBLE) AS detected FROM v_real"))
def detection_flag(spark, sf):
    return v.real_tests(spark, sf).select("window_id", "arm", detected("fwd_adj_p", v.ALPHA).alias("detected"))


@query("subject_balanced", v.sql("v_strat", """WITH own AS (SELECT arm, kind, stratum, record, avg(CAST(hit AS DOUBLE)) AS own
  FROM v_strat WHERE kind IN ('real', 'mismatched') GROUP BY 1, 2, 3, 4)
SELECT arm, kind, stratum, round(avg(own), 9) AS balanced_rate, CAST(count(*) AS BIGINT) AS subjects FROM own GROUP BY 1, 2, 3"""))
def subject_balanced(spark, sf):
    tests = v.real_tests(spark, sf).unionByName(v.mismatched_tests(spark, sf))
    return m.subject_balanced_rate(tests, STUDY, ["arm", "kind", "stratum"]).withColumn(
        "balanced_rate", F.round("balanced_rate", 9))


@query("stratum_counts", v.sql("v_windows", f"""WITH s AS (SELECT *, {_stratum_sql(STUDY)} AS stratum FROM v_windows)
SELECT d.stratum, CAST(count(s.window_id) AS BIGINT) AS windows, CAST(count(DISTINCT s.record) AS BIGINT) AS subjects
FROM (VALUES ('slow'), ('normal'), ('none')) AS d(stratum) LEFT JOIN s ON s.stratum = d.stratum GROUP BY d.stratum"""))
def stratum_counts(spark, sf):
    strata = [*STRATA, Stratum("none", 9.0, 9.5)]
    return m.stratum_counts(v.view(spark, sf, "v_windows"), Settings(v.ALPHA, v.FS, ALL_ARMS, strata))


@query("detection_rates", v.sql("v_strat", """SELECT arm, kind, coalesce(stratum, '(all)') AS stratum, CAST(count(*) AS BIGINT) AS tests,
  avg(CAST(hit AS DOUBLE)) AS rate FROM v_strat
GROUP BY GROUPING SETS ((arm, kind), (arm, kind, stratum)) HAVING grouping(stratum) = 1 OR stratum IS NOT NULL"""))
def detection_rates(spark, sf):
    return m.detection_rates(v.study_tests(spark, sf), STUDY)


@query("control_rates", v.sql("v_strat", """SELECT arm, avg(CASE WHEN kind = 'positive' THEN CAST(hit AS DOUBLE) END) AS synthetic_positive_detection_rate,
  avg(CASE WHEN kind = 'null' THEN CAST(hit AS DOUBLE) END) AS synthetic_null_false_positive_rate,
  avg(CASE WHEN kind = 'long_lag' THEN CAST(hit AS DOUBLE) END) AS synthetic_long_lag_detection_rate
FROM v_strat WHERE kind IN ('positive', 'null', 'long_lag') GROUP BY arm"""))
def control_rates(spark, sf):
    return m.control_rates(v.study_tests(spark, sf), v.ALPHA)


@query("median_lag", v.sql("v_strat", """SELECT stratum, arm, median(CAST(fwd_lag AS DOUBLE) / CAST(4 AS DOUBLE)) AS median_lag_s
FROM v_strat WHERE kind = 'real' AND hit AND stratum IS NOT NULL GROUP BY stratum, arm"""))
def median_lag(spark, sf):
    return m.median_lag(v.study_tests(spark, sf), STUDY)


@query("flag_rate", v.sql("v_strat", """SELECT record, arm, avg(CASE WHEN fwd_lag > 3 THEN CAST(hit AS DOUBLE) END) AS rate,
  median(CASE WHEN hit THEN fwd_lag END) AS median_lag FROM v_strat WHERE kind = 'real' GROUP BY record, arm"""))
def flag_rate(spark, sf):
    tests = v.real_tests(spark, sf).withColumn("hit", detected("fwd_adj_p", v.ALPHA)) \
        .withColumn("hit_lag", F.expr("CASE WHEN hit THEN fwd_lag END"))
    return tests.groupBy("record", "arm").agg(m.rate(F.expr("CASE WHEN fwd_lag > 3 THEN hit END")).alias("rate"),
                                              m.median_present("hit_lag").alias("median_lag"))


@query("reverse_rate", v.sql("v_tests", """SELECT arm, kind, avg(CAST(rev_adj_p <= CAST(0.05 AS DOUBLE) AS DOUBLE)) AS reverse_rate
FROM v_tests GROUP BY arm, kind"""))
def reverse_rate(spark, sf):
    return m.reverse_rate(v.study_tests(spark, sf), v.ALPHA)


_PEAKS = ["CASE WHEN window_id % 19 = 0 THEN NULL ELSE freq_hz END AS source_peak_hz",
          "CAST((window_id * 13 + record) % 400 AS DOUBLE) / CAST(1000 AS DOUBLE) AS target_peak_hz",
          "CAST(500 + (window_id * 7) % 400 AS DOUBLE) / CAST(10 AS DOUBLE) AS heart_rate_bpm"]


@query("peak_agreement", v.sql("v_windows", f"""WITH p AS (SELECT segment, {', '.join(_PEAKS)} FROM v_windows)
SELECT segment, avg(CAST(coalesce(abs(source_peak_hz - target_peak_hz) <= CAST(0.05 AS DOUBLE), false) AS DOUBLE)) AS peak_agreement
FROM p GROUP BY segment"""))
def peak_agreement(spark, sf):
    return m.peak_agreement(v.view(spark, sf, "v_windows").selectExpr("segment", *_PEAKS), 0.05, by=["segment"])


@query("measure_simple", v.sql("v_tests", f"""WITH t AS (SELECT *, {', '.join(_PEAKS)} FROM v_tests WHERE arm = 'short'),
r AS (SELECT * FROM t WHERE kind = 'real'),
w AS (SELECT (SELECT count(*) FROM r) AS records_analyzed,
  (SELECT avg(CAST(fwd_adj_p <= 0.05 AS DOUBLE)) FROM r) AS coupling_detection_rate,
  (SELECT avg(CAST(fwd_adj_p <= 0.05 AS DOUBLE)) FROM t WHERE kind = 'mismatched') AS mismatched_detection_rate,
  (SELECT avg(CAST(fwd_adj_p <= 0.05 AS DOUBLE)) FROM t WHERE kind = 'positive') AS positive_control_detection_rate,
  (SELECT avg(CAST(fwd_adj_p <= 0.05 AS DOUBLE)) FROM t WHERE kind = 'null') AS synthetic_null_false_positive_rate,
  (SELECT avg(CAST(rev_adj_p <= 0.05 AS DOUBLE)) FROM r) AS reverse_detection_rate,
  (SELECT median(CAST(fwd_lag AS DOUBLE)) / 4 FROM r WHERE fwd_adj_p <= 0.05) AS median_coupling_lag_s,
  (SELECT avg(CAST(coalesce(abs(source_peak_hz - target_peak_hz) <= 0.02, false) AS DOUBLE)) FROM r) AS spectral_peak_agreement_rate,
  (SELECT median(source_peak_hz) FROM r) AS median_respiratory_frequency_hz,
  (SELECT median(heart_rate_bpm) FROM r) AS median_heart_rate_bpm)
""" + " UNION ALL ".join(
    f"SELECT {i} AS ord, '{n}' AS name, round(CAST({'coupling_detection_rate - mismatched_detection_rate' if n == 'detection_rate_gap' else n} AS DOUBLE), 9) AS value FROM w"
    for i, n in enumerate(m.SIMPLE_NAMES))))
def measure_simple(spark, sf):
    tests = v.study_tests(spark, sf).where("arm = 'short'").selectExpr("*", *_PEAKS)
    return _rounded(m.measure_simple(tests, v.ALPHA, v.FS, 0.02))


@query("measure_arms", _long_sql(STUDY))
def measure_arms(spark, sf):
    return _rounded(m.measure_arms(v.study_tests(spark, sf), STUDY))


@query("remeasure", _long_sql(STRICT))
def remeasure(spark, sf):
    return _rounded(m.measure_arms(v.study_tests(spark, sf), STRICT))


@query("contrasts", v.sql("v_tests", f"WITH {_rated(STUDY)} " + " UNION ALL ".join(
    f"SELECT '{c.name}' AS name, round(({_measure_sql(STUDY)[c.name]}), 9) AS value" for c in CONTRASTS)))
def contrasts(spark, sf):
    rows = m.measure_arms(v.study_tests(spark, sf), STUDY)
    return _rounded(rows.where(F.col("name").isin(*[c.name for c in CONTRASTS])).select("name", "value"))


@query("by_frequency", v.sql("v_real", """WITH b AS (SELECT arm, CAST(floor(freq_hz / CAST(0.03125 AS DOUBLE) + CAST(1e-9 AS DOUBLE)) AS BIGINT) AS bin,
    fwd_adj_p <= CAST(0.05 AS DOUBLE) AS hit FROM v_real WHERE freq_hz > 0)
SELECT bin, arm, (bin + CAST(0.5 AS DOUBLE)) * CAST(0.03125 AS DOUBLE) AS center_hz, CAST(count(*) AS BIGINT) AS windows,
  avg(CAST(hit AS DOUBLE)) AS share, count(*) >= 3 AS enough FROM b GROUP BY bin, arm"""))
def by_frequency(spark, sf):
    return m.by_frequency(v.real_tests(spark, sf), v.ALPHA)


_REPORT = "CASE window_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 120 ELSE 300 END"


@query("window_length_table", v.sql("v_real", f"""WITH w AS (SELECT window_id % 3 AS report, window_id AS ord, record,
    CAST(segment * ({_REPORT}) AS DOUBLE) AS start_s FROM v_windows),
f AS (SELECT report, record FROM (SELECT *, row_number() OVER (PARTITION BY report ORDER BY ord) AS rn FROM w) q WHERE rn = 1),
s AS (SELECT DISTINCT w.report, w.start_s FROM w JOIN f ON f.report = w.report AND f.record = w.record),
g AS (SELECT report, min(start_s - p) AS window_s FROM (SELECT report, start_s, lag(start_s) OVER (PARTITION BY report ORDER BY start_s) AS p
  FROM s) q GROUP BY report)
SELECT t.window_id % 3 AS report, t.arm, avg(CAST(t.fwd_adj_p <= 0.05 AS DOUBLE)) AS rate, max(g.window_s) AS window_s
FROM v_real t JOIN g ON g.report = t.window_id % 3 GROUP BY 1, 2"""))
def window_length_table(spark, sf):
    windows = v.view(spark, sf, "v_windows").selectExpr("window_id % 3 AS report", "window_id AS ord", "record",
                                                        f"CAST(segment * ({_REPORT}) AS DOUBLE) AS start_s")
    rates = v.real_tests(spark, sf).withColumn("report", F.expr("window_id % 3")).groupBy("report", "arm").agg(
        m.rate(detected("fwd_adj_p", v.ALPHA)).alias("rate"))
    return m.window_length_table(windows, rates)


# Criteria over orders as runs and customers as experiments.
_RUNS = ["o_orderkey AS run_id", "o_custkey AS exp_id", "o_orderstatus = 'F' AND o_orderkey % 11 = 0 AS error"]
_VALUES = [("total", "o_totalprice"), ("share", "CAST(o_orderkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE)"),
           ("drift", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_custkey % 50 AS DOUBLE) END"),
           ("spare", "CAST(o_orderkey % 13 AS DOUBLE)")]
_RULES = [("guards", 0, "G1", "total", ">=", "CAST(c_custkey % 90 AS DOUBLE) * 1000"),
          ("success", 1, "S1", "share", ">", "CAST(0.4 AS DOUBLE)"), ("success", 2, "S2", "drift", "<=", "CAST(40 AS DOUBLE)"),
          ("failure", 3, "F1", "share", "<", "CAST(c_custkey % 10 AS DOUBLE) / 50"),
          ("failure", 4, "F2", "drift", ">=", "CAST(49 AS DOUBLE)")]


def runs(spark, sf):
    return v.table(spark, sf, "orders").selectExpr(*_RUNS)


def run_measurements(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.expr(e).alias("value")) for n, e in _VALUES])
    return v.table(spark, sf, "orders").select(F.expr(_RUNS[1]), F.expr(_RUNS[0]), F.inline(rows))


def run_criteria(spark, sf):
    rows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(o).alias("ord"), F.lit(i).alias("id"), F.lit(me).alias("metric"),
                              F.lit(op).alias("op"), F.expr(val).alias("value")) for g, o, i, me, op, val in _RULES])
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("exp_id"), F.inline(rows))


_EVAL_SQL = f"""runs AS (SELECT {', '.join(_RUNS)} FROM orders),
measured AS ({' UNION ALL '.join(f"SELECT o_orderkey AS run_id, '{n}' AS name, {e} AS value FROM orders" for n, e in _VALUES)}),
rules AS ({' UNION ALL '.join(f"SELECT c_custkey AS exp_id, '{g}' AS grp, {o} AS ord, '{i}' AS id, '{me}' AS metric, '{op}' AS op, {val} AS value FROM customer" for g, o, i, me, op, val in _RULES)}),
evaluation AS (SELECT r.exp_id, r.run_id, c.grp, c.ord, c.id, c.metric, c.op, c.value, x.value AS observed,
  CASE c.op WHEN '<' THEN x.value < c.value WHEN '<=' THEN x.value <= c.value WHEN '>' THEN x.value > c.value ELSE x.value >= c.value END AS holds
  FROM runs r JOIN rules c ON c.exp_id = r.exp_id LEFT JOIN measured x ON x.run_id = r.run_id AND x.name = c.metric)"""


@query("apply_criteria", f"WITH {_EVAL_SQL} SELECT * FROM evaluation")
def apply_criteria(spark, sf):
    return cr.apply_criteria(runs(spark, sf), run_measurements(spark, sf), run_criteria(spark, sf))


@query("evaluate", f"""WITH {_EVAL_SQL},
g AS (SELECT run_id, bool_and(coalesce(holds, false)) FILTER (grp = 'guards') AS guards_ok,
  bool_or(coalesce(holds, false)) FILTER (grp = 'failure') AS failure_any,
  bool_and(coalesce(holds, false)) FILTER (grp = 'success') AS success_all,
  coalesce(string_agg(id, ', ' ORDER BY ord) FILTER (grp = 'failure' AND holds), '') AS triggered,
  count(*) FILTER (grp = 'failure' AND holds) AS n_triggered, count(*) FILTER (grp = 'success') AS n_success,
  string_agg(id, ', ' ORDER BY ord) FILTER (grp <> 'failure' AND holds IS NULL) AS missing,
  string_agg(id, ', ' ORDER BY ord) FILTER (grp <> 'failure' AND NOT coalesce(holds, false)) AS unmet FROM evaluation GROUP BY run_id),
s AS (SELECT r.*, g.* EXCLUDE (run_id), CASE WHEN r.error THEN 'error' WHEN NOT guards_ok THEN 'inconclusive' WHEN failure_any THEN 'failed'
  WHEN success_all THEN 'passed' ELSE 'inconclusive' END AS status FROM runs r JOIN g ON g.run_id = r.run_id)
SELECT run_id, exp_id, status, CASE status WHEN 'passed' THEN 'supported' WHEN 'failed' THEN 'not_supported'
  WHEN 'error' THEN 'not_evaluated' ELSE 'insufficient_evidence' END AS verdict, triggered,
  CASE status WHEN 'failed' THEN concat(CASE WHEN n_triggered > 1 THEN 'Failure criteria triggered: ' ELSE 'Failure criterion triggered: ' END,
      triggered, '. The hypothesis is not supported.')
    WHEN 'passed' THEN concat('All ', n_success, ' success criteria held and no failure criterion triggered.')
    WHEN 'error' THEN NULL ELSE CASE WHEN missing IS NOT NULL THEN concat('Not evaluable: ', missing, '.')
      ELSE concat('Not met: ', unmet, '.') END END AS summary FROM s""")
def evaluate(spark, sf):
    r = runs(spark, sf)
    rows = cr.evaluate(r, cr.apply_criteria(r, run_measurements(spark, sf), run_criteria(spark, sf)))
    return rows.select("run_id", "exp_id", "status", "verdict", F.array_join("triggered", ", ").alias("triggered"), "summary")


_METRICS = [("total", "money"), ("share", "ratio"), ("drift", "count"), ("never", "count")]


def run_metrics(spark, sf):
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.lit(u).alias("unit"))
                     for i, (n, u) in enumerate(_METRICS)])
    return v.table(spark, sf, "customer").select(F.col("c_custkey").alias("exp_id"), F.inline(rows)) \
        .where("name <> 'never' OR exp_id % 2 = 0")


_METRICS_SQL = "metrics AS (" + " UNION ALL ".join(
    f"SELECT c_custkey AS exp_id, {i} AS ord, '{n}' AS name, '{u}' AS unit FROM customer"
    + (" WHERE c_custkey % 2 = 0" if n == "never" else "") for i, (n, u) in enumerate(_METRICS)) + ")"


@query("select_registered", f"""WITH {_EVAL_SQL}, {_METRICS_SQL}
SELECT r.exp_id, r.run_id, k.ord, k.name, x.value, x.run_id IS NULL AS missing FROM runs r JOIN metrics k ON k.exp_id = r.exp_id
LEFT JOIN measured x ON x.run_id = r.run_id AND x.name = k.name""")
def select_registered(spark, sf):
    chosen, missing = cr.select_registered(run_measurements(spark, sf), run_metrics(spark, sf))
    return chosen.withColumn("missing", F.lit(False)).unionByName(
        missing.withColumn("value", F.lit(None).cast("double")).withColumn("missing", F.lit(True))) \
        .select("exp_id", "run_id", "ord", "name", "value", "missing")


@query("metric_tiers", f"""WITH {_EVAL_SQL}, {_METRICS_SQL},
made AS (SELECT DISTINCT r.exp_id, x.name FROM measured x JOIN runs r ON r.run_id = x.run_id)
SELECT k.exp_id, k.name, CASE WHEN EXISTS (SELECT 1 FROM rules c WHERE c.exp_id = k.exp_id AND c.metric = k.name)
  THEN 'evaluated' ELSE 'described' END AS tier FROM metrics k
UNION ALL SELECT exp_id, name, 'unregistered' FROM made WHERE NOT EXISTS (
  SELECT 1 FROM metrics k WHERE k.exp_id = made.exp_id AND k.name = made.name)""")
def metric_tiers(spark, sf):
    return cr.metric_tiers(run_metrics(spark, sf), run_criteria(spark, sf), run_measurements(spark, sf))


_GUARDS = [("o_orderkey % 4", "guards")]
_GUARD_EXPR = ["o_custkey AS exp_id", "CASE WHEN o_orderkey % 3 = 0 THEN 'success' ELSE 'guards' END AS grp",
               "CAST(o_orderkey AS INT) AS ord", "concat('C', o_orderkey) AS id",
               "CASE WHEN o_orderkey % 5 = 0 THEN 'holdout_bytes_read_before_anchor' WHEN o_orderkey % 5 = 1 THEN 'share' ELSE 'drift' END AS metric",
               "CASE WHEN o_orderkey % 2 = 0 THEN '<=' ELSE '<' END AS op", "CAST(o_orderkey % 7 AS DOUBLE) / 4 AS value"]


@query("zero_guard", f"""WITH c AS (SELECT {', '.join(_GUARD_EXPR)} FROM orders)
SELECT exp_id, bool_or(grp = 'guards' AND metric = 'holdout_bytes_read_before_anchor'
  AND ((op = '<=' AND value = 0) OR (op = '<' AND value > 0 AND value <= 1))) AS guarded FROM c GROUP BY exp_id""")
def zero_guard(spark, sf):
    return cr.is_zero_guard(v.table(spark, sf, "orders").selectExpr(*_GUARD_EXPR))


@query("set_aside", f"""WITH {_METRICS_SQL}, c AS (SELECT {', '.join(_GUARD_EXPR)} FROM orders)
SELECT c.exp_id, c.id, c.metric, CASE WHEN c.metric LIKE 'holdout%' THEN 'holdout: an exploration is not held out'
  WHEN c.grp = 'guards' AND k.unit = 'count' THEN 'size: an exploration is smaller than the experiment it rehearses' END AS reason
FROM c LEFT JOIN metrics k ON k.exp_id = c.exp_id AND k.name = c.metric""")
def set_aside(spark, sf):
    kept, aside = cr.set_aside(v.table(spark, sf, "orders").selectExpr(*_GUARD_EXPR), run_metrics(spark, sf))
    kept = kept.withColumn("reason", F.lit(None).cast("string"))
    return kept.unionByName(aside).select("exp_id", "id", "metric", "reason")


@query("unproducible", """WITH k AS (SELECT c_custkey AS exp_id, concat(CASE c_custkey % 3 WHEN 0 THEN 'slow' WHEN 1 THEN 'normal' ELSE 'fast' END,
  '_detection_rate_', CASE c_custkey % 2 WHEN 0 THEN 'long' ELSE 'other' END) AS name FROM customer)
SELECT exp_id, name FROM k WHERE NOT (name LIKE 'slow%long' OR name LIKE 'normal%long')""")
def unproducible(spark, sf):
    metrics = v.table(spark, sf, "customer").selectExpr("c_custkey AS exp_id", """concat(CASE c_custkey % 3 WHEN 0 THEN 'slow'
        WHEN 1 THEN 'normal' ELSE 'fast' END, '_detection_rate_', CASE c_custkey % 2 WHEN 0 THEN 'long' ELSE 'other' END) AS name""")
    return cr.unproducible(metrics, m.output_names(STUDY), holdout=True)


# Rehearsal
def _pop_sql(c: Contrast) -> str:
    population = rh.population_of(c.metric, REGISTERED)
    if population is None:
        return (f"SELECT '{c.name}' AS contrast, CAST(NULL AS BIGINT) AS tests, CAST(NULL AS BIGINT) AS arm_only, "
                "CAST(NULL AS BIGINT) AS minus_only, false AS blind")
    kind, band = population
    where = f"a.kind = '{kind}' AND a.arm = '{c.arm}'" + (f" AND a.stratum = '{band}'" if band else "")
    arm_only, minus_only = "count(*) FILTER (a.hit AND NOT b.hit)", "count(*) FILTER (b.hit AND NOT a.hit)"
    return (f"SELECT '{c.name}' AS contrast, CAST(count(*) AS BIGINT) AS tests, CAST({arm_only} AS BIGINT) AS arm_only, "
            f"CAST({minus_only} AS BIGINT) AS minus_only, count(*) > 0 AND {arm_only} = 0 AND {minus_only} = 0 AS blind "
            f"FROM v_strat a JOIN v_strat b ON b.kind = a.kind AND b.window_id = a.window_id AND b.arm = '{c.minus}' WHERE {where}")


@query("contrast_disagreement", v.sql("v_strat", " UNION ALL ".join(_pop_sql(c) for c in CONTRASTS)))
def contrast_disagreement(spark, sf):
    return rh.contrast_disagreement(v.study_tests(spark, sf), REGISTERED)


def _status_sql(values: dict[str, str]) -> tuple[str, dict[str, str]]:
    flags = {c.id: f"coalesce(({values[c.metric]}) {c.op} {c.value}, false)" for c in APPLIED}
    def join(grp: str, word: str, empty: str) -> str:
        return f" {word} ".join(flags[c.id] for c in APPLIED if c.grp == grp) or empty
    status = (f"CASE WHEN NOT ({join('guards', 'AND', 'true')}) THEN 'inconclusive' WHEN {join('failure', 'OR', 'false')} THEN 'failed' "
              f"WHEN {join('success', 'AND', 'true')} THEN 'passed' ELSE 'inconclusive' END")
    return status, flags


def _rival_sql() -> str:
    observed, base = _status_sql(_measure_sql(REGISTERED))
    rows = []
    for rival in ("resonant", "minimal"):
        for arm in ("short", "long"):
            status, flags = _status_sql(_measure_sql(REGISTERED, {arm: rival}))
            changed = ", ".join(f"CASE WHEN ({flags[i]}) <> ({base[i]}) THEN '{i}' END" for i in flags)
            rows.append(f"SELECT '{arm}' AS arm, '{rival}' AS rival, {status} AS status, ({status}) = ({observed}) AS same_as_observed, "
                        f"array_to_string(list_filter([{changed}], lambda x: x IS NOT NULL), ', ') AS criteria_changed")
    return v.sql("v_tests", f"WITH {_rated(REGISTERED)} " + " UNION ALL ".join(rows))


@query("rivals", _rival_sql())
def rivals(spark, sf):
    return rh.rivals(v.study_tests(spark, sf), REGISTERED, ALL_ARMS, APPLIED)


RESAMPLES, SEED = 1000, 20240101

# Subjects are numbered by bucket and name; draw k of a resample is the k-th number of its own.
_PICKS = f"""subjects AS MATERIALIZED (SELECT record, row_number() OVER (ORDER BY {bucket_sql('record')}, record) - 1 AS idx, count(*) OVER () AS n
  FROM (SELECT DISTINCT record FROM v_windows) q),
drawn AS (SELECT resample, {draw_sql('n', SEED, 'resample', 'idx')} AS idx FROM subjects, range({RESAMPLES}) AS r(resample)),
picks AS MATERIALIZED (SELECT resample, record, CAST(count(*) AS BIGINT) AS copies FROM drawn JOIN subjects USING (idx) GROUP BY resample, record)"""


def _resampled_sql() -> str:
    """Status and criteria of each resample: subjects weigh as often as they were drawn, controls stay."""
    normal = ("SELECT p.resample, sum(p.copies * o.own) / sum(p.copies) AS v FROM picks p JOIN (SELECT record, avg(CAST(won AS DOUBLE)) AS own "
              "FROM rated WHERE kind = 'real' AND arm = '{arm}' AND band = 'normal' GROUP BY record) o ON o.record = p.record GROUP BY p.resample")
    other = ("SELECT p.resample, sum(p.copies * o.hits) / CAST(sum(p.copies * o.n) AS DOUBLE) AS v FROM picks p JOIN (SELECT record, "
             "count(*) AS n, count(*) FILTER (won) AS hits FROM rated WHERE kind = 'mismatched' AND arm = 'long' GROUP BY record) o "
             "ON o.record = p.record GROUP BY p.resample")
    values = {"synthetic_null_false_positive_rate_short": _measure_sql(REGISTERED)["synthetic_null_false_positive_rate_short"],
              "normal_detection_rate_long": "l.v", "mismatched_detection_rate_long": "x.v", "normal_change_long_vs_short": "l.v - s.v"}
    status, _ = _status_sql(values)
    flags = ", ".join(f"({values[c.metric]}) {c.op} {c.value} AS holds_{c.id}" for c in APPLIED)
    return (f"{_rated(REGISTERED)}, {_PICKS}, resampled AS (SELECT r.resample, {status} AS status, {flags} FROM range({RESAMPLES}) AS r(resample) "
            f"LEFT JOIN ({normal.format(arm='long')}) l USING (resample) LEFT JOIN ({normal.format(arm='short')}) s USING (resample) "
            f"LEFT JOIN ({other}) x USING (resample))")


_TALLY = ("SELECT status, CAST(count(*) AS BIGINT) AS resamples, count(*) / CAST((SELECT count(*) FROM resampled) AS DOUBLE) AS share, "
          "count(*) / CAST((SELECT count(*) FROM resampled) AS DOUBLE) >= 0.95 AS settled FROM resampled GROUP BY status")


@query("bootstrap_picks", v.sql("v_windows", f"""WITH {_PICKS}
SELECT record, CAST(sum(copies) AS BIGINT) AS drawn, CAST(count(*) AS BIGINT) AS resamples FROM picks GROUP BY record"""))
def bootstrap_picks(spark, sf):
    picks = rh.bootstrap_subjects(v.view(spark, sf, "v_windows"), RESAMPLES, SEED)
    return picks.groupBy("record").agg(F.sum("copies").alias("drawn"), F.count(F.lit(1)).alias("resamples"))


@query("rehearse_resamples", v.sql("v_tests", f"WITH {_resampled_sql()} SELECT CAST(resample AS INT) AS resample, status, "
                                   + ", ".join(f"holds_{c.id}" for c in APPLIED) + " FROM resampled"))
def rehearse_resamples(spark, sf):
    return rh.rehearse_resamples(v.study_tests(spark, sf), REGISTERED, APPLIED, RESAMPLES, SEED)


@query("bootstrap_tally", v.sql("v_tests", f"WITH {_resampled_sql()} {_TALLY}"))
def bootstrap_tally(spark, sf):
    return rh.settled(rh.rehearse_resamples(v.study_tests(spark, sf), REGISTERED, APPLIED, RESAMPLES, SEED))


@query("settled", """WITH t AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'inconclusive' END AS status FROM orders)
SELECT status, CAST(count(*) AS BIGINT) AS resamples, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t) AS share,
  count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM t) >= 0.95 AS settled FROM t GROUP BY status""")
def settled(spark, sf):
    return rh.settled(v.table(spark, sf, "orders").selectExpr(
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'passed' ELSE 'inconclusive' END AS status"))


def _findings_sql() -> str:
    """Sentences from the same tally, contrasts and rivals as the queries of those names."""
    observed, _ = _status_sql(_measure_sql(REGISTERED))
    arms = "(VALUES " + ", ".join(f"('{c.name}', '{c.arm}', '{c.minus}')" for c in CONTRASTS) + ") AS a(contrast, arm, minus)"
    rows = _rival_sql()
    rivals_from = rows[rows.index(" SELECT 'short' AS arm"):]
    pops = " UNION ALL ".join(_pop_sql(c) for c in CONTRASTS)
    return v.sql("v_tests v_strat", f"""WITH {_resampled_sql()}, tally AS ({_TALLY}), told AS ({pops}), others AS ({rivals_from})
SELECT 1 AS part, status AS subject, concat(upper(status), ' recurs in ', resamples, ' of {RESAMPLES} resamples',
  CASE WHEN settled THEN ': the verdict is settled before the registered data is read.' ELSE '.' END) AS sentence
FROM tally WHERE status = ({observed.join(['SELECT ', ''])})
UNION ALL SELECT 2, contrast, CASE WHEN blind THEN concat(contrast, ' is blind: ', arm, ' and ', minus, ' decide all ', tests, ' tests alike.')
  ELSE concat(contrast, ': ', arm, ' and ', minus, ' disagree on ', arm_only + minus_only, ' of ', tests, ' tests.') END
FROM told JOIN {arms} USING (contrast) WHERE tests IS NOT NULL
UNION ALL SELECT 3, concat(rival, ' for ', arm), concat('With ', rival, ' in place of ', arm, ', the criteria give ', upper(status),
  CASE WHEN same_as_observed THEN ' as well: this data cannot tell them apart.' ELSE concat(': they differ by ', criteria_changed, '.') END)
FROM others""")


@query("rehearsal_findings", _findings_sql())
def rehearsal_findings(spark, sf):
    return rh.rehearse(v.study_tests(spark, sf), REGISTERED, ALL_ARMS, CRITERIA, ASIDE, 1000, SEED)["findings"]


@query("rehearsal_summary", v.sql("v_strat", "WITH c AS (" + " UNION ALL ".join(_pop_sql(c) for c in CONTRASTS) + "), r AS ("
       + "SELECT * FROM (" + _rival_sql().replace("WITH ", "WITH ", 1) + ") z) SELECT 'blind_contrast' AS fact, contrast AS subject FROM c WHERE blind "
       "UNION ALL SELECT 'indistinguishable_rival', concat(rival, ' for ', arm) FROM r WHERE same_as_observed"))
def rehearsal_summary(spark, sf):
    tests = v.study_tests(spark, sf)
    return rh.rehearsal_summary(rh.contrast_disagreement(tests, REGISTERED), rh.rivals(tests, REGISTERED, ALL_ARMS, APPLIED))


_CONFIG = ["c_custkey AS exp_id", "CASE WHEN c_custkey % 9 = 0 THEN 'simple' ELSE 'arms' END AS study",
           "concat('m', c_custkey % 2) AS method", "c_nationkey AS n_surrogates", "CAST(c_custkey % 4 AS DOUBLE) AS grid_hz"]
_EXPLORED = ["c_custkey AS exp_id", "'arms' AS study", "concat('m', c_custkey % 3) AS method", "c_nationkey AS n_surrogates",
             "CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 4 AS DOUBLE) END AS grid_hz"]


@query("incompatibilities", f"""WITH a AS (SELECT {', '.join(_CONFIG)} FROM customer), b AS (SELECT {', '.join(_EXPLORED)} FROM customer)
SELECT a.exp_id, concat('the exploration ran the ', b.study, ' study, the registration the ', a.study, ' study') AS reason
FROM a JOIN b ON a.exp_id = b.exp_id WHERE a.study <> b.study
UNION ALL SELECT a.exp_id, concat('method: registered ', a.method, ', explored ', b.method) FROM a JOIN b ON a.exp_id = b.exp_id
  WHERE a.study = b.study AND a.method <> b.method
UNION ALL SELECT a.exp_id, concat('grid_hz: registered ', a.grid_hz, ', explored ', coalesce(CAST(b.grid_hz AS VARCHAR), 'nothing'))
  FROM a JOIN b ON a.exp_id = b.exp_id WHERE a.study = b.study AND a.grid_hz IS DISTINCT FROM b.grid_hz""")
def incompatibilities(spark, sf):
    customer = v.table(spark, sf, "customer")
    return rh.incompatibilities(customer.selectExpr(*_CONFIG), customer.selectExpr(*_EXPLORED),
                                ["method", "n_surrogates", "grid_hz"])


_ARM_TABLE = ["c_custkey AS exp_id", "arm", "rule", "min_lag_s", "CASE WHEN c_custkey % 6 = n THEN max_lag_s + 1 ELSE max_lag_s END AS max_lag_s"]
_DEFINED = "(VALUES (0, 'short', 'fixed', CAST(NULL AS DOUBLE), CAST(3 AS DOUBLE)), (1, 'derived', 'half_period', CAST(1 AS DOUBLE), CAST(8 AS DOUBLE)))"
_DEFINED += " AS d(n, arm, rule, min_lag_s, max_lag_s)"


def _arm_json(side: str) -> str:
    return (f"""concat('{{"rule":"', {side}.rule, '"', coalesce(',"min_lag_s":' || {side}.min_lag_s, ''), ',"max_lag_s":', """
            f"""CAST({side}.max_lag_s AS DOUBLE), '}}')""")


# Registered arms against those of an exploration that left some out and changed others.
@query("arm_incompatibilities", f"""WITH a AS (SELECT c_custkey AS exp_id, arm, rule, min_lag_s, max_lag_s FROM customer CROSS JOIN {_DEFINED}),
b AS (SELECT {', '.join(_ARM_TABLE)} FROM customer CROSS JOIN {_DEFINED} WHERE c_custkey % 5 <> n)
SELECT a.exp_id, a.arm, CASE WHEN b.exp_id IS NULL THEN concat('arm ''', a.arm, ''' was not explored')
  ELSE concat('arm ''', a.arm, ''' was explored as ', {_arm_json('b')}, ', registered as ', {_arm_json('a')}) END AS reason
FROM a LEFT JOIN b ON b.exp_id = a.exp_id AND b.arm = a.arm WHERE b.exp_id IS NULL OR b.max_lag_s <> a.max_lag_s""")
def arm_incompatibilities(spark, sf):
    rows = ((0, "short", "fixed", None, 3.0), (1, "derived", "half_period", 1.0, 8.0))
    arms = F.inline(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(arm).alias("arm"), F.lit(rule).alias("rule"),
                                       F.lit(low).cast("double").alias("min_lag_s"), F.lit(high).alias("max_lag_s"))
                              for n, arm, rule, low, high in rows]))
    every = v.table(spark, sf, "customer").select("c_custkey", arms)
    registered = every.select(F.col("c_custkey").alias("exp_id"), "arm", "rule", "min_lag_s", "max_lag_s")
    return rh.arm_incompatibilities(registered, every.where("c_custkey % 5 <> n").selectExpr(*_ARM_TABLE))
