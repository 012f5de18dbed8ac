"""Series, row-rule and coupling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions.draws import draw_sql
from attest.functions.expressions import Arm, Settings, Stratum, slug
from attest.functions.intervals import micros
from attest.functions.ordering import ordered_index
from attest.operators import coupling as cp
from attest.operators import measures as m
from attest.operators import rows as rw
from attest.operators import series as se
from attest.operators.signals import dominant_hz
from attest.operators.specs import spec_problems
from attest.plans import views as v
from attest.plans.registry import query
from attest.session import cut_lineage

_IDX = "idx AS (SELECT *, row_number() OVER (PARTITION BY record ORDER BY ts, event_id) - 1 AS pos, epoch_us(ts) AS t_us FROM v_samples)"


def samples(spark, sf):
    rows = v.view(spark, sf, "v_samples").withColumn("t_us", micros("ts"))
    return ordered_index(rows, ["ts", "event_id"], ["record"], "pos")


@query("split_windows", v.sql("v_samples", f"""WITH {_IDX}, n AS (SELECT record, count(*) // 4 AS frames FROM idx GROUP BY record)
SELECT i.record, i.event_id, CAST(i.pos // n.frames AS BIGINT) AS segment, CAST(i.pos % n.frames AS BIGINT) AS "offset"
FROM idx i JOIN n ON n.record = i.record WHERE n.frames > 0 AND i.pos // n.frames < 4"""))
def split_windows(spark, sf):
    return se.split_windows(samples(spark, sf), 4, idx="pos").select("record", "event_id", "segment", "offset")


_SPEC = ["c_custkey AS spec_id", "CASE WHEN c_custkey % 3 > 0 THEN CAST(c_custkey % 60 AS DOUBLE) END AS first_start_s",
         "CASE WHEN c_custkey % 3 > 0 THEN CAST(60 + c_nationkey AS DOUBLE) END AS window_s",
         "CASE WHEN c_custkey % 3 > 0 THEN CAST(1 + c_nationkey % 10 AS INT) END AS count",
         "CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 50 AS DOUBLE) END AS start_s",
         "CASE WHEN c_custkey % 3 = 0 THEN CAST(600 AS DOUBLE) END AS duration_s"]


@query("segment_spans", f"""WITH s AS (SELECT {', '.join(_SPEC)} FROM customer)
SELECT spec_id, CAST(k AS INT) AS segment, coalesce(first_start_s, start_s) + k * coalesce(window_s, duration_s) AS at_s,
  coalesce(window_s, duration_s) AS length_s FROM s, unnest(range(0, coalesce(count, 1))) AS u(k)""")
def segment_spans(spark, sf):
    return se.segment_spans(v.table(spark, sf, "customer").selectExpr(*_SPEC)).select("spec_id", "segment", "at_s", "length_s")


_RR = f"""{_IDX}, rr AS (SELECT record, event_id, pos, x, (t_us - lag(t_us) OVER (PARTITION BY record ORDER BY pos))
  / CAST(1000000 AS DOUBLE) AS rr FROM idx)"""


@query("rr_intervals", v.sql("v_samples", f"WITH {_RR} SELECT record, event_id, rr FROM rr WHERE rr IS NOT NULL"))
def rr_intervals(spark, sf):
    return se.rr_intervals(samples(spark, sf), ["record"], chunk=64).select("record", "event_id", "rr")


def _median_sql(n_half: int = 5) -> str:
    around = [f"coalesce(lag(x, {k}) OVER w, first_value(x) OVER whole)" for k in range(n_half, 0, -1)] + ["x"] + \
        [f"coalesce(lead(x, {k}) OVER w, last_value(x) OVER whole)" for k in range(1, n_half + 1)]
    return (f"{_IDX}, med AS (SELECT record, event_id, pos, x, list_sort([{', '.join(around)}])[{n_half + 1}] AS local FROM idx "
            "WINDOW w AS (PARTITION BY record ORDER BY pos), whole AS (PARTITION BY record ORDER BY pos "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))")


@query("running_median", v.sql("v_samples", f"WITH {_median_sql()} SELECT record, event_id, x, local FROM med"))
def running_median(spark, sf):
    return se.running_median(samples(spark, sf), ["record"], "x", chunk=64).select("record", "event_id", "x", "local")


def _scaled(spark, sf):
    """Values scaled into the range of beat intervals."""
    return samples(spark, sf).withColumn("rr", F.col("x") / F.lit(50.0))


@query("rr_valid", v.sql("v_samples", f"""WITH {_median_sql().replace('FROM v_samples)', 'FROM (SELECT record, event_id, ts, x / CAST(50 AS DOUBLE) AS x FROM v_samples) s)')}
SELECT record, event_id, x >= CAST(0.33 AS DOUBLE) AND x <= CAST(2.0 AS DOUBLE) AND abs(x - local) <= CAST(0.3 AS DOUBLE) * local AS valid FROM med"""))
def rr_valid(spark, sf):
    rows = se.running_median(_scaled(spark, sf), ["record"], "rr", chunk=64)
    return rows.select("record", "event_id", se.rr_valid(F.col("rr"), F.col("local")).alias("valid"))


@query("qc_stats", v.sql("v_samples", f"""WITH {_median_sql().replace('FROM v_samples)', 'FROM (SELECT record, event_id, ts, x / CAST(50 AS DOUBLE) AS x FROM v_samples) s)')},
f AS (SELECT record, x, x >= CAST(0.33 AS DOUBLE) AND x <= CAST(2.0 AS DOUBLE) AND abs(x - local) <= CAST(0.3 AS DOUBLE) * local AS valid FROM med)
SELECT record, CAST(count(*) AS BIGINT) AS intervals, CAST(count(*) FILTER (valid) AS BIGINT) AS valid_intervals,
  avg(CAST(valid AS DOUBLE)) AS valid_rr_fraction, round(avg(CASE WHEN valid THEN 60 / x END), 9) AS mean_heart_rate_bpm FROM f GROUP BY record"""))
def qc_stats(spark, sf):
    rows = se.running_median(_scaled(spark, sf), ["record"], "rr", chunk=64)
    rows = rows.withColumn("valid", se.rr_valid(F.col("rr"), F.col("local")))
    return se.qc_stats(rows, ["record"]).withColumn("mean_heart_rate_bpm", F.round("mean_heart_rate_bpm", 9))


_QC = ["o_orderkey AS window_id", "o_custkey % 60 + 1 AS beats", "o_custkey % 60 AS intervals", "o_custkey % 60 - o_orderkey % 9 AS valid_intervals",
       "o_orderkey % 23 <> 0 AS finite", "CAST(o_orderkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE) AS valid_rr_fraction"]


@query("qc_split", f"""WITH q AS (SELECT {', '.join(_QC)} FROM orders)
SELECT window_id, CASE WHEN intervals < 20 THEN concat('only ', beats, ' beats detected')
  WHEN valid_intervals < 20 THEN concat('only ', valid_intervals, ' valid RR intervals') WHEN NOT finite THEN 'flat or non-finite signal'
  WHEN valid_rr_fraction < 0.7 THEN concat('valid RR fraction ', printf('%.3f', valid_rr_fraction), ' < 0.7') END AS reason FROM q""")
def qc_split(spark, sf):
    kept, out = se.qc_split(v.table(spark, sf, "orders").selectExpr(*_QC), 0.7)
    return kept.withColumn("reason", F.lit(None).cast("string")).unionByName(out).select("window_id", "reason")


@query("zscore", v.sql("v_samples", """SELECT s.record, s.event_id, round((s.x - m.a) / m.d, 6) AS z FROM v_samples s
JOIN (SELECT record, avg(x) AS a, stddev_pop(x) AS d FROM v_samples GROUP BY record) m ON m.record = s.record"""))
def zscore(spark, sf):
    rows = se.zscore(v.view(spark, sf, "v_samples"), ["record"], "x")
    return rows.select("record", "event_id", F.round("z", 6).alias("z"))


@query("amp_thresholds", v.sql("v_samples", """WITH q AS (SELECT channel, quantile_cont(x, 0.995) AS p_up, quantile_cont(-x, 0.995) AS p_down FROM v_samples GROUP BY channel)
SELECT channel, round(p_up, 9) AS p_up, round(p_down, 9) AS p_down, p_down > p_up AS flipped,
  round(0.35 * greatest(p_up, p_down), 9) AS height FROM q"""))
def amp_thresholds(spark, sf):
    rows = se.amp_thresholds(v.view(spark, sf, "v_samples"), ["channel"])
    return rows.select("channel", "flipped", *[F.round(c, 9).alias(c) for c in ("p_up", "p_down", "height")])


# Rounded down to tens, so that many tops are flat.
@query("local_peaks", v.sql("v_samples", f"""WITH {_IDX}, whole AS (SELECT record, event_id, pos, floor(x / 10) * 10 AS x FROM idx),
starts AS (SELECT record, pos, x FROM (SELECT *, lag(x) OVER (PARTITION BY record ORDER BY pos) AS l FROM whole) q WHERE l IS NULL OR l <> x),
n AS (SELECT record, pos, x, lag(x) OVER w AS l, lead(x) OVER w AS r, lead(pos) OVER w AS behind FROM starts WINDOW w AS (PARTITION BY record ORDER BY pos))
SELECT whole.record, whole.event_id, whole.x FROM n JOIN whole ON whole.record = n.record AND whole.pos = n.pos + (n.behind - 1 - n.pos) // 2
WHERE n.x > l AND n.x > r AND n.x >= 40"""))
def local_peaks(spark, sf):
    whole = samples(spark, sf).withColumn("x", (F.floor(F.col("x") / F.lit(10)) * 10).cast("double"))
    return se.local_peaks(whole, ["record"], "x", 40.0, chunk=64).select("record", "event_id", "x")


_STEP_US = 6 * 3600 * 1_000_000
_START_US, _STOP_US = 1704067200_000_000, 1704067200_000_000 + 30 * 86400 * 1_000_000


@query("resample_linear", v.sql("v_samples", f"""WITH k AS (SELECT record, epoch_us(ts) AS t, x, lead(epoch_us(ts)) OVER (PARTITION BY record ORDER BY ts) AS t1,
    lead(x) OVER (PARTITION BY record ORDER BY ts) AS x1 FROM v_samples),
g AS (SELECT DISTINCT record, CAST({_START_US} + i * {_STEP_US} AS BIGINT) AS grid_us FROM v_samples, unnest(range(0, 120)) AS u(i)),
j AS (SELECT g.record, g.grid_us, k.t, k.x, k.t1, k.x1 FROM g ASOF LEFT JOIN k ON k.record = g.record AND g.grid_us >= k.t),
f AS (SELECT record, first(x ORDER BY t) AS x0 FROM k GROUP BY record)
SELECT j.record, j.grid_us, round(CASE WHEN j.t IS NULL THEN f.x0 WHEN j.t1 IS NULL OR j.grid_us = j.t THEN j.x
  ELSE j.x + (j.x1 - j.x) / ((j.t1 - j.t) / CAST(1000000 AS DOUBLE)) * ((j.grid_us - j.t) / CAST(1000000 AS DOUBLE)) END, 7) AS y
FROM j JOIN f ON f.record = j.record"""))
def resample_linear(spark, sf):
    knots = samples(spark, sf).withColumn("start_us", F.lit(_START_US)).withColumn("stop_us", F.lit(_STOP_US))
    rows = se.resample_linear(knots, ["record"], _STEP_US, chunk=64)
    return rows.select("record", "grid_us", F.round("y", 7).alias("y"))


@query("mismatched_pairs", v.sql("v_windows", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY record, window_id) - 1 AS j,
  count(*) OVER (PARTITION BY segment) AS n FROM v_windows)
SELECT a.window_id, a.segment, a.record, b.record AS partner_record, b.window_id AS partner_window_id
FROM r a JOIN r b ON b.segment = a.segment AND b.j = (a.j + 1 + a.segment % (a.n - 1)) % a.n WHERE a.n > 1"""))
def mismatched_pairs(spark, sf):
    rows = se.mismatched_pairs(v.view(spark, sf, "v_windows"), ["record", "window_id"], ["record", "window_id"])
    return rows.select("window_id", "segment", "record", "partner_record", "partner_window_id")


@query("next_subject_pairs", v.sql("v_windows", """WITH r AS (SELECT *, row_number() OVER (ORDER BY record, window_id) - 1 AS j, count(*) OVER () AS n FROM v_windows)
SELECT a.window_id, a.record, b.record AS partner_record, b.window_id AS partner_window_id FROM r a JOIN r b ON b.j = (a.j + 1) % a.n"""))
def next_subject_pairs(spark, sf):
    rows = se.next_subject_pairs(v.view(spark, sf, "v_windows"), ["record", "window_id"], ["record", "window_id"])
    return rows.select("window_id", "record", "partner_record", "partner_window_id")


# Row rules
_DIRTY = ["l_orderkey AS run_id", "l_linenumber AS line", "CASE WHEN l_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_quantity END AS a",
          "CASE WHEN l_linenumber = 3 THEN CAST('Infinity' AS DOUBLE) WHEN l_linenumber = 5 THEN NULL ELSE l_tax END AS b"]


@query("finite_measurements", f"""WITH d AS (SELECT {', '.join(_DIRTY)} FROM lineitem)
SELECT run_id, line, CASE WHEN isnan(a) OR isinf(a) THEN NULL ELSE a END AS a, CASE WHEN isnan(b) OR isinf(b) THEN NULL ELSE b END AS b,
  concat_ws(', ', CASE WHEN isnan(a) OR isinf(a) THEN 'a' END, CASE WHEN isnan(b) OR isinf(b) THEN 'b' END) AS unusable FROM d""")
def finite_measurements(spark, sf):
    rows = rw.finite_measurements(v.table(spark, sf, "lineitem").selectExpr(*_DIRTY), ["a", "b"])
    return rows.withColumn("unusable", F.array_join("unusable", ", "))


@query("finite_series", f"""WITH d AS (SELECT {', '.join(_DIRTY)} FROM lineitem)
SELECT run_id, line, a AS value FROM d WHERE run_id NOT IN (SELECT run_id FROM d WHERE a IS NULL OR isnan(a) OR isinf(a))""")
def finite_series(spark, sf):
    d = v.table(spark, sf, "lineitem").selectExpr(*_DIRTY).selectExpr("run_id", "line", "a AS value")
    return rw.finite_series(d, ["run_id"])


@query("finite_deep", f"""WITH d AS (SELECT {', '.join(_DIRTY)} FROM lineitem)
SELECT run_id, line, CAST((isnan(a) OR isinf(a))::INT * 2 + coalesce(isnan(b) OR isinf(b), false)::INT AS BIGINT) AS replaced,
  CASE WHEN isnan(a) OR isinf(a) THEN NULL ELSE a END AS first_a FROM d""")
def finite_deep(spark, sf):
    d = v.table(spark, sf, "lineitem").selectExpr(*_DIRTY).withColumn(
        "doc", F.struct(F.array(F.col("a"), F.lit(1.0), F.col("a")).alias("list"),
                        F.create_map(F.lit("b"), F.col("b")).alias("named"), F.lit("x").alias("text")))
    rows = rw.finite_deep(d, ["doc"])
    return rows.select("run_id", "line", "replaced", F.col("doc.list")[0].alias("first_a"))


_RAW = ["l_orderkey", "l_linenumber", "l_suppkey", "CASE WHEN l_suppkey % 31 = 0 THEN NULL ELSE concat('part/', l_partkey) END AS url",
        "CASE WHEN l_orderkey % 29 = 0 THEN -5 ELSE l_orderkey END AS start_b",
        "CASE WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey + l_partkey % 100 - 2 END AS end_b",
        "CASE WHEN l_partkey % 23 = 0 THEN 'ABC' ELSE {sha} END AS sha256",
        "CASE l_partkey % 19 WHEN 0 THEN '2026-01-01T00:00:00' WHEN 1 THEN '2026-13-01T00:00:00Z' WHEN 2 THEN 'soon' ELSE '2026-01-02T03:04:05Z' END AS first_read_at",
        "CASE WHEN l_suppkey % 17 = 0 THEN '' ELSE 'EXP-1' END AS first_read_by"]


@query("validate_ledger", f"""WITH r AS (SELECT {', '.join(_RAW).format(sha="sha256(CAST(l_partkey AS VARCHAR))")} FROM lineitem),
p AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([
  CASE WHEN url IS NULL THEN 'missing url' END,
  CASE WHEN start_b < 0 OR end_b IS NULL OR start_b > end_b THEN concat('byte_range [', start_b, ', ', coalesce(CAST(end_b AS VARCHAR), 'null'),
     '] is not [first, last] with 0 <= first <= last') END,
  CASE WHEN sha256 = 'ABC' THEN 'sha256 is not 64 lowercase hex digits' END,
  CASE WHEN first_read_at <> '2026-01-02T03:04:05Z' THEN concat('first_read_at ''', first_read_at, ''' is not a timezone-aware ISO time') END,
  CASE WHEN first_read_by = '' THEN 'first_read_by is empty' END], lambda x: x IS NOT NULL)) AS message FROM r)
SELECT l_orderkey, l_linenumber, message, CAST(count(*) AS BIGINT) AS times FROM p GROUP BY 1, 2, 3""")
def validate_ledger(spark, sf):
    raw = v.table(spark, sf, "lineitem").selectExpr(*[c.format(sha="sha2(CAST(l_partkey AS STRING), 256)") for c in _RAW])
    rows = rw.validate(raw, rw.ledger_rules(), ["l_orderkey", "l_linenumber"])
    return rows.groupBy("l_orderkey", "l_linenumber", "message").agg(F.count(F.lit(1)).alias("times"))


@query("drift", """SELECT c_custkey, concat_ws(', ', CASE WHEN c_custkey % 4 = 0 AND c_acctbal <> 0 THEN 'balance' END, CASE WHEN c_custkey % 6 = 0 THEN 'extra' END,
  CASE WHEN c_nationkey % 5 = 0 THEN 'segment' END) AS changed FROM customer""")
def drift(spark, sf):
    c = v.table(spark, sf, "customer")
    stored = c.selectExpr("c_custkey", "c_acctbal AS balance", "c_mktsegment AS segment", "c_nationkey AS framing")
    draft = c.selectExpr("c_custkey", "CASE WHEN c_custkey % 4 = 0 THEN 2 * c_acctbal ELSE c_acctbal END AS balance",
                         "CASE WHEN c_nationkey % 5 = 0 THEN 'other' ELSE c_mktsegment END AS segment", "0 AS framing",
                         "CASE WHEN c_custkey % 6 = 0 THEN 'new' END AS extra")
    return rw.drift(stored, draft, "c_custkey", ["framing"]).withColumn("changed", F.array_join("changed", ", "))


_TITLE = ["p_partkey", "CAST(p_partkey % 97 AS INT) AS rank",
          "CASE WHEN p_partkey % 50 = 0 THEN '***' ELSE concat('  ', p_name, ' -- ', p_type, '/', p_brand, ' ', p_name, ': ', p_name, '!', p_type, ' ', p_name) END AS title"]


@query("corpus_names", f"""WITH t AS (SELECT {', '.join(_TITLE)} FROM part),
s AS (SELECT p_partkey, rank, rtrim(substr(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60), '-') AS slug FROM t)
SELECT p_partkey, concat(lpad(CAST(rank AS VARCHAR), 2, '0'), '-', CASE WHEN slug = '' THEN 'source' ELSE slug END, '.md') AS name FROM s""")
def corpus_names(spark, sf):
    return rw.corpus_names(v.table(spark, sf, "part").selectExpr(*_TITLE)).select("p_partkey", "name")


_HEAD = ["p_partkey AS record", "CAST(CASE p_partkey % 3 WHEN 0 THEN 250 WHEN 1 THEN 125 ELSE 360 END AS DOUBLE) AS fs",
         "CAST(100000 + p_partkey * 1000 AS BIGINT) AS n_samples", "CAST(2 + p_partkey % 2 AS INT) AS n_signals",
         "CASE WHEN p_size % 2 = 0 THEN CAST(2.0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS bytes_per_sample"]
_SPAN = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey AS record", "CAST(l_quantity AS DOUBLE) + CAST(l_linenumber AS DOUBLE) / 4 AS start_s",
         "CAST(l_suppkey * 10 AS DOUBLE) + 0.5 AS duration_s"]


@query("plan_ranges", f"""WITH h AS (SELECT {', '.join(_HEAD)} FROM part), s AS (SELECT {', '.join(_SPAN)} FROM lineitem),
p AS (SELECT s.*, h.*  EXCLUDE (record), 2 * CAST(round_even(start_s * fs / 2, 0) AS BIGINT) AS f,
  2 * CAST(round_even(duration_s * fs / 2, 0) AS BIGINT) AS c FROM s JOIN h ON h.record = s.record)
SELECT l_orderkey, l_linenumber, l_suppkey, record, CASE WHEN f + c <= n_samples THEN CAST(f * bytes_per_sample * n_signals AS BIGINT) END AS start_b,
  CASE WHEN f + c <= n_samples THEN CAST((f + c) * bytes_per_sample * n_signals AS BIGINT) - 1 END AS end_b,
  CASE WHEN f + c > n_samples THEN concat(record, ': segment ends past the record (', n_samples, ' samples)') END AS problem FROM p""")
def plan_ranges(spark, sf):
    rows = rw.plan_ranges(v.table(spark, sf, "part").selectExpr(*_HEAD), v.table(spark, sf, "lineitem").selectExpr(*_SPAN))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "record", "start_b", "end_b", "problem")


@query("to_physical", v.sql("v_samples", """SELECT s.event_id, round((floor(s.x * 10) - h.b) / h.g, 9) AS value FROM v_samples s
JOIN (SELECT DISTINCT record, channel, CAST(100 + record % 7 AS DOUBLE) AS g, CAST(record % 13 AS BIGINT) AS b FROM v_samples) h
  ON h.record = s.record AND h.channel = s.channel"""))
def to_physical(spark, sf):
    s = v.view(spark, sf, "v_samples").withColumn("digital", F.floor(F.col("x") * 10))
    heads = s.select("record", "channel").distinct().selectExpr("record", "channel", "CAST(100 + record % 7 AS DOUBLE) AS gain",
                                                               "CAST(record % 13 AS BIGINT) AS baseline")
    return rw.to_physical(s, heads).select("event_id", F.round("value", 9).alias("value"))


# Coupling on vector pairs
MAX_LAG = 12
_PROFILE = f"""prof AS (SELECT p.window_id, CAST(l AS INT) AS lag,
    (SELECT abs(corr(CAST(p.source[t] AS DOUBLE), CAST(p.target[t + l] AS DOUBLE))) FROM unnest(range(1, 65 - l)) AS u(t)) AS fwd,
    (SELECT abs(corr(CAST(p.target[t] AS DOUBLE), CAST(p.source[t + l] AS DOUBLE))) FROM unnest(range(1, 65 - l)) AS u(t)) AS rev
  FROM v_pairs p, unnest(range(1, {MAX_LAG + 1})) AS x(l))"""


@query("lag_profile", v.sql("v_pairs", f"WITH {_PROFILE} SELECT window_id, lag, round(fwd, 7) AS fwd, round(rev, 7) AS rev FROM prof"))
def lag_profile(spark, sf):
    rows = cp.lag_profile(v.pairs(spark, sf), MAX_LAG)
    return rows.select("window_id", "lag", F.round("fwd", 7).alias("fwd"), F.round("rev", 7).alias("rev"))


@query("lagged_corr", v.sql("v_pairs", f"""WITH {_PROFILE} SELECT window_id, round(max(fwd), 7) AS fwd_score, CAST(arg_max(lag, fwd) AS INT) AS fwd_lag,
  round(max(rev), 7) AS rev_score, CAST(arg_max(lag, rev) AS INT) AS rev_lag FROM prof GROUP BY window_id"""))
def lagged_corr(spark, sf):
    rows = cp.lagged_corr(v.pairs(spark, sf), MAX_LAG)
    return rows.select("window_id", F.round("fwd_score", 7).alias("fwd_score"), "fwd_lag",
                       F.round("rev_score", 7).alias("rev_score"), "rev_lag")


SURROGATES = 199


# Vectors of the tables have 64 samples. A rotation takes the source's samples from its shift on, then those before it.
_LENGTH = 64


def _rotated_sql(tests: str, seed: str) -> str:
    """``turned``: the rows of ``tests`` for each k, 0 being the pair as it is, with the rotated source and the target as lists."""
    shift = f"CASE WHEN k = 0 THEN 0 ELSE 1 + {draw_sql(str(_LENGTH - 1), seed, 'k')} END"
    return (f"shifted AS MATERIALIZED (SELECT *, {shift} AS shift FROM {tests}, range({SURROGATES + 1}) AS r(k)), "
            "turned AS MATERIALIZED (SELECT * REPLACE (CAST(list_concat(source[shift + 1:], source[1:shift]) AS DOUBLE[]) AS source, "
            "CAST(target AS DOUBLE[]) AS target) FROM shifted)")


def _profile_sql(a: str, b: str, max_lag: int) -> str:
    """|correlation| of a[t] with b[t + lag] at lags 1..max_lag, as a list."""
    x, y, n = f"{a}[1:{_LENGTH} - lag]", f"{b}[lag + 1:{_LENGTH}]", f"({_LENGTH} - lag)"
    def spread_of(z: str) -> str:
        return f"greatest(0, list_inner_product({z}, {z}) - list_sum({z}) * list_sum({z}) / {n})"
    cov = f"list_inner_product({x}, {y}) - list_sum({x}) * list_sum({y}) / {n}"
    sums = f"list_transform(range(1, {max_lag + 1}), lambda lag: {{'c': {cov}, 'v': {spread_of(x)} * {spread_of(y)}}})"
    return f"list_transform({sums}, lambda z: CASE WHEN z.v > 1e-20 THEN abs(z.c) / sqrt(z.v) ELSE 0 END)"


@query("surrogates", v.sql("v_pairs", f"""WITH {_rotated_sql('v_pairs', 'window_id')},
scored AS (SELECT window_id, k, list_max({_profile_sql('source', 'target', MAX_LAG)}) AS fwd FROM turned)
SELECT window_id, round(max(fwd) FILTER (k = 0), 9) AS observed, round(max(fwd) FILTER (k > 0), 9) AS best_surrogate,
  CAST(count(*) FILTER (k > 0) AS BIGINT) AS surrogates FROM scored GROUP BY window_id"""))
def surrogates(spark, sf):
    pairs = v.pairs(spark, sf)
    rows = cp.surrogates(pairs, SURROGATES, F.col("window_id"), MAX_LAG)
    return rows.groupBy("window_id").agg(F.round(F.max(F.when(F.col("k") == 0, F.col("fwd"))), 9).alias("observed"),
                                         F.round(F.max(F.when(F.col("k") > 0, F.col("fwd"))), 9).alias("best_surrogate"),
                                         F.count_if(F.col("k") > 0).alias("surrogates"))


_SCORES = ["l_suppkey AS window_id", "CAST(l_orderkey % 1000 AS INT) AS k", "CASE WHEN l_partkey % 2 = 0 THEN 'fwd' ELSE 'rev' END AS edge",
           "CAST(l_partkey % 1009 AS DOUBLE) / CAST(1009 AS DOUBLE) AS s"]
_SCORES_SQL = f"""sc AS (SELECT window_id, k, edge, max(s) AS score FROM (SELECT {', '.join(_SCORES)} FROM lineitem) q GROUP BY 1, 2, 3)"""


def _scores(spark, sf):
    rows = v.table(spark, sf, "lineitem").selectExpr(*_SCORES)
    return rows.groupBy("window_id", "k", "edge").agg(F.max("s").alias("score"))


@query("surrogate_p", f"""WITH {_SCORES_SQL} SELECT a.window_id, a.edge, (1 + count(*) FILTER (b.score >= a.score)) / CAST(count(*) + 1 AS DOUBLE) AS p
FROM sc a JOIN sc b ON b.window_id = a.window_id AND b.edge = a.edge AND b.k > 0 WHERE a.k = 0 GROUP BY 1, 2""")
def surrogate_p(spark, sf):
    return cp.surrogate_p(_scores(spark, sf), ["window_id", "edge"])


@query("max_stat_p", f"""WITH {_SCORES_SQL}, top AS (SELECT window_id, k, max(score) AS t FROM sc WHERE k > 0 GROUP BY 1, 2)
SELECT a.window_id, a.edge, (1 + count(*) FILTER (b.t >= a.score)) / CAST(count(*) + 1 AS DOUBLE) AS adj_p
FROM sc a JOIN top b ON b.window_id = a.window_id WHERE a.k = 0 GROUP BY 1, 2""")
def max_stat_p(spark, sf):
    return cp.max_stat_p(_scores(spark, sf), ["window_id"], "edge")


@query("test_seeds", v.sql("v_tests", "SELECT kind, window_id, arm, CASE kind " + " ".join(
    f"WHEN '{k}' THEN {42 + o} + window_id" for k, o in cp.ARM_OFFSETS.items()) + " END AS seed FROM v_tests"))
def test_seeds(spark, sf):
    return v.study_tests(spark, sf).select("kind", "window_id", "arm", cp.test_seed(42, F.col("kind"), F.col("window_id")).alias("seed"))


@query("method_fallback", """SELECT o_orderkey AS run_id, concat('fell back to ''', CASE o_custkey % 9 WHEN 0 THEN 'spectral' ELSE 'nothing' END,
  '''; the registered method ''xcorr'' did not run') AS problem FROM orders WHERE o_custkey % 9 < 2""")
def method_fallback(spark, sf):
    return cp.method_problems(v.table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "'xcorr' AS method", "CASE o_custkey % 9 WHEN 0 THEN 'spectral' WHEN 1 THEN NULL ELSE 'xcorr' END AS method_used"))


VECTOR_STUDY = Settings(v.ALPHA, v.FS, [Arm("short", 1.0), Arm("long", 3.0), Arm("derived", 4.0, "half_period", 0.5)],
                        [Stratum("slow", None, 0.8), Stratum("normal", 0.8, None)])


def _study_inputs(spark, sf):
    pairs = v.pairs(spark, sf).withColumn("record", F.col("window_id") % 40).withColumn("position", F.col("window_id"))
    pairs = dominant_hz(pairs, "source", v.FS, "freq_hz")
    lag3 = F.concat(F.slice("source", -3, 3), F.slice("source", 1, 61))
    controls = pairs.select(F.explode(F.array(
        F.struct(F.lit("positive").alias("kind"), lag3.alias("target")),
        F.struct(F.lit("null").alias("kind"), F.reverse("target").alias("target")),
        F.struct(F.lit("long_lag").alias("kind"), F.concat(F.slice("source", -10, 10), F.slice("source", 1, 54)).alias("target"))
    )).alias("c"), F.col("window_id").alias("trial"), "freq_hz", "source").select("c.*", "trial", "freq_hz", "source")
    return pairs, controls


@query("study_lag_window")
def study_lag_window(spark, sf):
    return cp.study_lag_window(*_study_inputs(spark, sf), VECTOR_STUDY, SURROGATES, 7)


# What both studies test, without the frequency: own pairs, partners of a ring and three controls of each source.
_OWN = "SELECT 'real' AS kind, window_id, window_id % 40 AS record, window_id AS position, source, target FROM v_pairs"
_CONTROLS = ("SELECT kind, window_id, CAST(NULL AS BIGINT), window_id, source, CASE kind WHEN 'positive' THEN list_concat(source[-3:], source[1:61]) "
             "WHEN 'null' THEN list_reverse(target) ELSE list_concat(source[-10:], source[1:54]) END FROM v_pairs, (VALUES {kinds}) AS c(kind)")
_NEXT = ("SELECT 'mismatched', a.window_id, a.window_id % 40, a.window_id, a.source, b.target FROM ring a JOIN ring b ON b.j = (a.j + 1) % a.n "
         "WHERE a.n > 1")
_SIMPLE_LAG = 12


def _judged_sql(tests: str, seed: str, limits: dict[str, str], longest: int) -> str:
    """``judged``: for each test and arm the scores, lags and p values; ``limits`` has each arm's lag limit as SQL."""
    arms = " UNION ALL ".join(f"SELECT *, '{arm}' AS arm, {limit} AS max_lag FROM profiles" for arm, limit in limits.items())
    same = "1e-9"  # as in the library: scores that differ by rounding only are equal
    keys = "kind, window_id, record, seed, arm, max_lag"
    p = f"(1 + count(*) FILTER (b.k > 0 AND {{s}} >= a.{{o}} - {same})) / CAST({SURROGATES + 1} AS DOUBLE)"
    return f"""seeded AS (SELECT *, {seed} AS seed FROM ({tests}) t), {_rotated_sql('seeded', 'seed')},
profiles AS MATERIALIZED (SELECT kind, window_id, record, seed, k, {_profile_sql('source', 'target', longest)} AS f,
  {_profile_sql('target', 'source', longest)} AS r FROM turned),
cut AS MATERIALIZED (SELECT {keys}, k, f[1:max_lag] AS f, r[1:max_lag] AS r, list_max(f[1:max_lag]) AS fs, list_max(r[1:max_lag]) AS rs FROM ({arms}) z),
judged AS (SELECT {', '.join('a.' + c for c in keys.split(', '))}, round(a.fs, 9) AS fwd_score, CAST(list_position(a.f, a.fs) AS INT) AS fwd_lag,
  {p.format(s='b.fs', o='fs')} AS fwd_p, {p.format(s='greatest(b.fs, b.rs)', o='fs')} AS fwd_adj_p,
  round(a.rs, 9) AS rev_score, CAST(list_position(a.r, a.rs) AS INT) AS rev_lag, {p.format(s='b.rs', o='rs')} AS rev_p,
  {p.format(s='greatest(b.fs, b.rs)', o='rs')} AS rev_adj_p
  FROM cut a JOIN cut b ON a.k = 0 AND b.kind = a.kind AND b.window_id = a.window_id AND b.arm = a.arm GROUP BY ALL)"""


def _seed_sql(seed: int, offsets: dict[str, int]) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {seed + o} + position" for k, o in offsets.items()) + " END"


_SIMPLE_TESTS = f"{_OWN} UNION ALL {_NEXT} UNION ALL {_CONTROLS.format(kinds=chr(40) + repr('positive') + '), (' + repr('null') + ')')}"


@query("study_simple", v.sql("v_pairs", f"""WITH ring AS (SELECT *, row_number() OVER (ORDER BY window_id) - 1 AS j, count(*) OVER () AS n FROM v_pairs),
{_judged_sql(_SIMPLE_TESTS, _seed_sql(7, cp.SIMPLE_OFFSETS), {'only': str(_SIMPLE_LAG)}, _SIMPLE_LAG)}
SELECT *, CAST(NULL AS VARCHAR) AS reason FROM judged"""))
def study_simple(spark, sf):
    tests = cp.study_simple(*_study_inputs(spark, sf), 3.0, v.FS, SURROGATES, 7)
    return tests.withColumns({c: F.round(c, 9) for c in ("fwd_score", "rev_score")})


@query("study_measures")
def study_measures(spark, sf):
    tests = cut_lineage(cp.study_lag_window(*_study_inputs(spark, sf), VECTOR_STUDY, SURROGATES, 7))  # the measures read them several times
    return m.measure_arms(tests, VECTOR_STUDY)


@query("dominant_hz")
def dominant_hz_query(spark, sf):
    return dominant_hz(v.pairs(spark, sf), "source", v.FS, "freq_hz").select("window_id", "freq_hz")


@query("study_series", v.sql("v_tests", """SELECT CASE kind WHEN 'real' THEN concat('adjusted_p_', arm) ELSE concat('mismatched_adjusted_p_', arm) END AS name,
  window_id AS idx, fwd_adj_p AS value FROM v_tests WHERE kind IN ('real', 'mismatched')
UNION ALL SELECT 'respiratory_frequency_hz', window_id, coalesce(freq_hz, 0) FROM v_windows"""))
def study_series(spark, sf):
    return cp.study_series(v.study_tests(spark, sf))


@query("study_contract")
def study_contract(spark, sf):
    emitted = m.measure_arms(v.study_tests(spark, sf), Settings(v.ALPHA, v.FS, [Arm("short", 3.0), Arm("long", 6.0)], VECTOR_STUDY.strata))
    return cp.contract_problems(emitted, m.output_names(VECTOR_STUDY))


_SPEC_HEAD = """{"question": "q", "data": {"source": "s", "records": ["r1", "r2"], "start_s": 0, "duration_s": 60, "grid_hz": 4.0, "highpass_hz": """
_SPEC_MID = """, "qc": {"min_valid_rr_fraction": 0.8}}, "analysis": {"method": "m", "surrogate_method": "s", "correction": "c", "n_surrogates": """
_SPEC_TAIL = """, "controls": {"synthetic_trials": 2, "positive_coupling": 0.5, "positive_lag_samples": 2, "ar_coefficient": 0.6}, "max_lag_s": 3.0, "peak_agreement_hz": 0.02}"""
_SPEC_TEXT = (f"""concat('{_SPEC_HEAD}', CASE WHEN o_orderkey % 5 = 0 THEN '2.5' ELSE '0.05' END, '{_SPEC_MID}', CAST(o_custkey % 4 AS {{s}}), ', "alpha": ', """
              f"""CASE WHEN o_orderkey % 7 = 0 THEN '"high"' ELSE '0.05' END, ', "seed": ', CAST(o_orderkey - 100 AS {{s}}), '{_SPEC_TAIL}', CASE WHEN o_orderkey % 11 = 0 THEN ', "extra": 1' ELSE '' END, '}}')""")


@query("spec_problems", """WITH p AS (SELECT o_orderkey, unnest([CASE WHEN o_orderkey % 5 = 0 THEN 'data.highpass_hz: above 0 and below half of grid_hz' END,
  CASE WHEN o_custkey % 4 = 0 THEN 'analysis.n_surrogates: an integer of at least 1' END, CASE WHEN o_orderkey % 7 = 0 THEN 'analysis.alpha: between 0 and 1' END,
  CASE WHEN o_orderkey < 100 THEN 'analysis.seed: an integer from 0 to 4291967295' END, CASE WHEN o_orderkey % 11 = 0 THEN '''extra'': not a section' END]) AS problem FROM orders)
SELECT o_orderkey, problem FROM p WHERE problem IS NOT NULL""")
def spec_problems_query(spark, sf):
    specs = v.table(spark, sf, "orders").select("o_orderkey", F.expr(_SPEC_TEXT.replace("{s}", "STRING")).alias("text"))
    return spec_problems(specs, ["o_orderkey"], purpose="explore")
