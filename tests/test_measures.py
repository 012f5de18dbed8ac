import pytest
from pyspark.sql import functions as F

from attest.functions.expressions import Arm, Contrast, Criterion, Settings, Stratum, arm_lag, stratum_of
from attest.operators import criteria as cr
from attest.operators import measures as m
from attest.operators import rehearse as rh

STRATA = [Stratum("slow", 0.0833, 0.1667), Stratum("normal", 0.1667, None)]
ARMS = [Arm("short", 3.0), Arm("long", 6.0), Arm("minimal", 0.25)]
TESTS = "kind string, window_id int, record string, freq_hz double, arm string, fwd_adj_p double, fwd_lag int"


def test_half_period_windows(spark):
    f = [0.125, 0.25, 1.0, 0.01, None, 0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(f)], "id int, f double")
    derived = Arm("d", 8.0, "half_period", 1.0)
    rows = df.select("id", arm_lag(derived, F.col("f"), 4.0).alias("d"), arm_lag(Arm("x", 6.0), F.col("f"), 4.0).alias("x")).orderBy("id").collect()
    assert [r.d for r in rows] == [17, 9, 4, 32, 32, 32] and {r.x for r in rows} == {24}
    assert df.limit(1).select(arm_lag(Arm("tiny", 0.1), F.col("f"), 4.0).alias("v")).first().v == 1


def test_strata_take_the_first_match(spark):
    f = [.05, .0833, .16, .1667, .3, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(f)], "id int, f double")
    rows = df.select("id", stratum_of(F.col("f"), STRATA).alias("s")).orderBy("id").collect()
    assert [r.s for r in rows] == [None, "slow", "slow", "normal", "normal", None]


def test_every_subject_counts_the_same(spark):
    rows = [("real", i, "a", .3, "short", .01, 1) for i in range(3)] + [("real", 3, "b", .3, "short", .5, 1)]
    got = {r.name: r.value for r in m.measure_arms(spark.createDataFrame(rows, TESTS), Settings(.05, 4.0, ARMS[:1], STRATA)).collect()}
    assert got["normal_detection_rate_short"] == 0.5 and got["window_detection_rate_short"] == 0.75
    assert got["slow_windows"] == 0 and got["slow_detection_rate_short"] is None and got["normal_median_lag_s_short"] == 0.25
    assert list(got) == m.output_names(Settings(.05, 4.0, ARMS[:1], STRATA))


def agreeing(null_p=0.5):
    """Six people with two windows each; short and long agree on every real window, long alone detects four mismatched ones."""
    out = []
    for i in range(6):
        for k in range(2):
            p = .005 if i else .3
            q = {"short": .4, "long": .03 if i < 2 else .4, "minimal": .03 if i < 2 else .4}
            for arm in ARMS:
                out.append(("real", 2 * i + k, f"p{i}", .25, arm.name, p, 2))
                out.append(("mismatched", 2 * i + k, f"p{i}", .25, arm.name, q[arm.name], 2))
    for arm in ARMS:
        for kind, p in (("positive", .01), ("null", null_p), ("long_lag", .01)):
            out += [(kind, t, None, None, arm.name, p, 2) for t in range(4)]
    return out


CONTRASTS = [Contrast("normal_change_long_vs_short", "normal_detection_rate", "long", "short"),
             Contrast("mismatched_long_vs_short", "mismatched_detection_rate", "long", "short"),
             Contrast("lag_change", "normal_median_lag_s", "long", "short")]
STUDY = Settings(.05, 4.0, ARMS[:2], STRATA, CONTRASTS)


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame(agreeing(), TESTS).cache()


def test_a_contrast_whose_arms_never_disagree_is_blind(tests):
    got = {r.contrast: (r.tests, r.arm_only, r.minus_only, r.blind) for r in rh.contrast_disagreement(tests, STUDY).collect()}
    assert got == {"normal_change_long_vs_short": (12, 0, 0, True), "mismatched_long_vs_short": (12, 4, 0, False),
                   "lag_change": (None, None, None, False)}
    rules = [Criterion("success", "S1", "normal_change_long_vs_short", ">=", .1), Criterion("failure", "F1", "normal_change_long_vs_short", "<=", 0.0)]
    out = rh.rehearse(tests, STUDY, ARMS, rules, resamples=200, seed=3)
    assert out["observed"].first().status == "failed"
    assert [(r.status, r.resamples, r.settled) for r in out["resampled"].collect()] == [("failed", 200, True)]
    sentences = [r.sentence for r in out["findings"].collect()]
    assert any("is blind" in s for s in sentences) and any("disagree on 4 of 12" in s for s in sentences)


def test_rivals_that_earn_the_same_verdict(tests):
    loose = [Criterion("success", "S1", "normal_detection_rate_long", ">=", .8), Criterion("success", "S2", "mismatched_detection_rate_long", "<=", .5)]
    got = {(r.arm, r.status, r.same_as_observed, r.criteria_changed) for r in rh.rivals(tests, STUDY, ARMS, loose).collect()}
    assert got == {("short", "passed", True, ""), ("long", "passed", True, "")}


def test_a_quieter_rival_flips_the_verdict(spark):
    rows = [(*r[:5], .4, r[6]) if r[0] == "mismatched" and r[4] == "minimal" else r for r in agreeing()]
    strict = [Criterion("success", "S1", "mismatched_detection_rate_long", "<=", 0.0), Criterion("failure", "F1", "mismatched_detection_rate_long", ">", .1)]
    got = {r.arm: (r.status, r.same_as_observed, r.criteria_changed) for r in rh.rivals(spark.createDataFrame(rows, TESTS), STUDY, ARMS, strict).collect()}
    assert got["long"] == ("passed", False, "S1, F1") and got["short"][1:] == (True, "")


def test_null_controls_still_guard_a_rehearsal(spark):
    rules = [Criterion("guards", "G3", "synthetic_null_false_positive_rate_short", "<=", .15), Criterion("success", "S1", "normal_detection_rate_short", ">=", .5)]
    for p, status in ((.5, "passed"), (.01, "inconclusive")):
        out = rh.rehearse_resamples(spark.createDataFrame(agreeing(p), TESTS), STUDY, rules, 20, 1)
        assert {r.status for r in out.collect()} == {status}


def test_bootstrap_draws_whole_people_and_is_deterministic(spark, tests):
    people = tests.where("kind = 'real'")
    first = rh.bootstrap_subjects(people, 50, 9)
    totals = {r.resample: r.n for r in first.groupBy("resample").agg(F.sum("copies").alias("n")).collect()}
    assert totals == {r: 6 for r in range(50)}
    again = rh.bootstrap_subjects(people.repartition(7), 50, 9)
    assert sorted(first.collect()) == sorted(again.collect())


def test_resampled_measures_match_a_direct_recompute(spark, tests):
    """Copies counted by weight give what really copied rows give."""
    wide = rh.resampled_measures(tests, STUDY, [Criterion("success", "S1", "normal_median_lag_s_long", ">=", 0.0)], 5, 4)
    picks = rh.bootstrap_subjects(tests.where("kind = 'real'"), 5, 4)
    copied = tests.join(picks, "record").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    copied = copied.withColumn("record", F.concat("record", F.lit("#"), "k")).drop("k", "copies")
    control = tests.where("record IS NULL").withColumn("resample", F.explode(F.sequence(F.lit(0), F.lit(4))))
    direct = m.measure_arms(copied.unionByName(control.select(copied.columns)), STUDY, ["resample"])
    want = {(r.resample, r.name): r.value for r in direct.collect()}
    for row in wide.collect():
        for name in m.output_names(STUDY):
            a, b = row[name], want[row.resample, name]
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-12), (row.resample, name)


CASES = {  # measurements, error -> status, verdict
    "good": ({"rate": .9, "mismatched": .1}, False, "passed", "supported"),
    "confounded": ({"rate": .9, "mismatched": .6}, False, "inconclusive", "insufficient_evidence"),
    "weak": ({"rate": .3, "mismatched": .1}, False, "failed", "not_supported"),
    "unmeasured": ({"mismatched": .1}, False, "inconclusive", "insufficient_evidence"),
    "crashed": ({}, True, "error", "not_evaluated"),
    "between": ({"rate": .6, "mismatched": .1}, False, "inconclusive", "insufficient_evidence"),
}


def test_verdicts(spark):
    criteria = spark.createDataFrame([("E", "guards", 0, "G4", "mismatched", "<=", .25), ("E", "success", 1, "S1", "rate", ">=", .8),
                                      ("E", "failure", 2, "F1", "rate", "<", .5)], "exp_id string, grp string, ord int, id string, metric string, op string, value double")
    runs = spark.createDataFrame([(c, "E", x[1]) for c, x in CASES.items()], "run_id string, exp_id string, error boolean")
    seen = spark.createDataFrame([(c, n, val) for c, x in CASES.items() for n, val in x[0].items()], "run_id string, name string, value double")
    rows = {r.run_id: r for r in cr.evaluate(runs, cr.apply_criteria(runs, seen, criteria)).collect()}
    assert {c: (r.status, r.verdict) for c, r in rows.items()} == {c: x[2:] for c, x in CASES.items()}
    assert "Not evaluable" in rows["unmeasured"].summary and rows["weak"].summary == "Failure criterion triggered: F1. The hypothesis is not supported."
    assert rows["good"].summary == "All 1 success criteria held and no failure criterion triggered."


def test_set_aside_and_zero_guards(spark):
    criteria = spark.createDataFrame([("E", "guards", 0, "G1", "windows_analyzed", ">=", 1000.0), ("E", "guards", 1, "G2", cr.HOLDOUT_METRICS[1], "<=", 0.0),
                                      ("E", "guards", 2, "G3", "rate", "<=", .1), ("L", "guards", 0, "G1", cr.HOLDOUT_METRICS[1], "<=", 1000.0),
                                      ("S", "guards", 0, "G1", cr.HOLDOUT_METRICS[0], "<", 1.0)],
                                     "exp_id string, grp string, ord int, id string, metric string, op string, value double")
    metrics = spark.createDataFrame([("E", 0, "windows_analyzed", "count"), ("E", 1, "rate", "ratio")], "exp_id string, ord int, name string, unit string")
    kept, aside = cr.set_aside(criteria.where("exp_id = 'E'"), metrics)
    assert [r.id for r in kept.collect()] == ["G3"]
    assert {r.id: r.reason.split(":")[0] for r in aside.collect()} == {"G1": "size", "G2": "holdout"}
    assert {r.exp_id: r.guarded for r in cr.is_zero_guard(criteria).collect()} == {"E": True, "L": False, "S": True}
