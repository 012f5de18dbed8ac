import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions import filters as fl
from attest.functions.draws import draw, draw_sql
from attest.functions.expressions import Arm, Settings, Stratum
from attest.functions.ordering import exact_quantiles, ordered_index
from attest.operators import coupling as cp
from attest.operators import rows as rw
from attest.operators import series as se
from attest.operators import signals as sg
from attest.sources import signals as src


def long(spark, values, record="r"):
    return spark.createDataFrame([(record, i, float(x)) for i, x in enumerate(values)], "record string, pos long, x double")


def test_positions_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"))
    for n in (1, 5):
        rows = ordered_index(df.repartition(n), ["v"], ["g"], "pos", "n").collect()
        for g in range(3):
            mine = sorted((r.v, r.pos, r.n) for r in rows if r.g == g)
            assert [p for _, p, _ in mine] == list(range(len(mine))) and {n for *_, n in mine} == {len(mine)}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=501)
    row = exact_quantiles(long(spark, x), ["record"], "x", {"p": .995, "m": .5, "low": .005}).first()
    assert (row.p, row.m, row.low) == pytest.approx(tuple(np.percentile(x, [99.5, 50, .5])))


@pytest.mark.parametrize("n", [3, 11, 40])
def test_running_median_repeats_the_ends(spark, n):
    x = np.random.default_rng(n).normal(size=n)
    got = [r.local for r in se.running_median(long(spark, x), ["record"], "x", chunk=7).orderBy("pos").collect()]
    assert got == pytest.approx(list(fl.running_median(x)))


def test_resampling_equals_interpolation(spark):
    t = np.array([3.0, 4.5, 4.75, 9.0]) * 1e6
    x = np.array([1.0, 5.0, -2.0, 4.0])
    knots = spark.createDataFrame([("r", i, int(a), float(b), 0, 12_000_000) for i, (a, b) in enumerate(zip(t, x))],
                                  "record string, pos long, t_us long, x double, start_us long, stop_us long")
    got = [(r.grid_us, r.y) for r in se.resample_linear(knots, ["record"], 500_000, chunk=2).orderBy("k").collect()]
    grid = np.arange(0, 12_000_000, 500_000)
    assert [g for g, _ in got] == list(grid)
    assert [y for _, y in got] == pytest.approx(list(np.interp(grid, t, x)))


def test_partners_rotate_by_segment(spark):
    rows = [(i, s, f"p{i % 3}") for s in range(3) for i in range(s * 3, s * 3 + 3)] + [(99, 7, "alone")]
    w = spark.createDataFrame(rows, "window_id int, segment int, record string")
    got = {(r.segment, r.record): r.partner_record for r in se.mismatched_pairs(w, ["window_id"], ["record"]).collect()}
    assert got == {(s, f"p{j}"): f"p{(j + 1 + s % 2) % 3}" for s in range(3) for j in range(3)}
    ring = {r.window_id: r.partner_window_id for r in se.next_subject_pairs(w, ["window_id"], ["window_id"]).collect()}
    assert ring[99] == 0 and ring[0] == 1


def test_windows_drop_the_remainder(spark):
    rows = se.split_windows(long(spark, range(11)), 3, idx="pos").collect()
    assert sorted((r.segment, r.offset, r.x) for r in rows) == [(k, o, 3.0 * k + o) for k in range(3) for o in range(3)]


# Signals
def test_filters_pass_and_stop():
    fs, t = 250.0, np.arange(2500) / 250.0
    inside, slow, fast = (np.sin(2 * np.pi * f * t) for f in (10.0, .5, 60.0))
    y = fl.bandpass(inside + slow + fast, fs, 5.0, 20.0)
    assert np.max(np.abs(y - inside)[300:-300]) < .05
    assert np.max(np.abs(fl.lowpass(slow + fast, fs, 1.0) - slow)[300:-300]) < .06
    assert np.max(np.abs(fl.highpass(slow + 3.0, 4.0, .05))) < 2


def test_block_filter_equals_the_recursion():
    sections = fl.butterworth(3, "band", (.04, .16))
    x = np.random.default_rng(1).normal(size=1000)
    want = x.copy()
    for b0, b1, b2, a1, a2 in sections:
        s1 = s2 = 0.0
        out = np.empty_like(want)
        for i, v in enumerate(want):
            out[i] = b0 * v + s1
            s1, s2 = b1 * v - a1 * out[i] + s2, b2 * v - a2 * out[i]
        want = out
    got = x
    for section in sections:
        got = fl._run_section(section, got, np.zeros(2))
    assert np.allclose(got, want, atol=1e-10)


def test_peaks_keep_the_taller_neighbour():
    x = np.array([0, 2, 0, 3, 0, 1, 1, 0, 5, 0], float)
    assert list(fl.peaks(x, .5, 1)) == [1, 3, 5, 8]
    assert list(fl.peaks(x, .5, 3)) == [3, 8]
    assert list(fl.peaks(x, 2.5, 1)) == [3, 8]


def synthetic_ecg(seconds=180, fs=250.0, breath_hz=.22):
    """Spiky beats whose rate follows breathing."""
    t = np.arange(int(seconds * fs)) / fs
    breath = np.sin(2 * np.pi * breath_hz * t)
    phase = np.cumsum((1.08 + .08 * np.roll(breath, int(1.2 * fs))) / fs)
    marks = np.flatnonzero(np.diff(np.floor(phase)) > 0)
    ecg = np.zeros_like(t)
    for at in marks:
        span = np.arange(max(0, at - 20), min(len(t), at + 21))
        ecg[span] += np.exp(-((span - at) / 4.0) ** 2)
    return ecg + .01 * np.random.default_rng(0).normal(size=len(t)), breath, marks


def test_a_recording_becomes_a_coupled_pair(spark):
    ecg, breath, marks = synthetic_ecg()
    found = fl.beats(ecg, 250.0)
    assert len(found) == len(marks) and np.max(np.abs(found - marks)) <= 1
    windows = spark.createDataFrame([("a", 0, ecg.tolist(), breath.tolist()), ("a", 1, [0.0] * 5000, breath[:5000].tolist())],
                                    "record string, segment int, ecg array<double>, resp array<double>")
    kept, excluded = sg.paired_series(windows, ["record", "segment"], 250.0, 4.0, .05, .8)
    row = kept.first()
    assert row.segment == 0 and row.qc.valid_rr_fraction == 1.0 and 60 < row.qc.mean_heart_rate_bpm < 70
    assert excluded.first().segment == 1 and "beats detected" in excluded.first().reason
    assert sg.dominant_hz(kept, "source", 4.0).first().freq_hz == pytest.approx(.22, abs=.02)
    best = cp.lagged_corr(kept.withColumn("window_id", F.lit(1)), 12).first()
    assert best.fwd_score > .9


def header(fmt):
    return f"# c\nrec 2 250/1 6\n\nrec.dat {fmt} 100(5)/uV 12 0 0 0 0 ECG LEAD\nrec.dat {fmt} 0 12 -7 0 0 0 RESP\n"


@pytest.mark.parametrize("fmt, top", [("16", 32767), ("212", 2047)])
def test_decoding_inverts_packing(spark, fmt, top):
    values = [0, 1, -1, top, -top - 1, 100, 7, -300, 12, 13, -14, 15]
    packed = (src.pack16 if fmt == "16" else src.pack212)(F.array(*[F.lit(x).cast("long") for x in values]))
    files = spark.range(1).select(F.lit("rec.dat").alias("file"), packed.alias("content"))
    heads = src.parse_headers(spark.createDataFrame([(header(fmt),)], "text string"))
    one, two = sorted(heads.collect(), key=lambda r: r.channel)
    assert (one.name, one.gain, one.baseline, one.units, one.fs, one.n_samples) == ("ECG LEAD", 100.0, 5, "uV", 250.0, 6)
    assert (two.name, two.gain, two.baseline, two.units) == ("RESP", 200.0, -7, "mV")
    rows = sorted((r.idx, r.channel, r.digital, r.value) for r in src.decode_signals(files, heads, 2).collect())
    assert [d for _, _, d, _ in rows] == values and rows[0][3] == -0.05 and rows[1][3] == 8 / 200


def test_other_formats_are_refused(spark):
    texts = [header("8"), header("16").replace("rec.dat 16 0", "other.dat 16 0").replace("rec 2", "two 2")]
    heads = src.parse_headers(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert heads.where("problem IS NULL").count() == 0 and heads.count() == 4


def test_ranges_stay_even(spark):
    heads = spark.createDataFrame([("r", 250.0, 1000, 3, 1.5)], "record string, fs double, n_samples long, n_signals int, bytes_per_sample double")
    spans = spark.createDataFrame([("r", 0.0, 1.0), ("r", .012, 2.0), ("r", .02, 2.0), ("r", 3.0, 2.0)], "record string, start_s double, duration_s double")
    got = {r.start_s: (r.start_b, r.end_b, r.problem is None) for r in rw.plan_ranges(heads, spans).collect()}
    # 1.5 and 2.5 pairs both round to 2: ties go to the even count.
    assert got == {0.0: (0, 1124, True), .012: (18, 2267, True), .02: (18, 2267, True), 3.0: (None, None, False)}


# Coupling
def naive(source, target, shift, lag_max):
    rolled = np.concatenate([source[shift:], source[:shift]])
    fwd = [abs(np.corrcoef(rolled[:-k], target[k:])[0, 1]) for k in range(1, lag_max + 1)]
    rev = [abs(np.corrcoef(target[:-k], rolled[k:])[0, 1]) for k in range(1, lag_max + 1)]
    return max(fwd), 1 + int(np.argmax(fwd)), max(rev), 1 + int(np.argmax(rev))


def test_tests_match_a_direct_computation(spark):
    rng = np.random.default_rng(5)
    source = rng.normal(size=80)
    target = np.roll(source, 3) + .5 * rng.normal(size=80)
    todo = spark.createDataFrame([(1, 11, source.tolist(), target.tolist(), [("a", 2), ("b", 6)])],
                                 "window_id int, seed long, source array<double>, target array<double>, arms array<struct<arm:string,max_lag:int>>")
    shifts = todo.select(cp.shifts(19, F.col("seed"), F.lit(80)).alias("s")).first().s
    rows = {r.arm: r for r in cp.coupling_tests(todo, 19, ["window_id"]).collect()}
    for arm, lag in (("a", 2), ("b", 6)):
        obs, sur = naive(source, target, 0, lag), [naive(source, target, s, lag) for s in shifts]
        r = rows[arm]
        assert (r.fwd_score, r.fwd_lag, r.rev_score, r.rev_lag) == pytest.approx(obs, abs=1e-9)
        assert r.fwd_p == pytest.approx((1 + sum(s[0] >= obs[0] for s in sur)) / 20)
        assert r.fwd_adj_p == pytest.approx((1 + sum(max(s[0], s[2]) >= obs[0] for s in sur)) / 20)
        assert r.rev_adj_p == pytest.approx((1 + sum(max(s[0], s[2]) >= obs[2] for s in sur)) / 20)
    assert rows["b"].fwd_lag == 3 and rows["b"].fwd_adj_p == .05
    catalyst = cp.lagged_corr(todo, 6).first()
    assert catalyst.fwd_lag == 3 and catalyst.fwd_score == pytest.approx(rows["b"].fwd_score)


def test_scale_flatness_and_short_pairs(spark):
    rng = np.random.default_rng(7)
    source = rng.normal(size=60)
    target = np.roll(source, 2) + .2 * rng.normal(size=60)
    flat = [.1] * 60
    rows = [(1, source, target), (2, source * 1e-9, target * 1e-9), (3, flat, target), (4, source[:3], target[:3]), (5, source[:1], target[:1])]
    todo = spark.createDataFrame([(i, 3, list(map(float, a)), list(map(float, b)), [("a", 4)]) for i, a, b in rows],
                                 "window_id int, seed long, source array<double>, target array<double>, arms array<struct<arm:string,max_lag:int>>")
    got = {r.window_id: r for r in cp.coupling_tests(todo, 9, ["window_id"]).collect()}
    assert got[2].fwd_score == pytest.approx(got[1].fwd_score) and got[2].fwd_lag == got[1].fwd_lag == 2
    assert got[3].fwd_score == 0.0 and got[3].reason is None
    for i, n in ((4, 3), (5, 1)):
        assert got[i].max_lag == 4 and got[i].fwd_score is None and got[i].fwd_lag is None
        assert got[i].reason == f"{n} samples are too few for a lag of 4"


def test_empty_and_short_windows_are_excluded(spark):
    rows = [(1, [], []), (2, [1.0] * 10, [2.0] * 10), (3, None, None), (4, [0.0, 1.0] * 400, [])]
    windows = spark.createDataFrame(rows, "segment int, ecg array<double>, resp array<double>")
    kept, excluded = sg.paired_series(windows, ["segment"], 50.0, 4.0, .05, .5)
    assert kept.collect() == [] and {r.segment for r in excluded.collect()} == {1, 2, 3, 4}
    assert [r.beats for r in sg.detect_beats(windows, "ecg", 50.0).orderBy("segment").collect()][:3] == [None] * 3
    assert {r.segment for r in sg.spectrum(windows, "ecg", 50.0, ["segment"]).collect()} == {2, 4}


@pytest.mark.parametrize("chunk", [2, 4, 64])
def test_flat_tops_are_peaks(spark, chunk):
    given = {"a": [0, 5, 5, 0, 7, 0], "b": [1] * 5 + [3] * 9 + [2, 2, 4, 4], "c": [9, 1, 2, 2, 2, 1, 9], "d": [4], "e": [2, 2, 2]}
    rows = [(r, i, float(x)) for r, xs in given.items() for i, x in enumerate(xs)]
    samples = spark.createDataFrame(rows, "record string, pos long, x double")
    got = {(r.record, r.pos) for r in se.local_peaks(samples, ["record"], "x", 2.0, chunk=chunk).collect()}
    want = {(r, int(p)) for r, xs in given.items() for p in fl.peaks(np.array(xs, float), 2.0, 1)}
    assert got == want and ("a", 1) in got


def test_the_study_is_the_same_however_it_is_scheduled(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, i % 3, i % 2, .25, rng.normal(size=40).tolist(), rng.normal(size=40).tolist()) for i in range(8)]
    windows = spark.createDataFrame(rows, "window_id int, position int, record int, segment int, freq_hz double, source array<double>, target array<double>")
    controls = windows.limit(2).select(F.lit("null").alias("kind"), F.col("position").alias("trial"), "freq_hz", "source", "target")
    study = Settings(.05, 4.0, [Arm("s", 1.0), Arm("d", 2.0, "half_period", .5)], [Stratum("all")])
    a = cp.study_lag_window(windows, controls, study, 9, 1).collect()
    b = cp.study_lag_window(windows.repartition(5), controls, study, 9, 1).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b)) and len(a) == (8 + 8 + 2) * 2
    assert {r.seed for r in a if r.kind == "mismatched"} == {1 + 1_000_000 + i for i in range(8)}


def test_surrogate_p_floor(spark):
    scores = spark.createDataFrame([("w", e, k, 1.0 if k == 0 else .1 * (e == "r")) for e in "fr" for k in range(20)], "w string, edge string, k int, score double")
    assert {r.p for r in cp.surrogate_p(scores, ["w", "edge"]).collect()} == {.05}
    assert {r.adj_p for r in cp.max_stat_p(scores, ["w"], "edge").collect()} == {.05}


def test_draws_are_the_same_in_sql(spark):
    rows = spark.range(200).select("id", draw(F.col("id") + 1, 7, "x", F.col("id")).alias("d"), draw(F.lit(0), F.col("id")).alias("none")).collect()
    want = dict(duckdb.sql(f"SELECT id, {draw_sql('id + 1', 7, repr('x'), 'id')} FROM range(200) AS r(id)").fetchall())
    assert {r.id: r.d for r in rows} == want and all(0 <= r.d <= r.id for r in rows) and {r.none for r in rows} == {None}
    assert len(set(want.values())) > 60


def test_headers_of_one_record_are_judged_together_without_a_join(spark):
    """Two texts that name one record: a channel in an unknown format or another file spoils all of its channels."""
    texts = ["a 1 250 8\na.dat 16 100", "a 1 250 8\nb.dat 16 100", "b 2 250 8\nb.dat 16 100\nb.dat 16 100", "c 1 250 8\nc.dat 16 x"]
    heads = src.parse_headers(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert {(r.record, r.channel, (r.problem or "")[:10]) for r in heads.collect()} == {
        ("a", 0, "only singl"), ("b", 0, ""), ("b", 1, ""), ("c", 0, "unreadable")}
    assert heads.count() == 5 and "Join" not in heads._jdf.queryExecution().optimizedPlan().toString()


def test_rotations_of_tests_are_drawn_as_spark_draws_them(spark):
    """The rows that go to the tests carry no list of rotations; those drawn there are the same."""
    from attest.functions.draws import draws
    from attest.operators.coupling import coupling_tests, shifts
    rows = spark.createDataFrame([(7, 5), (2_000_003, 64), (-4, 2), (None, 9)], "seed long, n int")
    for r in rows.withColumn("h", shifts(25, F.col("seed"), F.col("n"))).collect():
        before = "" if r.seed is None else f"{r.seed}|"
        assert (1 + draws(r.n - 1, before, 25)).tolist() == r.h
    todo = spark.createDataFrame([(1, 7, [1.0, 2.0, 4.0, 3.0, 1.0], [2.0, 1.0, 0.0, 5.0, 1.0])], "id int, seed long, source array<double>, target array<double>")
    got = coupling_tests(todo.withColumn("arms", F.array(F.struct(F.lit("a").alias("arm"), F.lit(2).alias("max_lag")))), 25, ["id"])
    assert "sha2" not in got._jdf.queryExecution().toString() and got.count() == 1


def test_lags_meet_all_rotations_in_one_product(monkeypatch):
    """Scores equal a plain correlation at each lag, however many lags a block has."""
    from attest.functions import lagged
    rng = np.random.default_rng(3)
    for cells in (1, 70, 1 << 18):
        monkeypatch.setattr(lagged, "_CELLS", cells)
        for n in (4, 5, 33):
            a, b = rng.normal(size=(3, n)), rng.normal(size=n)
            top, _ = lagged._best(a, b, 6)
            plain = np.array([[abs(np.corrcoef(x[:n - k], b[k:])[0, 1]) if k <= n - 2 else 0.0 for k in range(1, 7)] for x in a])
            assert np.allclose(top, np.maximum.accumulate(plain, axis=1), atol=1e-12)


def test_windows_leave_a_worker_in_pieces(spark):
    """A batch of texts is small, its samples are not: a worker never holds the results of a whole batch (an iterator, 204)."""
    from attest.functions.batches import in_pieces
    from attest.plans import signals as ps

    pieces = list(in_pieces([[1, 2], None, [3], b"four", 5.0], 3))
    assert [list(p) for p in pieces] == [[[1, 2], None], [[3], b"four"], [5.0]] and list(in_pieces([])) == []
    for made in (ps.bandpass(spark, "/root/testdata/sf0.001"), ps.detect_beats(spark, "/root/testdata/sf0.001")):
        udfs = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
        assert udfs and all(line.rstrip().endswith(", 204") for line in udfs)
