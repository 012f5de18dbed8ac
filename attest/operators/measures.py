"""Detection rates per arm and stratum, with every subject counted equally.

``tests`` has one row per test: ``kind`` (real, mismatched, positive, null,
long_lag), ``record``, ``arm``, ``freq_hz``, ``fwd_adj_p``, ``fwd_lag`` and so
on. Everything below first sums tests per subject (combined map-side), so the
later steps see subjects and cells, not tests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.expressions import Contrast, Settings, detected, stratum_of
from attest.functions.ordering import exact_quantiles, histogram_median

CONTROL_METRICS = {"positive": "synthetic_positive_detection_rate", "null": "synthetic_null_false_positive_rate",
                   "long_lag": "synthetic_long_lag_detection_rate"}


def rate(flag: Column) -> Column:
    """Share of true flags; null when there are none."""
    return F.avg(flag.cast("double"))


def median_present(column: str) -> Column:
    """Exact median of the present values, for columns with few distinct values."""
    return F.median(column)


def subject_sums(tests: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """Tests and detections per (keys, kind, arm, stratum, record)."""
    rows = tests.select(*keys, "kind", "arm", "record", stratum_of(F.col("freq_hz"), settings.strata).alias("stratum"),
                        detected("fwd_adj_p", settings.alpha).cast("long").alias("hit"))
    return rows.groupBy(*keys, "kind", "arm", "stratum", "record").agg(F.count(F.lit(1)).alias("n"),
                                                                       F.sum("hit").alias("hits"))


def lag_counts(tests: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """Detected real tests per (keys, arm, stratum, record, lag)."""
    rows = tests.where((F.col("kind") == "real") & detected("fwd_adj_p", settings.alpha)) \
        .withColumn("stratum", stratum_of(F.col("freq_hz"), settings.strata)).where(F.col("stratum").isNotNull())
    return rows.groupBy(*keys, "arm", "stratum", "record", "fwd_lag").agg(F.count(F.lit(1)).alias("n"))


def cells(sums: DataFrame, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Per (keys, kind, arm, stratum): tests, detections, subjects and the sum of subject rates.

    ``weight`` counts how often a subject was drawn; each copy is a subject of its own.
    """
    w = F.col(weight) if weight else F.lit(1)
    return sums.groupBy(*keys, "kind", "arm", "stratum").agg(
        F.sum(w * F.col("n")).alias("n"), F.sum(w * F.col("hits")).alias("hits"),
        F.sum(w).cast("long").alias("subjects"), F.sum(w * (F.col("hits") / F.col("n"))).alias("rates"))


def subject_balanced_rate(tests: DataFrame, settings: Settings, by: Sequence[str]) -> DataFrame:
    """Mean over subjects of each subject's share of detected tests."""
    rows = tests.withColumn("stratum", stratum_of(F.col("freq_hz"), settings.strata))
    own = rows.groupBy(*by, "record").agg(rate(detected("fwd_adj_p", settings.alpha)).alias("own"))
    return own.groupBy(*by).agg(F.avg("own").alias("balanced_rate"), F.count(F.lit(1)).alias("subjects"))


def stratum_counts(windows: DataFrame, settings: Settings) -> DataFrame:
    """Windows and distinct subjects per stratum; an empty stratum keeps a row of zeros."""
    per = (windows.withColumn("stratum", stratum_of(F.col("freq_hz"), settings.strata)).groupBy("stratum", "record")
           .agg(F.count(F.lit(1)).alias("n")))
    names = F.inline(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s.name).alias("stratum"))
                               for i, s in enumerate(settings.strata)]))
    declared = windows.sparkSession.range(1).select(names)
    found = per.groupBy("stratum").agg(F.sum("n").alias("windows"), F.count(F.lit(1)).alias("subjects"))
    return declared.join(found, "stratum", "left").select(
        "stratum", F.coalesce("windows", F.lit(0).cast("long")).alias("windows"),
        F.coalesce("subjects", F.lit(0).cast("long")).alias("subjects"))


def detection_rates(tests: DataFrame, settings: Settings) -> DataFrame:
    """Rates per (arm, kind) over all tests (``stratum`` = ``(all)``) and per stratum, from one pass over the tests."""
    small = cells(subject_sums(tests, settings)).groupBy("arm", "kind", "stratum").agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    both = small.withColumn("stratum", F.explode(F.array(F.lit("(all)"), F.col("stratum")))) \
        .where(F.col("stratum").isNotNull())
    return both.groupBy("arm", "kind", "stratum").agg(F.sum("n").alias("tests"),
                                                      (F.sum("hits") / F.sum("n")).alias("rate"))


def control_rates(tests: DataFrame, alpha: float) -> DataFrame:
    """Detection rate per arm and control kind, one column per kind."""
    rows = tests.where(F.col("kind").isin(*CONTROL_METRICS))
    hit = detected("fwd_adj_p", alpha)
    return rows.groupBy("arm").agg(*[rate(F.when(F.col("kind") == kind, hit)).alias(metric)
                                     for kind, metric in CONTROL_METRICS.items()])


def median_lag(tests: DataFrame, settings: Settings) -> DataFrame:
    """Median lag, in seconds, of the detected real tests per stratum and arm."""
    hist = lag_counts(tests, settings).groupBy("stratum", "arm", "fwd_lag").agg(F.sum("n").alias("n"))
    return histogram_median(hist, ["stratum", "arm"], "fwd_lag", "n", "lag").select(
        "stratum", "arm", (F.col("lag") / F.lit(settings.fs)).alias("median_lag_s"))


def reverse_rate(tests: DataFrame, alpha: float) -> DataFrame:
    """Detection rate in the reverse direction per arm and kind."""
    return tests.groupBy("arm", "kind").agg(rate(detected("rev_adj_p", alpha)).alias("reverse_rate"))


def peak_agreement(windows: DataFrame, tol: float, a: str = "source_peak_hz", b: str = "target_peak_hz",
                   by: Sequence[str] = ()) -> DataFrame:
    """Share of windows whose two spectral peaks agree; a missing peak is a disagreement."""
    agrees = F.coalesce(F.abs(F.col(a) - F.col(b)) <= F.lit(float(tol)), F.lit(False))
    return windows.groupBy(*by).agg(rate(agrees).alias("peak_agreement"))


def _name(*parts: str) -> str:
    return "_".join(parts)


def output_names(settings: Settings, contrasts: bool = True) -> list[str]:
    """Every measurement of the arm study, in emission order."""
    names = ["windows_analyzed"]
    for s in settings.strata:
        names += [_name(s.name, "windows"), _name(s.name, "subjects")]
    for arm in settings.arms:
        names += [_name("window_detection_rate", arm.name), _name("mismatched_detection_rate", arm.name)]
        for s in settings.strata:
            names += [_name(s.name, "detection_rate", arm.name), _name("mismatched", s.name, "detection_rate", arm.name),
                      _name(s.name, "median_lag_s", arm.name)]
        names += [_name(metric, arm.name) for metric in CONTROL_METRICS.values()]
    return names + ([c.name for c in settings.contrasts] if contrasts else [])


def wide_measures(parts: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with one column per measurement, from ``cells`` rows (and ``kind='median'`` rows).

    The number of columns follows from the declared arms and strata.
    """
    def cell(kind: str, arm: str, stratum: str | None = None) -> Column:
        same = (F.col("kind") == kind) & (F.col("arm") == arm)
        return same if stratum is None else same & (F.col("stratum") == stratum)

    def total(which: Column, column: str) -> Column:
        return F.sum(F.when(which, F.col(column)))

    def plain(which: Column) -> Column:
        return total(which, "hits") / total(which, "n")

    def count(which: Column, column: str) -> Column:
        return F.coalesce(total(which, column), F.lit(0)).cast("double")

    first = settings.arms[0].name
    out = [count(cell("real", first), "n").alias("windows_analyzed")]
    for s in settings.strata:
        out += [count(cell("real", first, s.name), "n").alias(_name(s.name, "windows")),
                count(cell("real", first, s.name), "subjects").alias(_name(s.name, "subjects"))]
    for arm in settings.arms:
        a = arm.name
        out += [plain(cell("real", a)).alias(_name("window_detection_rate", a)),
                plain(cell("mismatched", a)).alias(_name("mismatched_detection_rate", a))]
        for s in settings.strata:
            own = cell("real", a, s.name)
            out += [(total(own, "rates") / total(own, "subjects")).alias(_name(s.name, "detection_rate", a)),
                    plain(cell("mismatched", a, s.name)).alias(_name("mismatched", s.name, "detection_rate", a)),
                    F.max(F.when(cell("median", a, s.name), F.col("rates"))).alias(_name(s.name, "median_lag_s", a))]
        out += [plain(cell(kind, a)).alias(_name(metric, a)) for kind, metric in CONTROL_METRICS.items()]
    return with_contrasts(parts.groupBy(*keys).agg(*out), settings.contrasts)


def with_contrasts(wide: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Add ``metric(arm) - metric(minus)`` columns; null when either is null."""
    return wide.select("*", *[(F.col(_name(c.metric, c.arm)) - F.col(_name(c.metric, c.minus))).alias(c.name)
                              for c in contrasts])


def to_long(wide: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Measurements as (keys, ord, name, value)."""
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
                     for i, n in enumerate(names)])
    return wide.select(*keys, F.inline(rows))


def median_cells(hist: DataFrame, settings: Settings, keys: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Median lags as extra ``cells`` rows, from per-subject lag counts."""
    w = F.col(weight) if weight else F.lit(1)
    merged = hist.groupBy(*keys, "arm", "stratum", "fwd_lag").agg(F.sum(w * F.col("n")).alias("n"))
    medians = histogram_median(merged, [*keys, "arm", "stratum"], "fwd_lag", "n", "lag")
    nothing = F.lit(None).cast("long")
    return medians.select(*keys, F.lit("median").alias("kind"), "arm", "stratum", nothing.alias("n"),
                          nothing.alias("hits"), nothing.alias("subjects"),
                          (F.col("lag") / F.lit(settings.fs)).alias("rates"))


def measure_arms(tests: DataFrame, settings: Settings, keys: Sequence[str] = ()) -> DataFrame:
    """All measurements of the arm study, long, in emission order; also re-measures stored tests under new settings."""
    wanted = tests.where(F.col("arm").isin(*[a.name for a in settings.arms]))
    parts = cells(subject_sums(wanted, settings, keys), keys).unionByName(
        median_cells(lag_counts(wanted, settings, keys), settings, keys))
    return to_long(wide_measures(parts, settings, keys), output_names(settings), keys)


SIMPLE_NAMES = ["records_analyzed", "coupling_detection_rate", "mismatched_detection_rate", "detection_rate_gap",
                "positive_control_detection_rate", "synthetic_null_false_positive_rate", "reverse_detection_rate",
                "median_coupling_lag_s", "spectral_peak_agreement_rate", "median_respiratory_frequency_hz",
                "median_heart_rate_bpm"]


def measure_simple(tests: DataFrame, alpha: float, fs: float, peak_tol: float, keys: Sequence[str] = ()) -> DataFrame:
    """The eleven measurements of the single-lag study, from its tests (real ones carry peaks and heart rate)."""
    hit = detected("fwd_adj_p", alpha)
    def of(kind: str, column: Column) -> Column:
        return F.when(F.col("kind") == kind, column)
    real = F.col("kind") == "real"
    agrees = F.coalesce(F.abs(F.col("source_peak_hz") - F.col("target_peak_hz")) <= peak_tol, F.lit(False))
    wide = tests.groupBy(*keys).agg(
        F.coalesce(F.sum(real.cast("double")), F.lit(0.0)).alias("records_analyzed"),
        rate(of("real", hit)).alias("coupling_detection_rate"),
        rate(of("mismatched", hit)).alias("mismatched_detection_rate"),
        rate(of("positive", hit)).alias("positive_control_detection_rate"),
        rate(of("null", hit)).alias("synthetic_null_false_positive_rate"),
        rate(of("real", detected("rev_adj_p", alpha))).alias("reverse_detection_rate"),
        (F.median(F.when(real & hit, F.col("fwd_lag"))) / F.lit(fs)).alias("median_coupling_lag_s"),
        rate(of("real", agrees)).alias("spectral_peak_agreement_rate"),
        F.median(of("real", F.col("source_peak_hz"))).alias("median_respiratory_frequency_hz"))
    # Lags and spectral peaks lie on a grid; heart rates do not, so their median comes from sorted positions.
    by = list(keys) or ["_all"]
    rates = tests.where(real).withColumn("_all", F.lit(0))
    rates = exact_quantiles(rates, by, "heart_rate_bpm", {"median_heart_rate_bpm": 0.5})
    wide = wide.withColumn("_all", F.lit(0)).join(rates, by, "left").drop("_all")
    wide = wide.withColumn("detection_rate_gap", F.col("coupling_detection_rate") - F.col("mismatched_detection_rate"))
    return to_long(wide, SIMPLE_NAMES, keys)


def by_frequency(tests: DataFrame, alpha: float, step: float = 1 / 32, least: int = 3) -> DataFrame:
    """Share of windows detected per frequency bin and arm; ``enough`` marks bins with ``least`` windows or more."""
    real = tests.where(F.col("kind") == "real")
    positive = F.col("freq_hz") > 0
    slot = F.when(positive, F.floor(F.col("freq_hz") / F.lit(step) + F.lit(1e-9)))
    small = real.groupBy(slot.alias("bin"), "arm").agg(F.count(F.lit(1)).alias("n"),
                                                       F.sum(detected("fwd_adj_p", alpha).cast("long")).alias("hits"))
    return (small.where(F.col("bin").isNotNull())
            .select(F.col("bin").cast("long").alias("bin"), "arm",
                    ((F.col("bin") + F.lit(0.5)) * F.lit(step)).alias("center_hz"), F.col("n").alias("windows"),
                    (F.col("hits") / F.col("n")).alias("share"), (F.col("n") >= least).alias("enough")))


def window_lengths(windows: DataFrame) -> DataFrame:
    """Length of each report's windows: the smallest gap between the distinct starts of its first record."""
    first = windows.groupBy("report").agg(F.min_by("record", "ord").alias("record"))
    starts = windows.select("report", "record", "start_s").distinct().join(first, ["report", "record"])
    ahead = Window.partitionBy("report").orderBy("start_s")  # one row per window of one record
    gaps = starts.withColumn("gap", F.col("start_s") - F.lag("start_s").over(ahead))
    return gaps.groupBy("report").agg(F.min("gap").alias("window_s"))


def window_length_table(windows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates per window length and arm; ``rates`` has report, arm and the rate columns."""
    return rates.join(window_lengths(windows), "report")
