"""Lead-lag coupling of paired series, tested against rotated surrogates and mismatched partners."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.draws import draw, draws
from attest.functions.expressions import Arm, Settings, arm_lag
from attest.functions.lagged import judge, pair_scores
from attest.functions.spread import spread
from attest.operators.measures import output_names
from attest.operators.series import mismatched_pairs, next_subject_pairs

# Seed offsets per kind of test: fixed values, so stored seeds can be compared.
ARM_OFFSETS = {"real": 0, "mismatched": 1_000_000, "positive": 2_000_000, "null": 2_001_000, "long_lag": 2_002_000}
SIMPLE_OFFSETS = {"real": 0, "mismatched": 1_000, "positive": 2_000, "null": 3_000}


def test_seed(seed: int, kind: Column, position: Column, offsets: dict[str, int] = ARM_OFFSETS) -> Column:
    """Seed of a test as a function of its kind and position, so scheduling cannot matter."""
    out = None
    for name, offset in offsets.items():
        value = F.lit(seed + offset) + position
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out.cast("long")


def _corr_at(a: Column, b: Column, lag: Column) -> Column:
    """Pearson correlation of a[t] with b[t + lag], from one pass of sums; null when a side is flat."""
    n = F.least(F.size(a), F.size(b)) - lag
    zipped = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, lag + 1, n),
                        lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.lit(0.0)
    sums = F.aggregate(
        zipped, F.struct(*[zero.alias(c) for c in ("x", "y", "xx", "yy", "xy")]),
        lambda s, p: F.struct((s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"),
                              (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"),
                              (s["xy"] + p["x"] * p["y"]).alias("xy")),
        lambda s: F.try_divide(s["xy"] - s["x"] * s["y"] / n, F.sqrt(F.greatest(zero, s["xx"] - s["x"] * s["x"] / n)
                                                                    * F.greatest(zero, s["yy"] - s["y"] * s["y"] / n))))
    return sums


def lag_profile(pairs: DataFrame, max_lag: int, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """|correlation| at every lag 1..max_lag in both directions; row-local, no shuffle."""
    lags = F.sequence(F.lit(1), F.lit(max_lag))
    rows = pairs.select(*keys, "source", "target", F.explode(lags).alias("lag"))
    return rows.select(*keys, "lag", F.abs(_corr_at(F.col("source"), F.col("target"), F.col("lag"))).alias("fwd"),
                       F.abs(_corr_at(F.col("target"), F.col("source"), F.col("lag"))).alias("rev"))


def lagged_corr(pairs: DataFrame, max_lag: int, keys: Sequence[str] = ("window_id",)) -> DataFrame:
    """Best |correlation| and its lag in both directions; ties go to the smaller lag. Row-local, no shuffle."""
    def best(a: str, b: str) -> Column:
        scored = F.transform(F.sequence(F.lit(1), F.lit(max_lag)), lambda lag: F.struct(
            F.coalesce(F.abs(_corr_at(F.col(a), F.col(b), lag)), F.lit(0.0)).alias("score"), (-lag).alias("neg")))
        return F.array_max(scored)
    rows = pairs.select(*keys, best("source", "target").alias("f"), best("target", "source").alias("r"))
    return rows.select(*keys, F.col("f.score").alias("fwd_score"), (-F.col("f.neg")).alias("fwd_lag"),
                       F.col("r.score").alias("rev_score"), (-F.col("r.neg")).alias("rev_lag"))


def shifts(n_surrogates: int, seed: Column, length: Column) -> Column:
    """Deterministic rotations 1..length-1, one per surrogate."""
    drawn = F.transform(F.sequence(F.lit(1), F.lit(n_surrogates)),
                        lambda k: F.lit(1) + draw(length.cast("long") - 1, seed, k))
    return F.when(length >= 2, drawn).otherwise(F.array().cast("array<bigint>"))


def surrogates(pairs: DataFrame, n_surrogates: int, seed: Column, max_lag: int, key: str = "window_id") -> DataFrame:
    """Scores of the observed pair (k = 0) and of its rotated surrogates, long."""
    length = F.least(F.size("source"), F.size("target"))
    todo = pairs.select(key, "source", "target", shifts(n_surrogates, seed, length).alias("shifts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                (fwd, _), (rev, _) = pair_scores(np.asarray(row.source), np.asarray(row.target), np.asarray(row.shifts), max_lag)
                yield pd.DataFrame({key: row[0], "k": np.arange(len(fwd), dtype=np.int32), "fwd": fwd[:, -1], "rev": rev[:, -1]})

    kind = dict(pairs.dtypes)[key]
    return spread(todo, key, always=True).mapInPandas(run, f"{key} {kind}, k int, fwd double, rev double")


def surrogate_p(scores: DataFrame, by: Sequence[str], k: str = "k", score: str = "score") -> DataFrame:
    """``(1 + surrogates at or above the observed score) / (N + 1)`` per group; k = 0 is the observed score."""
    observed = scores.where(F.col(k) == 0).select(*by, F.col(score).alias("_obs"))
    rows = scores.where(F.col(k) > 0).join(observed, list(by))
    return rows.groupBy(*by).agg(((F.lit(1) + F.count_if(F.col(score) >= F.col("_obs"))) / (F.count(F.lit(1)) + 1)).alias("p"))


def max_stat_p(scores: DataFrame, window: Sequence[str], edge: str, k: str = "k", score: str = "score") -> DataFrame:
    """Family-wise p: each edge's observed score against the per-surrogate maximum over all edges of its window."""
    top = scores.where(F.col(k) > 0).groupBy(*window, k).agg(F.max(score).alias("_top"))
    observed = scores.where(F.col(k) == 0).select(*window, edge, F.col(score).alias("_obs"))
    return observed.join(top, list(window)).groupBy(*window, edge).agg(
        ((F.lit(1) + F.count_if(F.col("_top") >= F.col("_obs"))) / (F.count(F.lit(1)) + 1)).alias("adj_p"))


_TEST = ("fwd_score double, fwd_lag int, fwd_p double, fwd_adj_p double, rev_score double, rev_lag int, rev_p double, "
         "rev_adj_p double")
_TEST_NAMES = [part.split()[0] for part in _TEST.split(", ")]


def coupling_tests(todo: DataFrame, n_surrogates: int, keys: Sequence[str]) -> DataFrame:
    """Run one test per pair and arm.

    ``todo`` has the keys, ``seed``, ``source``, ``target`` and ``arms
    array<struct<arm, max_lag>>``. Rows are independent and leave in one pass;
    only numpy work on one pair happens in Python. A pair that is too short for
    an arm's lag window, or too short to be rotated, gets a row without scores
    and with a ``reason``; the registered lag stays as it is.
    """
    # Rotations are those of ``shifts``, drawn where they are used; a missing seed is left out of what is spelt.
    rows = todo.withColumn("drawn", F.coalesce(F.concat(F.col("seed").cast("string"), F.lit("|")), F.lit(""))) \
        .withColumn("limits", F.transform("arms", lambda a: a["max_lag"].cast("int"))) \
        .withColumn("names", F.col("arms.arm")).select(*keys, "seed", "source", "target", "drawn", "limits", "names")
    kinds = dict(todo.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "seed"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                limits, length = [int(x) for x in row["limits"]], min(len(row["source"]), len(row["target"]))
                fits = [x for x in limits if 1 <= x <= length - 2]
                tests = iter(judge(np.asarray(row["source"]), np.asarray(row["target"]),
                                   1 + draws(length - 1, row["drawn"], n_surrogates), fits) if fits else [])
                common = {c: row[c] for c in [*keys, "seed"]}
                for name, limit in zip(row["names"], limits):
                    short = limit not in fits
                    told = {"reason": f"{length} samples are too few for a lag of {limit}"} if short else next(tests)
                    out.append({**common, "arm": name, "max_lag": limit, **told})
            if out:
                tests = pd.DataFrame(out).reindex(columns=[*keys, "seed", "arm", "max_lag", *_TEST_NAMES, "reason"])
                yield tests.astype({"fwd_lag": "Int32", "rev_lag": "Int32", "reason": "string"})

    return spread(rows, *keys, always=True).mapInPandas(run, f"{head}, arm string, max_lag int, {_TEST}, reason string")


def _arms_column(arms: Sequence[Arm], freq: Column, fs: float) -> Column:
    return F.array(*[F.struct(F.lit(a.name).alias("arm"), arm_lag(a, freq, fs).alias("max_lag")) for a in arms])


def study_lag_window(windows: DataFrame, controls: DataFrame, settings: Settings, n_surrogates: int, seed: int,
                     order: Sequence[str] = ("record", "window_id")) -> DataFrame:
    """Every window, its mismatched partner and the controls under every arm, as ``tests``.

    ``windows``: window_id, position, record, segment, freq_hz, source, target.
    ``controls``: kind, trial, freq_hz, source, target. A mismatched pair keeps
    the lag windows, stratum and record of its source.
    """
    arms = _arms_column(settings.arms, F.col("freq_hz"), settings.fs)
    columns = ["kind", "window_id", "record", "segment", "partner", "freq_hz"]
    nothing = F.lit(None)
    real = windows.select(F.lit("real").alias("kind"), "window_id", "record", "segment",
                          nothing.cast("string").alias("partner"), "freq_hz", "position", "source", "target")
    ringed = mismatched_pairs(windows, order, ["record", "target"])
    other = ringed.select(F.lit("mismatched").alias("kind"), "window_id", "record", "segment",
                          F.col("partner_record").cast("string").alias("partner"), "freq_hz", "position", "source",
                          F.col("partner_target").alias("target"))
    kinds = dict(windows.dtypes)
    control = controls.select("kind", F.col("trial").cast(kinds["window_id"]).alias("window_id"),
                              nothing.cast(kinds["record"]).alias("record"), nothing.cast(kinds["segment"]).alias("segment"),
                              nothing.cast("string").alias("partner"), "freq_hz", F.col("trial").alias("position"),
                              "source", "target")
    todo = real.unionByName(other).unionByName(control)
    todo = todo.withColumn("seed", test_seed(seed, F.col("kind"), F.col("position"))).withColumn("arms", arms)
    return coupling_tests(todo, n_surrogates, columns)


def study_simple(windows: DataFrame, controls: DataFrame, max_lag_s: float, fs: float, n_surrogates: int, seed: int,
                 order: Sequence[str] = ("window_id",)) -> DataFrame:
    """One lag window: own pairs, next-subject pairs and given controls, as ``tests``."""
    arm = Settings(0.05, fs, [Arm("only", max_lag_s)], [])
    own = windows.select(F.lit("real").alias("kind"), "window_id", "record", "position", "source", "target")
    nxt = next_subject_pairs(windows, order, ["target"]).select(
        F.lit("mismatched").alias("kind"), "window_id", "record", "position", "source", F.col("partner_target").alias("target"))
    kinds = dict(windows.dtypes)
    control = controls.where(F.col("kind").isin("positive", "null")).select(
        "kind", F.col("trial").cast(kinds["window_id"]).alias("window_id"),
        F.lit(None).cast(kinds["record"]).alias("record"), F.col("trial").alias("position"), "source", "target")
    todo = own.unionByName(nxt).unionByName(control)
    todo = todo.withColumn("seed", test_seed(seed, F.col("kind"), F.col("position"), SIMPLE_OFFSETS)) \
        .withColumn("arms", _arms_column(arm.arms, F.lit(None).cast("double"), fs))
    return coupling_tests(todo, n_surrogates, ["kind", "window_id", "record"])


def study_series(tests: DataFrame, by: Sequence[str] = (), position: str = "window_id") -> DataFrame:
    """Series a study reports, long and ordered by position: adjusted p per arm and kind, and frequency (null as 0)."""
    p = tests.where(F.col("kind").isin("real", "mismatched")).select(
        *by, F.when(F.col("kind") == "real", F.concat(F.lit("adjusted_p_"), "arm"))
        .otherwise(F.concat(F.lit("mismatched_adjusted_p_"), "arm")).alias("name"),
        F.col(position).alias("idx"), F.col("fwd_adj_p").alias("value"))
    freq = tests.where(F.col("kind") == "real").groupBy(*by, F.col(position).alias("idx")).agg(F.first("freq_hz").alias("f"))
    return p.unionByName(freq.select(*by, F.lit("respiratory_frequency_hz").alias("name"), "idx",
                                     F.coalesce("f", F.lit(0.0)).alias("value")))


def method_problems(runs: DataFrame) -> DataFrame:
    """Runs whose analysis fell back to another method than the registered one."""
    return runs.where(~F.col("method_used").eqNullSafe(F.col("method"))).select(
        "run_id", F.concat(F.lit("fell back to '"), F.coalesce("method_used", F.lit("nothing")),
                           F.lit("'; the registered method '"), "method", F.lit("' did not run")).alias("problem"))


@dataclass(frozen=True)
class Study:
    """A named analysis: tests -> measurements, and the names it promises."""

    name: str
    run: Callable[..., DataFrame]
    outputs: Callable[[Settings], list[str]]


STUDIES: dict[str, Study] = {}


def register_study(name: str, run: Callable[..., DataFrame], outputs: Callable[[Settings], list[str]] = output_names) -> Study:
    STUDIES[name] = Study(name, run, outputs)
    return STUDIES[name]


def contract_problems(measurements: DataFrame, declared: Sequence[str]) -> DataFrame:
    """Names that a study emitted without declaring, declared without emitting, or emitted out of order."""
    promised = F.inline(F.array(*[F.struct(F.lit(i).alias("_ord"), F.lit(n).alias("name")) for i, n in enumerate(declared)]))
    table = measurements.sparkSession.range(1).select(promised)
    both = measurements.select("name", "ord").distinct().join(table, "name", "full_outer")
    problem = (F.when(F.col("_ord").isNull(), "not declared").when(F.col("ord").isNull(), "not emitted")
               .when(F.col("ord") != F.col("_ord"), "out of order"))
    return both.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("name", "problem")
