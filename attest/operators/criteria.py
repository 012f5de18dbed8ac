"""Pre-stated criteria applied to measurements: guards, success and failure rules give a status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.expressions import Criterion, holds

GROUPS = ("guards", "success", "failure")
VERDICTS = {"passed": "supported", "failed": "not_supported", "inconclusive": "insufficient_evidence",
            "error": "not_evaluated"}
# Metrics the coverage operators contribute rather than the study.
HOLDOUT_METRICS = ("holdout_bytes_read_before_registration", "holdout_bytes_read_before_anchor")


def apply_criteria(runs: DataFrame, measurements: DataFrame, criteria: DataFrame) -> DataFrame:
    """One row per run and criterion of its experiment: observed value and whether it holds (null if not measured)."""
    asked = runs.select("exp_id", "run_id").join(criteria, "exp_id")
    seen = measurements.select("run_id", F.col("name").alias("metric"), F.col("value").alias("observed"))
    return (asked.join(seen, ["run_id", "metric"], "left")
            .withColumn("holds", holds(F.col("observed"), F.col("op"), F.col("value")))
            .select("exp_id", "run_id", "grp", "ord", "id", "metric", "op", "value", "observed", "holds"))


def _status(error: Column, guards: Column, failure: Column, success: Column) -> Column:
    return (F.when(error, "error").when(~guards, "inconclusive").when(failure, "failed")
            .when(success, "passed").otherwise("inconclusive"))


def verdict_of(status: Column) -> Column:
    out = None
    for name, verdict in VERDICTS.items():
        out = F.when(status == name, verdict) if out is None else out.when(status == name, verdict)
    return out


def summary_sentence(status: Column, successes: Column, failed: Column, unmet: Column, missing: Column) -> Column:
    """The sentence behind a status; ids are listed in registered order."""
    return (F.when(status == "failed", F.concat(
                F.when(F.size(failed) > 1, "Failure criteria triggered: ").otherwise("Failure criterion triggered: "),
                F.array_join(failed, ", "), F.lit(". The hypothesis is not supported.")))
            .when(status == "passed", F.concat(F.lit("All "), successes, F.lit(
                " success criteria held and no failure criterion triggered.")))
            .when(status == "error", F.lit(None))
            .when(F.size(missing) > 0, F.concat(F.lit("Not evaluable: "), F.array_join(missing, ", "), F.lit(".")))
            .otherwise(F.concat(F.lit("Not met: "), F.array_join(unmet, ", "), F.lit("."))))


def evaluate(runs: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Status, verdict and summary per run. ``runs`` may carry a boolean ``error``.

    A guard that is false or unmeasured blocks a verdict, a failure that holds
    dominates success, and a run without criteria rows has nothing against it.
    """
    true = F.coalesce("holds", F.lit(False))
    def names(which: Column) -> Column:
        rows = F.collect_list(F.when(which, F.struct("ord", "id")))  # bounded by the criteria of one experiment
        return F.transform(F.array_sort(rows), lambda r: r["id"])
    guard, success, failure = (F.col("grp") == g for g in GROUPS)
    per = evaluation.groupBy("run_id").agg(
        F.coalesce(F.every(F.when(guard, true)), F.lit(True)).alias("_guards"),
        F.coalesce(F.some(F.when(failure, true)), F.lit(False)).alias("_failure"),
        F.coalesce(F.every(F.when(success, true)), F.lit(True)).alias("_success"),
        F.count(F.when(success, 1)).alias("_successes"),
        names(failure & true).alias("triggered"), names((guard | success) & ~true).alias("_unmet"),
        names((guard | success) & F.col("holds").isNull()).alias("_missing"))
    error = F.coalesce(F.col("error"), F.lit(False)) if "error" in runs.columns else F.lit(False)
    rows = runs.join(per, "run_id", "left").withColumn("status", _status(
        error, F.coalesce("_guards", F.lit(True)), F.coalesce("_failure", F.lit(False)), F.coalesce("_success", F.lit(True))))
    return (rows.withColumn("verdict", verdict_of(F.col("status")))
            .withColumn("summary", summary_sentence(F.col("status"), F.coalesce("_successes", F.lit(0)), F.col("triggered"),
                                                    F.col("_unmet"), F.col("_missing")))
            .drop("_guards", "_failure", "_success", "_successes", "_unmet", "_missing"))


def judge_wide(wide: DataFrame, criteria: Sequence[Criterion]) -> DataFrame:
    """Add ``status`` and one ``holds_<id>`` per criterion to rows that hold measurements as columns."""
    have = set(wide.columns)
    flags = {c.id: holds(F.col(c.metric), c.op, c.value) if c.metric in have else F.lit(None).cast("boolean")
             for c in criteria}

    def both(grp: str) -> list[Column]:
        return [F.coalesce(flags[c.id], F.lit(False)) for c in criteria if c.grp == grp]

    def every(columns: list[Column]) -> Column:
        out = F.lit(True)
        for column in columns:
            out &= column
        return out

    def some(columns: list[Column]) -> Column:
        out = F.lit(False)
        for column in columns:
            out |= column
        return out

    status = _status(F.lit(False), every(both("guards")), some(both("failure")), every(both("success")))
    return wide.select("*", status.alias("status"), *[flag.alias(f"holds_{name}") for name, flag in flags.items()])


def select_registered(measurements: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registered metrics of each run in registered order, and the registered metrics no run row produced."""
    runs = measurements.select("exp_id", "run_id").distinct()
    asked = runs.join(metrics.select("exp_id", "ord", "name"), "exp_id")
    made = measurements.select("run_id", "name", "value", F.lit(True).alias("_made"))
    rows = asked.join(made, ["run_id", "name"], "left")
    return (rows.where("_made").drop("_made"),
            rows.where(F.col("_made").isNull()).select("exp_id", "run_id", "ord", "name"))


def metric_tiers(metrics: DataFrame, criteria: DataFrame, produced: DataFrame) -> DataFrame:
    """Each name of an experiment as ``evaluated`` (a criterion reads it), ``described`` or ``unregistered``."""
    used = criteria.select("exp_id", F.col("metric").alias("name")).distinct().withColumn("_used", F.lit(True))
    registered = metrics.select("exp_id", "name").join(used, ["exp_id", "name"], "left").select(
        "exp_id", "name", F.when(F.col("_used"), "evaluated").otherwise("described").alias("tier"))
    extra = produced.select("exp_id", "name").distinct().join(metrics, ["exp_id", "name"], "left_anti").select(
        "exp_id", "name", F.lit("unregistered").alias("tier"))
    return registered.unionByName(extra)


def is_zero_guard(criteria: DataFrame) -> DataFrame:
    """Per experiment: is there a guard that only holds when no holdout byte was read early?"""
    zero = ((F.col("op") == "<=") & (F.col("value") == 0)) | ((F.col("op") == "<") & (F.col("value") > 0) & (F.col("value") <= 1))
    guard = (F.col("grp") == "guards") & F.col("metric").isin(*HOLDOUT_METRICS) & zero
    return criteria.groupBy("exp_id").agg(F.some(F.coalesce(guard, F.lit(False))).alias("guarded"))


def set_aside(criteria: DataFrame, metrics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Criteria a rehearsal applies, and those it sets aside with the reason."""
    units = metrics.select("exp_id", F.col("name").alias("metric"), "unit").distinct()
    reason = (F.when(F.col("metric").isin(*HOLDOUT_METRICS), "holdout: an exploration is not held out")
              .when((F.col("grp") == "guards") & (F.col("unit") == "count"),
                    "size: an exploration is smaller than the experiment it rehearses"))
    rows = criteria.join(units, ["exp_id", "metric"], "left").withColumn("reason", reason).drop("unit")
    return rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull())


def unproducible(metrics: DataFrame, outputs: Sequence[str], holdout: bool = False) -> DataFrame:
    """Registered metrics that a run with these outputs cannot produce."""
    names = [*outputs, *(HOLDOUT_METRICS if holdout else ())]
    return metrics.where(~F.col("name").isin(*names))
