"""Series operators: windowing, beat intervals, running medians, normalisation, resampling and pairing.

Samples are long: (record, idx, ...). Whatever needs neighbours works on
chunks with a halo, so one long record is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.ordering import exact_quantiles, ordered_index, with_halo

CHUNK = 1 << 16


def split_windows(samples: DataFrame, count: int, by: Sequence[str] = ("record",), idx: str = "idx") -> DataFrame:
    """Cut each record into ``count`` equal windows; the remainder is dropped."""
    sizes = samples.groupBy(*by).agg((F.floor(F.count(F.lit(1)) / F.lit(count))).cast("long").alias("_frames"))
    cut = samples.join(sizes, list(by)).where(F.col("_frames") > 0)
    segment = F.floor(F.col(idx) / F.col("_frames")).cast("long")
    return (cut.withColumn("segment", segment).where(F.col("segment") < count)
            .withColumn("offset", F.col(idx) - F.col("segment") * F.col("_frames")).drop("_frames"))


def segment_spans(specs: DataFrame) -> DataFrame:
    """(start, duration) of every window: ``count`` windows from ``first_start_s``, or one from ``start_s``.

    Input columns: first_start_s, window_s, count (segmented specs) or start_s, duration_s.
    """
    many = F.col("count").isNotNull()
    count = F.when(many, F.col("count")).otherwise(F.lit(1)).cast("int")
    first = F.when(many, F.col("first_start_s")).otherwise(F.col("start_s"))
    length = F.when(many, F.col("window_s")).otherwise(F.col("duration_s"))
    return (specs.withColumn("segment", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn("at_s", first + F.col("segment") * length).withColumn("length_s", length))


def _neighbours(df: DataFrame, by: Sequence[str], pos: str, chunk: int, before: int, after: int):
    halo = with_halo(df, pos, chunk, before, after)
    return halo, Window.partitionBy(*by, "_chunk").orderBy(pos)


def rr_intervals(beats: DataFrame, by: Sequence[str], pos: str = "pos", t: str = "t_us", chunk: int = CHUNK) -> DataFrame:
    """Interval to the previous beat in seconds, stamped at the later beat; the first beat of a group has none."""
    halo, w = _neighbours(beats, by, pos, chunk, 1, 0)
    rr = ((F.col(t) - F.lag(t).over(w)) / F.lit(1e6)).alias("rr")
    return halo.select("*", rr).where(F.col("_core") & F.col("rr").isNotNull()).drop("_chunk", "_core")


def running_median(df: DataFrame, by: Sequence[str], value: str, pos: str = "pos", n: int = 11, name: str = "local",
                   chunk: int = CHUNK) -> DataFrame:
    """Median of the ``n`` points centred on each row; beyond an end the end value is repeated."""
    half = n // 2
    halo, w = _neighbours(df, by, pos, chunk, half, half)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    around = ([F.coalesce(F.lag(value, k).over(w), first) for k in range(half, 0, -1)] + [F.col(value)]
              + [F.coalesce(F.lead(value, k).over(w), last) for k in range(1, half + 1)])
    rows = halo.select("*", F.array(*around).alias("_around")).where("_core")
    return rows.withColumn(name, F.array_sort("_around")[half]).drop("_around", "_chunk", "_core")


def rr_valid(rr: Column, local: Column) -> Column:
    """A plausible interval: 0.33 to 2 seconds and within 30 % of the local median."""
    return (rr >= 0.33) & (rr <= 2.0) & (F.abs(rr - local) <= F.lit(0.3) * local)


def zscore(df: DataFrame, by: Sequence[str], value: str, name: str = "z") -> DataFrame:
    """Standardise per group with the population deviation; null for a flat group."""
    stats = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return (df.join(stats, list(by)).withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
            .drop("_m", "_s"))


def qc_stats(beats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intervals, share of valid ones and mean rate per minute over the valid ones."""
    return beats.groupBy(*by).agg(
        F.count(F.lit(1)).alias("intervals"), F.count_if("valid").alias("valid_intervals"),
        F.avg(F.col("valid").cast("double")).alias("valid_rr_fraction"),
        F.avg(F.when(F.col("valid"), F.lit(60.0) / F.col("rr"))).alias("mean_heart_rate_bpm"))


def qc_split(windows: DataFrame, min_valid_fraction: float) -> tuple[DataFrame, DataFrame]:
    """Windows that pass the quality gate, and the others with the first reason that applies.

    Needs ``beats``, ``intervals``, ``valid_intervals``, ``finite`` and ``valid_rr_fraction``.
    """
    reason = (F.when(F.col("intervals") < 20, F.concat(F.lit("only "), "beats", F.lit(" beats detected")))
              .when(F.col("valid_intervals") < 20, F.concat(F.lit("only "), "valid_intervals", F.lit(" valid RR intervals")))
              .when(~F.col("finite"), "flat or non-finite signal")
              .when(F.col("valid_rr_fraction") < min_valid_fraction, F.concat(
                  F.lit("valid RR fraction "), F.format_string("%.3f", "valid_rr_fraction"), F.lit(f" < {min_valid_fraction}"))))
    rows = windows.withColumn("reason", reason)
    return rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull())


def amp_thresholds(samples: DataFrame, by: Sequence[str], value: str = "x") -> DataFrame:
    """99.5 % amplitudes of a signal and its mirror image, polarity, and the peak height threshold.

    The mirror image's quantile is the negated low quantile, so one sort serves both.
    """
    q = exact_quantiles(samples, by, value, {"p_up": 0.995, "low": 0.005})
    q = q.withColumn("p_down", -F.col("low"))
    flipped = F.col("p_down") > F.col("p_up")
    return q.select(*by, "p_up", "p_down", flipped.alias("flipped"),
                    (F.lit(0.35) * F.when(flipped, F.col("p_down")).otherwise(F.col("p_up"))).alias("height"))


def local_peaks(samples: DataFrame, by: Sequence[str], value: str, height: Column | float, pos: str = "pos",
                chunk: int = CHUNK) -> DataFrame:
    """Rows above what stands on both sides and at least ``height``; a flat top counts at its middle, the ends never.

    Runs of equal values are reduced to their first row and numbered, so a flat
    stretch may be longer than a chunk.
    """
    by = list(by)
    halo, w = _neighbours(samples, by, pos, chunk, 1, 0)
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.col(pos) == 0)
    starts = halo.select(*by, F.col(pos).alias("_from"), F.col(value).alias("_level"), "_core", changed.alias("_new"))
    runs = ordered_index(starts.where("_core AND _new").select(*by, "_from", "_level"), ["_from"], by, "_run")
    halo, w = _neighbours(runs, by, "_run", chunk, 1, 1)
    sides = halo.select("*", F.lag("_level").over(w).alias("_l"), F.lead("_level").over(w).alias("_r"),
                        F.lead("_from").over(w).alias("_next")).where("_core")
    middle = F.col("_from") + F.floor((F.col("_next") - 1 - F.col("_from")) / F.lit(2))
    tops = (sides.where((F.col("_level") > F.col("_l")) & (F.col("_level") > F.col("_r")))
            .select(*by, middle.cast("long").alias("_top")))
    limit = height if isinstance(height, Column) else F.lit(float(height))
    found = samples.join(tops.withColumnRenamed("_top", pos), [*by, pos], "left_semi")
    return found.where(F.col(value) >= limit).select(*samples.columns)


def resample_linear(knots: DataFrame, by: Sequence[str], step_us: int, t: str = "t_us", value: str = "x",
                    pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Linear interpolation on the grid ``start_us + k * step_us`` below ``stop_us``; the ends are held.

    Each knot emits the grid points up to the next knot, so there is no as-of
    join. ``knots`` carries ``start_us`` and ``stop_us`` and has one row per
    distinct time, numbered by ``pos`` within the group.
    """
    halo, w = _neighbours(knots, by, pos, chunk, 1, 1)
    rows = halo.select("*", F.lead(t).over(w).alias("_t1"), F.lead(value).over(w).alias("_x1"),
                       F.lag(t).over(w).alias("_t_1")).where("_core")
    def first_at_or_after(moment: Column) -> Column:
        return F.greatest(F.lit(0), F.ceil((moment - F.col("start_us")) / F.lit(step_us))).cast("long")
    total = first_at_or_after(F.col("stop_us"))
    begin = F.when(F.col("_t_1").isNull(), F.lit(0).cast("long")).otherwise(first_at_or_after(F.col(t)))
    stop = F.least(total, F.when(F.col("_t1").isNull(), total).otherwise(first_at_or_after(F.col("_t1"))))
    grid = (rows.where(begin < stop).withColumn("k", F.explode(F.sequence(begin, stop - 1)))
            .withColumn("grid_us", F.col("start_us") + F.col("k") * F.lit(step_us)))
    slope = (F.col("_x1") - F.col(value)) / ((F.col("_t1") - F.col(t)) / F.lit(1e6))
    inside = F.col("_t1").isNotNull() & (F.col("grid_us") > F.col(t))
    y = F.when(inside, F.col(value) + slope * ((F.col("grid_us") - F.col(t)) / F.lit(1e6))).otherwise(F.col(value))
    return grid.select(*by, "k", "grid_us", y.alias("y"))


def _ring(placed: DataFrame, by: Sequence[str], offset: Column, partner_columns: Sequence[str]) -> DataFrame:
    # One row has one partner, so the join is one to one however large the ring is.
    other = placed.select(*by, F.col("_j").alias("_p"), *[F.col(c).alias(f"partner_{c}") for c in partner_columns])
    return (placed.where("_n > 1").withColumn("_p", F.pmod(F.col("_j") + offset, F.col("_n")))
            .join(other, [*by, "_p"]).drop("_p", "_j", "_n"))


def mismatched_pairs(windows: DataFrame, order: Sequence[str], partner_columns: Sequence[str],
                     segment: str = "segment") -> DataFrame:
    """Pair every window with another member of its segment; the partner moves on by one in each segment.

    Segments with one member have no pair. ``order`` must order the members of a segment totally.
    """
    placed = ordered_index(windows, order, [segment], "_j", "_n")
    step = F.col(segment) % F.greatest(F.col("_n") - 1, F.lit(1))
    return _ring(placed, [segment], F.lit(1) + step, partner_columns)


def next_subject_pairs(windows: DataFrame, order: Sequence[str], partner_columns: Sequence[str]) -> DataFrame:
    """Pair every window with the next one in ``order``, the last with the first."""
    placed = ordered_index(windows.withColumn("_ringed", F.lit(0)), order, ["_ringed"], "_j", "_n")
    return _ring(placed, ["_ringed"], F.lit(1), partner_columns).drop("_ringed")
