"""Positions, neighbours and exact quantiles that survive one huge group.

A plain ``row_number() over (partition by key ...)`` puts a whole group in one
task. Here rows are range-partitioned on (key, order), so a hot key is split
by its order columns, and the position is put together from per-partition
counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.session import cut_lineage

_LOCAL_BITS = 33  # monotonically_increasing_id: partition << 33 | row in partition


def ordered_index(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (),
                  pos: str = "pos", size: str | None = None) -> DataFrame:
    """Add the 0-based position of each row within ``by`` under ``order``.

    ``order`` should be a total order within ``by``. With ``size`` the number
    of rows of the group is added as well. One range shuffle; the result is
    checkpointed because sampled range bounds must not be drawn twice.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    rows = cut_lineage(ranged).withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS))
    # One row per partition: bounded by the partition count, not by the data.
    counts = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(0)).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    placed = (rows.join(F.broadcast(offsets), "_pid")
              .withColumn("_at", F.col("_offset") + local).drop("_mid", "_pid", "_offset"))
    group = list(by) or ["_everything"]
    if not by:
        placed = placed.withColumn("_everything", F.lit(0))
        if size is None:
            return placed.withColumnRenamed("_at", pos).drop("_everything")
    first = placed.groupBy(*group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_size"))
    first = first.select(*[F.col(c).alias(f"_g_{c}") for c in group], "_first", "_size")
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    out = placed.join(first, on=same, how="inner").withColumn(pos, F.col("_at") - F.col("_first"))
    if size is not None:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_at", "_first", "_size", "_everything", *[f"_g_{c}" for c in group])


def with_halo(df: DataFrame, pos: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut positions into chunks of ``size`` and copy the rows near a border to the next chunk.

    Adds ``_chunk`` and ``_core`` (false for the copies). A window over
    (group, ``_chunk``) then sees every neighbour up to ``before`` rows back
    and ``after`` rows ahead, and no task holds more than
    ``size + before + after`` rows of one group.
    """
    if size <= max(before, after):
        raise ValueError("size must exceed the halo")
    own = F.floor(F.col(pos) / F.lit(size)).cast("long")
    offset = F.col(pos) - own * size
    copies = F.array_compact(F.array(
        F.struct(own.alias("chunk"), F.lit(True).alias("core")),
        F.when(offset >= size - before, F.struct((own + 1).alias("chunk"), F.lit(False).alias("core"))),
        F.when((offset < after) & (own > 0), F.struct((own - 1).alias("chunk"), F.lit(False).alias("core")))))
    return (df.withColumn("_copy", F.explode(copies))
            .withColumn("_chunk", F.col("_copy.chunk")).withColumn("_core", F.col("_copy.core")).drop("_copy"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per group, from sorted positions.

    Unlike the built-in ``percentile`` no task holds all distinct values of a group.
    """
    placed = ordered_index(df.where(F.col(value).isNotNull()).select(*by, value), [value], by, "_pos", "_n")
    out = []
    for name, q in quantiles.items():
        at = (F.col("_n") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        lo = F.max(F.when(F.col("_pos") == low, F.col(value)))
        hi = F.max(F.when(F.col("_pos") == high, F.col(value)))
        share = F.max(at - low)
        out.append((lo + (hi - lo) * share).alias(name))
    return placed.groupBy(*by).agg(*out)


def histogram_median(hist: DataFrame, by: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """Exact median per group from (value, weight) rows; the window holds one row per distinct value."""
    ordered = Window.partitionBy(*by).orderBy(value)
    whole = Window.partitionBy(*by)
    total = F.sum(weight).over(whole)
    upto = F.sum(weight).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.select(*by, value, total.alias("_n"), upto.alias("_upto"))
    low = F.min(F.when(F.col("_upto") > F.floor((F.col("_n") - 1) / F.lit(2)), F.col(value)))
    high = F.min(F.when(F.col("_upto") > F.floor(F.col("_n") / F.lit(2)), F.col(value)))
    return rows.groupBy(*by).agg(((low + high) / F.lit(2)).cast("double").alias(name))
