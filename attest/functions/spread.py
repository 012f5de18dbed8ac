"""Give CPU-heavy work enough tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _scan_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str, always: bool = False, split: int = 128 << 20) -> DataFrame:
    """Repartition by ``keys`` when the input is too small to be split into two tasks per core.

    A large scan already has that many splits and is left alone, so no
    shuffle is added at scale. ``always`` is for work that costs far more
    than moving its rows (surrogate tests, filters): adaptive execution would
    merge such partitions by their size in bytes. ``split`` is how many bytes of
    input are enough for a task; cheap work needs fewer than its rows cost to move.
    """
    spark = df.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    if always:
        return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    return df if _scan_bytes(df) >= tasks * split else df.repartition(tasks, *keys)
