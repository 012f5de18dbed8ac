"""Contiguous shards of near-equal bytes: global prefix sums of sizes from per-partition totals.

Rows are sorted by range; each range partition is summed in its own task, and only one total per partition is
added up across partitions. The prefix sum of a row then tells its shard: the one whose equal share of all bytes
holds the middle of the row. No task sees more than one range partition, and texts never move: only id, size and
checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import written

SHARDS = 16


def _before(by: list, order: list):
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def byte_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row, shards in order of the id.

    ``size`` is the UTF-8 length of the text plus 1 (null counts as empty); rows without an id come first, rows of
    one id are in order of size and checksum, and identical rows take neighbouring slots. A text larger than a share
    fills its shard, and shards that it covers stay empty. An empty table gives no rows; other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    # The row's place in the scan only spreads rows that are equal in everything else over several ranges.
    order = ["doc_id", "size", "text_crc32", "_row"]
    ranged = (rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order)
              .withColumn("_part", F.spark_partition_id()))
    ranged = written(ranged, "ranges")  # range bounds are sampled, so they must be drawn once only
    totals = ranged.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    across = _before([F.lit(0)], ["_part"])  # one row per partition, whatever the number of documents
    offsets = totals.select("_part", F.coalesce(F.sum("_bytes").over(across), F.lit(0)).alias("_bytes_before"),
                            F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_rows_before"))
    whole = totals.agg(F.sum("_bytes").alias("_all"))
    within = _before(["_part"], order)
    placed = (ranged
              .withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
              .withColumn("_at", F.count(F.lit(1)).over(within))
              .join(F.broadcast(offsets), "_part").join(F.broadcast(whole))
              .withColumn("_twice", 2 * (F.col("_start") + F.col("_bytes_before")) + F.col("size"))
              .withColumn("_at", F.col("_at") + F.col("_rows_before"))
              .withColumn("shard", F.expr(f"cast(_twice * {shards} div (2 * _all) as int)")))
    firsts = placed.groupBy("shard").agg(F.min("_at").alias("_first"))  # one row per shard
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
