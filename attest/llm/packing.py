"""Best-fit packing of documents into bins of equal capacity, under conflicts of source and duplicate cluster.

A document longer than a bin is cut into pieces; full pieces fill bins of their own, and the rest of it is packed
like a short document. Rests and short documents go, longest first, into the tightest open bin that holds neither
their source nor their cluster: open bins are kept in order of their residual, each with a bitmap of its sources
and one of its clusters, and the search goes on from the first residual that is large enough to the next until a
bin has no conflicting bit. If no bin is left, a new one is opened.

Rows are dealt into groups of about ``GROUP`` by a hash and each group is packed by itself, so work grows with the
number of groups, and a source or cluster that holds a third of all rows is spread over all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import word_count, written

CAPACITY = 2048
#: Rows that are packed together; a bound for one task's search, not for the number of rows.
GROUP = 4096


class OpenBins:
    """Open bins in order of residual; ``place`` finds the tightest one without a conflict."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """``source`` and ``cluster`` are bitmaps with at most one bit."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, number = self.order[at]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                self.sources[number] |= source
                self.clusters[number] |= cluster
                break
            at += 1
        else:
            residual, number = self.capacity, len(self.sources)
            self.sources.append(source)
            self.clusters.append(cluster)
        if residual > size:
            insort(self.order, (residual - size, number))
        return number


def _bits(values: pd.Series) -> list[int]:
    """One bit per value that occurs twice or more; others and nulls conflict with nothing."""
    counts = values.value_counts()
    bit = {value: 1 << i for i, value in enumerate(counts.index[counts > 1])}
    return [bit.get(value, 0) for value in values]


def _pack(capacity: int):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["_rest", "_row"], ascending=[False, True])
        bins = OpenBins(capacity)
        placed = [bins.place(int(size), source, cluster) for size, source, cluster in
                  zip(rows["_rest"], _bits(rows["_source"]), _bits(rows["_cluster"]))]
        return pd.DataFrame({"_row": rows["_row"], "_group": rows["_group"], "_bin": placed,
                             "_offset": rows.groupby(np.array(placed))["_rest"].cumsum() - rows["_rest"]})
    return pack


def best_fit(docs: DataFrame, size: Column | None = None, cluster: Column | None = None, capacity: int = CAPACITY,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, size, bin, offset``: where each piece of each row stands.

    ``size`` (default: words plus an end mark) is positive, ``cluster`` defaults to a hash of the text. No bin holds
    more than ``capacity``, two rows of one source or two rows of one cluster; a null source or cluster conflicts with
    nothing. Null, empty and blank texts take the end mark's place only. Repeated rows are packed each. ``bin`` is
    ``group-number`` for packed pieces and ``row:piece`` for pieces that fill a bin. An empty table gives no rows;
    other columns are not read.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    text = F.col(text_col)
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("_source"),
        (cluster if cluster is not None else F.when(text != "", F.xxhash64(text))).alias("_cluster"),
        (size if size is not None else word_count(text) + 1).cast("long").alias("_size"),
    ).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    groups = max(1, -(-rows.count() // group))
    rows = (rows.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .withColumn("_full", F.expr(f"_size div {capacity}")).withColumn("_rest", F.col("_size") % capacity))
    packed = (rows.where("_rest > 0").select("_group", "_row", "_source", "_cluster", "_rest").groupBy("_group")
              .applyInPandas(_pack(capacity), "_row long, _group long, _bin int, _offset long"))
    rests = packed.join(rows.select("_row", "doc_id", "_full", "_rest"), "_row").select(
        "doc_id", F.col("_full").cast("int").alias("piece"), (F.col("_full") * capacity).alias("start"),
        F.col("_rest").alias("size"), F.concat_ws("-", "_group", "_bin").alias("bin"), F.col("_offset").alias("offset"))
    full = rows.where("_full > 0").select(
        "doc_id", "_row", F.explode(F.sequence(F.lit(0), (F.col("_full") - 1).cast("int"))).alias("piece")).select(
        "doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
        F.lit(capacity).cast("long").alias("size"), F.concat_ws(":", "_row", "piece").alias("bin"),
        F.lit(0).cast("long").alias("offset"))
    return rests.unionByName(full)
