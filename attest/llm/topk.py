"""Exact top-k by inner product: score everything, locate each query's kth score with global histograms.

Vectors stand in blocks, and every block of queries meets every block of candidates; scores are integers, from
products of small integers in float64 that are exact. A pass counts each query's scores in ``BINS`` equal bins of
the interval that still holds its kth score; after the global sum the interval shrinks to the bin with the kth
score, until bins have width 1. A last pass returns what is above the kth score and, of the rows equal to it, those
with the smallest ids: each task returns at most ``k`` rows of a query, and the global order picks the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import written

K = 5
BINS = 1024
BLOCK = 2048
SCALE = 256


def _scaled(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(256 * x) of vectors whose components are all finite; one vector per id, the least."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c * SCALE)).cast("array<double>").alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))


def _blocks(block: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (vec_id, v) as blocks of equal length: ids and matrix as bytes."""
        for batch in (whole.slice(at, block) for whole in batches for at in range(0, whole.num_rows, block)):
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths = pa.compute.list_value_length(lists).to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([int(length)], pa.int32()), "ids": pa.array([ids[rows].astype(np.int64).tobytes()]),
                    "matrix": pa.array([flat.tobytes()])})
    return pack


def _scores(ids: bytes, matrix: bytes, query_ids: bytes, queries: bytes, dim: int):
    """Score matrix (queries x candidates), exact; a query's own row is masked."""
    c = np.frombuffer(matrix, dtype=np.float64).reshape(-1, dim) if dim else np.zeros((len(ids) // 8, 0))
    q = np.frombuffer(queries, dtype=np.float64).reshape(-1, dim) if dim else np.zeros((len(query_ids) // 8, 0))
    own = np.frombuffer(query_ids, dtype=np.int64)[:, None] == np.frombuffer(ids, dtype=np.int64)[None, :]
    most = np.abs(c).max(initial=0) * np.abs(q).max(initial=0) * max(dim, 1)
    if most < 2**53:
        return (q @ c.T).astype(np.int64), own
    return q.astype(np.int64) @ c.astype(np.int64).T, own  # 64-bit integers, as in SQL


def _pairs(batch: pa.RecordBatch):
    columns = [batch.column(name).to_pylist() for name in ("ids", "matrix", "query_ids", "queries", "dim")]
    states = [batch.column(name).to_pylist() for name in ("low", "span", "width")]
    for row in zip(*columns, *states):
        scores, own = _scores(*row[:5])
        yield (row[0], row[2], scores, own, *(np.frombuffer(x, dtype=np.int64)[:, None] for x in row[5:]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, bin, count) over the blocks of a task; scores outside the query's interval are left out."""
    held: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for _, query_ids, scores, own, low, span, width in _pairs(batch):
            valid = ~own & (scores >= low) & (scores - low < span)
            flat = (np.arange(len(low))[:, None] * BINS + (scores - low) // width)[valid]
            counts = np.bincount(flat, minlength=len(low) * BINS).reshape(len(low), BINS)
            held[query_ids] = held[query_ids] + counts if query_ids in held else counts
    for query_ids, counts in held.items():
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "query_id": pa.array(np.frombuffer(query_ids, dtype=np.int64)[q]), "bin": pa.array(b.astype(np.int32)),
            "n": pa.array(counts[q, b].astype(np.int64))})


def _extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least and greatest score of each query in a block, and how many rows it was scored against."""
    for batch in batches:
        for _, query_ids, scores, own, _, _, _ in _pairs(batch):
            some = (~own).any(axis=1)
            least = np.where(own, np.iinfo(np.int64).max, scores).min(axis=1, initial=np.iinfo(np.int64).max)
            greatest = np.where(own, np.iinfo(np.int64).min, scores).max(axis=1, initial=np.iinfo(np.int64).min)
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.frombuffer(query_ids, dtype=np.int64)[some]), "least": pa.array(least[some]),
                "greatest": pa.array(greatest[some]), "n": pa.array((~own).sum(axis=1)[some].astype(np.int64))})


def _select(k: int):
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows at or above the query's kth score (``low``), at most ``k`` of a query and block."""
        for batch in batches:
            for block_ids, query_ids, scores, own, low, _, _ in _pairs(batch):
                ids = np.frombuffer(block_ids, dtype=np.int64)
                q, c = np.nonzero(~own & (scores >= low))
                s = scores[q, c]
                order = np.lexsort((ids[c], -s, q))
                q, c, s = q[order], c[order], s[order]
                first = np.searchsorted(q, q)  # where the query's run begins
                keep = np.arange(len(q)) - first < k
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.frombuffer(query_ids, dtype=np.int64)[q[keep]]),
                    "vec_id": pa.array(ids[c[keep]]), "score": pa.array(s[keep])})
    return select


def _query_blocks(queries: DataFrame, block: int, groups: int, copies: int) -> DataFrame:
    """Queries with their interval, as blocks of equal dimension; each block once per group of candidate blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in zip(batch.column("dim").to_pylist(), batch.column("rows").to_pylist()):
                rows.sort(key=lambda r: r["query_id"])
                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim], pa.int32()),
                    "query_ids": pa.array([np.array([r["query_id"] for r in rows], dtype=np.int64).tobytes()]),
                    "queries": pa.array([np.array([r["v"] for r in rows], dtype=np.float64).tobytes()]),
                    **{name: pa.array([np.array([r[name] for r in rows], dtype=np.int64).tobytes()])
                       for name in ("low", "span", "width")}})
    blocks = (queries.withColumn("dim", F.size("v")).withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(groups)))
              .groupBy("_block", "dim").agg(F.collect_list(F.struct("query_id", "v", "low", "span", "width")).alias("rows"))
              .select("dim", "rows")
              .mapInArrow(pack, "dim int, query_ids binary, queries binary, low binary, span binary, width binary"))
    return blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def _dealt(held: DataFrame, block: int, copies: int) -> DataFrame:
    """Blocks of candidates, each for one copy of the queries: by a hash of the block's ids, wherever it was made."""
    return (held.mapInArrow(_blocks(block), "dim int, ids binary, matrix binary")
            .withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int")))


def top_k(vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding",
          block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query, ties to smaller ids.

    Components become floor(256 * x). Queries are the ids divisible by ``every``, candidates all other rows than the
    query's own. Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id;
    of several vectors of one id the least counts. Vectors of different length are not compared; empty ones score 0.
    A query with fewer candidates than ``k`` gets all. An empty table gives no rows; other columns are not read.
    """
    if k < 1 or every < 1:
        raise ValueError("k and every must be at least 1")
    spark = vectors.sparkSession
    held = written(_scaled(vectors, id_col, vector_col), "vectors")
    copies = max(1, spark.sparkContext.defaultParallelism)
    candidates = written(_dealt(held, block, copies), "blocks")
    queries = held.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v")
    groups = max(1, -(-queries.count() // block))

    def scored(state: DataFrame, fn, schema: str) -> DataFrame:
        paired = candidates.join(_query_blocks(state, block, groups, copies), ["copy", "dim"])
        return paired.mapInArrow(fn, schema)

    none = F.lit(0).cast("long")
    state = queries.select("query_id", "v", none.alias("low"), none.alias("span"), none.alias("width"))
    ends = (scored(state, _extremes, "query_id long, least long, greatest long, n long").groupBy("query_id")
            .agg(F.min("least").alias("low"), F.max("greatest").alias("_high"), F.sum("n").alias("_n")))
    state = written(queries.join(ends, "query_id").select(
        "query_id", "v", "low", F.least(F.lit(k).cast("long"), "_n").alias("need"),
        (F.col("_high") - F.col("low") + 1).alias("span"),
        F.ceil((F.col("_high") - F.col("low") + 1) / F.lit(BINS)).cast("long").alias("width")), "state")
    down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        counts = scored(state, _count, "query_id long, bin int, n long").groupBy("query_id", "bin").agg(
            F.sum("n").alias("n"))
        # At most BINS rows of a query: the bin where the count from the top reaches what is needed.
        met = (counts.withColumn("_down", F.sum("n").over(down)).join(state.select("query_id", "need"), "query_id")
               .where("_down >= need and _down - n < need")
               .select("query_id", "bin", (F.col("need") - F.col("_down") + F.col("n")).alias("_left")))
        final = state.agg(F.max("width")).first()[0] in (None, 1)
        state = written(state.join(met, "query_id").select(
            "query_id", "v", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), F.col("_left").alias("need"),
            F.col("width").alias("span"), F.ceil(F.col("width") / F.lit(BINS)).cast("long").alias("width")), "state")
        if final:
            break
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (scored(state, _select(k), "query_id long, vec_id long, score long")
            .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
