"""Hard negatives by the threshold algorithm: sorted access along every dimension, random access for whole scores.

Candidates stand in blocks; a block has its rows in ascending order of each dimension. For an anchor the lists are read from
the end that adds most: from the greatest value where the anchor's component is positive, from the least where it is
negative. Each row that turns up is scored in integers. No row that has not turned up can score more than the
threshold, the anchor's product with the values that the lists have come to; a block is done as soon as that falls
strictly below the kth score of every window (with fewer than k rows in a window: below its lower end), so that no tie
is lost. Best rows of blocks are put together by task and then in one global order.

The search runs twice: over rows of the anchor's label for its positives, then over all others with a window for each positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import written

SCALE = 256
#: Candidates in a block, anchors in a group, and rows read of each list before the threshold is looked at first.
BLOCK, GROUP, STEP = 4096, 256, 64
#: Parts into which the candidates are dealt at most, and anchors of which a task holds results at most.
LANES, HELD = 256, 50_000
_INT = np.iinfo(np.int64)


def usable(vectors: DataFrame, label: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, label, v): floor(256 * x) of rows with an id, a label and a vector of finite components; of several
    rows of one id the least vector (then the least label) counts."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & finite)
            .select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"),
                    F.transform(x, lambda c: F.floor(c * SCALE)).cast("array<double>").alias("v"))
            .where(F.col("label").isNotNull())
            .groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("_row")).select("vec_id", "_row.label", "_row.v"))


def _packed(size: int, lists: bool):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of (vec_id, label, v) as blocks of equal length."""
        for batch in (whole.slice(at, size) for whole in batches for at in range(0, whole.num_rows, size)):
            ids, labels, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            lengths = pa.compute.list_value_length(v).to_numpy()
            for length in np.unique(lengths):
                rows = np.flatnonzero(lengths == length)
                rows = rows[np.argsort(ids[rows])]
                matrix = v.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
                out = {"dim": [int(length)], "ids": [ids[rows].tobytes()], "labels": [labels[rows].tobytes()],
                       "matrix": [matrix.tobytes()]}
                if lists:
                    out["lists"] = [np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_pydict(out | {"dim": pa.array(out["dim"], pa.int32())})
    return pack


class Candidates:
    """A block: ``lists[d]`` has the rows in ascending order of dimension d."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, lists: np.ndarray):
        self.ids, self.labels, self.matrix, self.lists = ids, labels, matrix, lists
        self.most = np.abs(matrix).max(initial=0)
        self.whole: np.ndarray | None = None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.most * np.abs(anchor).max(initial=0) * max(len(anchor), 1) < 2**53:
            return (self.matrix[rows] @ anchor).astype(np.int64)  # exact in double precision
        if self.whole is None:
            self.whole = self.matrix.astype(np.int64)
        return self.whole[rows] @ anchor.astype(np.int64)  # 64-bit integers, as in SQL

    def search(self, anchor: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int
               ) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) of the first ``k`` allowed rows of each window ``low <= score <= high``: highest first, then the least id."""
        n, up, down = len(self.ids), np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        waiting = allowed.copy()
        found = np.zeros(0, dtype=np.int64)
        scores = np.zeros(0, dtype=np.int64)
        at, step, best = 0, STEP, []
        while True:
            to = min(n, at + step)
            fresh = np.zeros(n, dtype=bool)
            if len(up) + len(down) and to < n:
                fresh[self.lists[up, n - to:n - at]] = True
                fresh[self.lists[down, at:to]] = True
            else:
                fresh[:] = True  # the lists are through
            rows = np.flatnonzero(fresh & waiting)
            waiting &= ~fresh
            some = self.scores(rows, anchor)
            keep = (some >= low.min()) & (some <= high.max())
            found, scores = np.append(found, rows[keep]), np.append(scores, some[keep])
            order = np.lexsort((self.ids[found], -scores))
            found, scores = found[order], scores[order]
            best = []
            kth = low.copy()
            for i in range(len(low)):
                first = int(np.searchsorted(-scores, -high[i]))
                last = min(first + k, int(np.searchsorted(-scores, -low[i], side="right")))
                best.append(slice(first, max(first, last)))
                if last - first == k:
                    kth[i] = scores[last - 1]
            if to == n or not waiting.any():
                break
            threshold = (anchor[up] @ self.matrix[self.lists[up, n - to], up]
                         + anchor[down] @ self.matrix[self.lists[down, to - 1], down])
            if threshold < kth.min():
                break
            keep = np.zeros(len(found), dtype=bool)
            for part in best:
                keep[part] = True
            found, scores = found[keep], scores[keep]
            at, step = to, 2 * step
        return [(self.ids[found[part]], scores[part]) for part in best]


def _numbers(row: dict, *names: str) -> list[np.ndarray]:
    return [np.frombuffer(row[name], np.int64) for name in names]


def _search(k: int, ask: Callable[[dict, int], tuple[np.ndarray, np.ndarray, np.ndarray]], same: bool):
    """Each row has a block and a group of anchors. ``ask`` gives the keys and window ends of a group's anchor."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def given() -> pa.RecordBatch:
            keys = list(best)
            n = [len(best[x][0]) for x in keys]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([x[0] for x in keys], n).astype(np.int64)), pa.array(np.repeat([x[1] for x in keys], n).astype(np.int64)),
                 pa.array(np.concatenate([best[x][0] for x in keys])), pa.array(np.concatenate([best[x][1] for x in keys]))],
                ["anchor_id", "positive_id", "vec_id", "score"])

        last, block = None, None
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if row["ids"] is not last and row["ids"] != last:
                    ids, labels = _numbers(row, "ids", "labels")
                    block = Candidates(ids, labels, np.frombuffer(row["matrix"]).reshape(len(ids), dim),
                                       np.frombuffer(row["lists"], np.int32).reshape(dim, len(ids)))
                    last = row["ids"]
                anchors, kinds = _numbers(row, "anchor_ids", "anchor_labels")
                vectors = np.frombuffer(row["anchors"]).reshape(len(anchors), dim)
                for i, (anchor, kind) in enumerate(zip(anchors.tolist(), kinds.tolist())):
                    keys, low, high = ask(row, i)
                    allowed = (block.labels == kind) & (block.ids != anchor) if same else block.labels != kind
                    if not allowed.any() or not len(keys):
                        continue
                    for key, (ids, scores) in zip(keys.tolist(), block.search(vectors[i], allowed, low, high, k)):
                        if len(ids):
                            if (anchor, key) in best:
                                ids, scores = np.append(best[anchor, key][0], ids), np.append(best[anchor, key][1], scores)
                                order = np.lexsort((ids, -scores))[:k]
                                ids, scores = ids[order], scores[order]
                            best[anchor, key] = ids, scores
                if len(best) >= HELD:
                    yield given()
                    best = {}
        if best:
            yield given()
    return search


def _everything(row: dict, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(1, np.int64), np.array([-_INT.max]), np.array([_INT.max])


def _windows(row: dict, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, keys, low, high = _numbers(row, "first", "keys", "low", "high")
    part = slice(first[i], first[i + 1])
    return keys[part], low[part], high[part]


def _groups(anchors: DataFrame, size: int) -> DataFrame:
    """Anchors with their windows (a list of (positive_id, low, high), or none) as groups of equal dimension."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, size) for whole in batches for at in range(0, whole.num_rows, size)):
            rows = batch.to_pylist()
            for dim in sorted({len(r["v"]) for r in rows}):
                some = [r for r in rows if len(r["v"]) == dim]
                asked = [w for r in some for w in r["windows"]]

                def numbers(values) -> list[bytes]:
                    return [np.array(values, dtype=np.int64).tobytes()]

                yield pa.RecordBatch.from_pydict({
                    "dim": pa.array([dim], pa.int32()), "anchor_ids": numbers([r["vec_id"] for r in some]),
                    "anchor_labels": numbers([r["label"] for r in some]),
                    "anchors": [np.array([r["v"] for r in some], dtype=np.float64).tobytes()],
                    "first": numbers(np.cumsum([0, *(len(r["windows"]) for r in some)])),
                    **{name: numbers([w[name] for w in asked]) for name in ("keys", "low", "high")}})
    return anchors.select("vec_id", "label", "v", "windows").mapInArrow(
        pack, "dim int, anchor_ids binary, anchor_labels binary, anchors binary, first binary, keys binary, low binary, high binary")


def hard_negatives(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, share: tuple[int, int] = (50, 95),
                   label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
                   group: int = GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    Scores are integer inner products of floor(256 * x). Anchors are rows whose id is divisible by ``every``; their
    positives are the ``n_positives`` best other rows of their label; negatives are rows of another label with
    ``share[0] * positive <= 100 * negative <= share[1] * positive``. Higher scores come first, then smaller ids; where
    there are fewer, all are given, and an anchor without positives or a window without rows gives none. Rows
    with a null id, label or vector, or a null or non-finite component take no part; of several rows of one id the least
    vector counts. Vectors of different length are not compared. An empty table gives no rows. Other columns than id, vector and
    label are not read.
    """
    if min(every, n_positives, n_negatives) < 1:
        raise ValueError("every, n_positives and n_negatives must be at least 1")
    held = written(usable(vectors, F.col("label") if label is None else label, id_col, vector_col), "vectors")
    blocks = written(held.mapInArrow(_packed(block, True), "dim int, ids binary, labels binary, matrix binary, lists binary"), "lists")
    lanes = max(1, min(LANES, blocks.count()))
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int"))
    lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    anchors = held.where(F.col("vec_id") % every == 0)
    none = F.array().cast("array<struct<keys: long, low: long, high: long>>")
    columns = "anchor_id long, positive_id long, vec_id long, score long"

    def scored(asked: DataFrame, k: int, ask, same: bool) -> DataFrame:
        pairs = dealt.join(_groups(asked, group).select("*", lane), ["lane", "dim"])
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
        return (pairs.mapInArrow(_search(k, ask, same), columns)
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))

    positives = written(scored(anchors.withColumn("windows", none), n_positives, _everything, True)
                        .select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * negative lies between two multiples of the positive's score: the integers from the ceiling to the floor.
    hundreds, rest = F.expr("positive_score div 100"), F.col("positive_score") % 100  # no product leaves 64 bits
    low = (hundreds * share[0] + F.ceil(rest * share[0] / 100)).cast("long")
    high = (hundreds * share[1] + F.floor(rest * share[1] / 100)).cast("long")
    asked = (positives.withColumn("low", low).withColumn("high", high).where("low <= high")
             .groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("keys"), "low", "high")).alias("windows")))
    found = scored(anchors.join(asked, F.col("anchor_id") == F.col("vec_id")), n_negatives, _windows, False)
    return found.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
