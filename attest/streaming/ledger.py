"""The first-read log, the seen gate and window quality on streams."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from attest.functions.intervals import clip_to_pages, page_of
from attest.operators.coverage import RANGE, distinct_entries, require_seen

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Positions of a page of an object: the key of the state that says what has been read.
STATE_PAGE = 1 << 16
_RANGE = "url string, start_b bigint, end_b bigint"
_CARRIED = "seq bigint, sha256 string, first_read_at timestamp_ntz, first_read_by string"
_NAMES = [c.split()[0] for c in _CARRIED.split(", ")]


def add_span(starts: list[int], ends: list[int], first: int, last: int) -> int:
    """Add first..last to sorted spans that neither overlap nor touch; how many positions are new."""
    i, j = bisect.bisect_left(ends, first - 1), bisect.bisect_right(starts, last + 1)
    known = sum(max(0, min(e, last) - max(s, first) + 1) for s, e in zip(starts[i:j], ends[i:j]))
    starts[i:j], ends[i:j] = [min([first, *starts[i:j]])], [max([last, *ends[i:j]])]
    return last - first + 1 - known


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The frames of a key in order of ``seq``; a key that only the initial state has comes with none or an empty one."""
    frames = [frame for frame in rows if len(frame)]
    return pd.concat(frames, ignore_index=True).sort_values("seq", kind="stable") if frames else pd.DataFrame()


class PageCover(StatefulProcessor):
    """For each read of a page: how many of its positions no earlier read had. State: the page's merged spans."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spans = handle.getValueState("spans", "starts array<bigint>, ends array<bigint>")

    def _held(self) -> tuple[list[int], list[int]]:
        held = self.spans.get() if self.spans.exists() else None
        return (list(held[0]), list(held[1])) if held is not None else ([], [])

    def _added(self, rows: pd.DataFrame) -> list[int]:
        starts, ends = self._held()
        fresh = [add_span(starts, ends, s, e) for s, e in zip(rows["low_b"].tolist(), rows["high_b"].tolist())]
        self.spans.update((starts, ends))
        return fresh

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._added(initialState)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reads = _in_order(rows)  # one page's reads of the batch
        if len(reads):
            yield reads.assign(fresh=self._added(reads))[[*RANGE, *_NAMES, "fresh"]]

    def close(self) -> None:
        pass


class RangeLog(StatefulProcessor):
    """Outcome of each read, from the new positions of all its pages. State: the logged hash of each exact range that begins in a page."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.logged = handle.getValueState("logged", "starts array<bigint>, ends array<bigint>, hashes array<string>")

    def _held(self) -> dict[tuple[int, int], str]:
        held = self.logged.get() if self.logged.exists() else None
        return dict(zip(zip(held[0], held[1]), held[2])) if held is not None else {}

    def _keep(self, logged: dict[tuple[int, int], str]) -> None:
        self.logged.update(([k[0] for k in logged], [k[1] for k in logged], list(logged.values())))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        ranges = zip(initialState["start_b"].tolist(), initialState["end_b"].tolist())
        self._keep({**self._held(), **dict(zip(ranges, initialState["sha256"].tolist()))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = _in_order(rows)
        if not len(parts):
            return
        reads = parts.drop_duplicates("seq")
        logged, told = self._held(), []
        before = len(logged)
        fresh = parts.groupby("seq")["fresh"].sum().tolist()
        for first, last, sha, new in zip(reads["start_b"].tolist(), reads["end_b"].tolist(), reads["sha256"].tolist(), fresh):
            known = logged.get((first, last))
            if new and known is None:
                logged[first, last] = sha
                told.append("appended")
            else:
                told.append("covered" if known is None else "known" if sha == known else "content_changed")
        if len(logged) > before:
            self._keep(logged)
        yield reads.assign(outcome=told)[[*RANGE, *_NAMES, "outcome"]]

    def close(self) -> None:
        pass


def judged_reads(reads: DataFrame, base: DataFrame, page: int = STATE_PAGE) -> DataFrame:
    """A stream of reads with the outcome of each: ``appended``, ``known``, ``covered`` or ``content_changed``.

    The state is keyed by (object, page) and stays in the state store: the page's merged spans, and the logged hashes of
    the exact ranges that begin in it. ``base`` seeds it once; from then on a micro-batch costs what it reads, whatever the ledger's
    size. Reads are taken in order of ``seq``, which has to tell them apart, within a micro-batch. One page's reads
    of a micro-batch stand in one task, so the source's limits of files or rows per trigger bound its memory.
    """
    clipped = [F.col("_s").alias("low_b"), F.col("_e").alias("high_b")]
    pages = clip_to_pages(reads.select(*RANGE, *_NAMES), "start_b", "end_b", page).select(*RANGE, *_NAMES, "page", *clipped)
    seen = clip_to_pages(base.select(*RANGE), "start_b", "end_b", page).select("url", "page", *clipped)
    fresh = pages.groupBy("url", "page").transformWithStateInPandas(
        PageCover(), f"{_RANGE}, {_CARRIED}, fresh bigint", "Append", "None", seen.groupBy("url", "page"))
    home = page_of(F.col("start_b"), page)
    logged = distinct_entries(base).select(*RANGE, "sha256", home.alias("page"))
    return fresh.withColumn("page", home).groupBy("url", "page").transformWithStateInPandas(
        RangeLog(), f"{_RANGE}, {_CARRIED}, outcome string", "Append", "None", logged.groupBy("url", "page"))


def first_reads(reads: DataFrame, base: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                page: int = STATE_PAGE) -> StreamingQuery:
    """Log only the first reads of a stream, in order of ``seq`` within each micro-batch; refused ones go to ``<path>_refused``.

    A replayed batch overwrites its own folder and starts from the state before it, so results are exactly once.
    ``base`` and the stream share the ledger columns and ``seq``.
    """
    def step(batch: DataFrame, number: int) -> None:
        batch.persist()
        for outcome, folder in (("appended", path), ("content_changed", f"{path}_refused")):
            batch.where(F.col("outcome") == outcome).select(*base.columns).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        batch.unpersist()

    reads.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = (judged_reads(reads, base, page).writeStream.foreachBatch(step).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _touched(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger's entries on objects that the batch reads; what is swept follows the batch's objects, not the ledger."""
    return ledger.join(batch.select("url").distinct(), "url", "left_semi").select(*ledger.columns)


def seen_gate(reads: DataFrame, ledger: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
              available_now: bool = True) -> StreamingQuery:
    """Gate every micro-batch of reads against a ledger that only grows elsewhere; ``sink`` must be idempotent per batch."""
    def step(batch: DataFrame, number: int) -> None:
        sink(require_seen(batch, _touched(ledger, batch)), number)

    writer = reads.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def window_quality(samples: DataFrame, length: str, lateness: str | None = None, by: Sequence[str] = ("record",), ts: str = "ts",
                   value: str = "x", valid: Column | None = None) -> DataFrame:
    """Count, mean and share of invalid samples per event-time window and record; the same plan for batch and stream.

    With ``lateness`` a watermark bounds the state and drops later samples.
    """
    ok = valid if valid is not None else F.col(value).isNotNull() & ~F.isnan(value)
    rows = samples.withWatermark(ts, lateness) if lateness else samples
    sums = rows.groupBy(F.window(ts, length), *by).agg(
        F.count(F.lit(1)).alias("samples"), F.avg(value).alias("mean"), F.avg((~ok).cast("double")).alias("invalid_share"))
    return sums.select(F.col("window.start").alias("window_start"), *by, "samples", "mean", "invalid_share")
