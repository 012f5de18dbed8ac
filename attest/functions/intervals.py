"""Byte coverage as a sweep: no interval join, no per-object task.

Intervals are inclusive at both ends. Work is split on (object, page), where a
page is a fixed stretch of positions, so a group never holds more rows than a
page has positions however many intervals an object has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.ordering import ordered_index
from attest.functions.spread import spread

PAGE = 1 << 18
MAP_PAGE = 1 << 9
MAP_BLOCK = 1 << 16
#: Children of a node of the page tree.
FAN = 1 << 15


def page_of(pos: Column, page: int) -> Column:
    return F.call_function("div", pos, F.lit(page).cast("long"))


def _present(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """Drop null keys up front, so every use of the events has the same plan and shares one shuffle."""
    for column in (*by, "page", "at"):
        events = events.where(F.col(column).isNotNull())
    return events


def tree_levels(page: int, fan: int = FAN) -> int:
    """Levels above the pages that bring any 64-bit position down to one root with at most ``fan`` children."""
    return max(1, -(-(63 - (page.bit_length() - 1)) // (fan.bit_length() - 1)))


def carries(nodes: DataFrame, by: Sequence[str], levels: int, sums: Sequence[str] = (), latest: Sequence[str] = (),
            node: str = "page", fan: int = FAN) -> DataFrame:
    """``by, node`` with the sums (0 at first), or the greatest values (null at first), of all earlier nodes within ``by``.

    Nodes are pages at the lowest level; ``fan`` neighbouring nodes have one parent. What comes before a page is what
    comes before each of its ancestors among the children of that one's parent, so a page adds one row for each level,
    all levels are worked on in the same stages, and a window sees the children of one parent: no task holds more
    than one node's children however many pages an object has.
    """
    by = list(by)

    def ancestor(level: int) -> Column:
        out = F.col(node)
        for _ in range(level):
            out = page_of(out, fan)
        return out.cast("long")
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), ancestor(k).alias("node"), (
        ancestor(k + 1) if k + 1 < levels else F.lit(0).cast("long")).alias("parent")) for k in range(levels)]))
    climbed = nodes.select(*by, node, *sums, *latest, steps.alias("_up"))
    totals = climbed.groupBy(*by, F.col("_up.level").alias("_level"), F.col("_up.parent").alias("_parent"), F.col("_up.node").alias("_node")).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])
    earlier = Window.partitionBy(*by, "_level", "_parent").orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "_level", "_node", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums],
                           *[F.max(c).over(earlier).alias(c) for c in latest])
    asked = climbed.select(*by, node, F.col("_up.level").alias("_level"), F.col("_up.node").alias("_node"))
    return asked.join(before, [*by, "_level", "_node"]).groupBy(*by, node).agg(
        *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in latest])


def _events(spans: DataFrame, points: DataFrame | None, by: Sequence[str], start: str, end: str, at: str, page: int) -> DataFrame:
    """``by, page, at, o, c``: how many spans open at a position, and how many have just closed there."""
    edges = spread(spans.select(*by, start, end), *by, start, split=4 << 20).select(*by, F.explode(F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).alias("o"), F.lit(0).alias("c")),
        F.struct((F.col(end) + 1).alias("at"), F.lit(0).alias("o"), F.lit(1).alias("c")))).alias("e")).select(*by, "e.*")
    if points is not None:
        edges = edges.unionByName(points.select(*by, F.col(at).alias("at"), F.lit(0).alias("o"), F.lit(0).alias("c")))
    return (_present(edges.withColumn("page", page_of(F.col("at"), page)), by)
            .groupBy(*by, "page", "at").agg(F.sum("o").alias("o"), F.sum("c").alias("c")))


def sweep(spans: DataFrame, points: DataFrame, by: Sequence[str], start: str = "start_b", end: str = "end_b",
          at: str = "at", page: int = PAGE, fan: int = FAN, levels: int | None = None) -> DataFrame:
    """What lies below every distinct position, for the starts and ends of ``spans`` and for ``points``.

    Columns out: ``by``, ``at``; ``below``, positions the union covers below
    it; ``mass``, the same with overlaps counted as often as they occur;
    ``opened``, spans that start below it; ``closed``, spans that end below
    it. Each span adds two events, whatever its length; equal positions are
    summed before the shuffle. Prefix sums run within pages and up and down a tree of
    pages. What is covered is where runs have ended less where they have begun, so no event needs its neighbour.
    """
    by, levels = list(by), levels or tree_levels(page, fan)
    events = _events(spans, points, by, start, end, at, page).withColumn(
        "m", F.col("at").cast("decimal(20,0)") * (F.col("o") - F.col("c")))
    in_page = Window.partitionBy(*by, "page").orderBy("at")
    upto, before = in_page.rowsBetween(Window.unboundedPreceding, 0), in_page.rowsBetween(Window.unboundedPreceding, -1)

    def running(column: str):
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    pages = events.groupBy(*by, "page").agg(F.sum("o").alias("_bo"), F.sum("c").alias("_bc"), F.sum("m").alias("_bm"))
    active, after = F.col("opened") - F.col("_was_closed"), F.col("_now_opened") - F.col("closed")
    edge = F.when((active > 0) & (after == 0), F.col("at")).when((active == 0) & (after > 0), -F.col("at")).otherwise(F.lit(0))
    runs = (events.join(carries(pages, by, levels, ["_bo", "_bc", "_bm"], fan=fan), [*by, "page"])
            .select(*by, "page", "at", (F.col("_bo") + running("o")).alias("opened"), (F.col("_bc") + F.sum("c").over(upto)).alias("closed"),
                    (F.col("_bo") + F.sum("o").over(upto)).alias("_now_opened"), (F.col("_bc") + running("c")).alias("_was_closed"),
                    (F.col("_bm") + running("m")).alias("_starts"))
            .withColumns({"_active": active, "_edge": edge}))
    ends = runs.groupBy(*by, "page").agg(F.sum("_edge").alias("_be"))
    return runs.join(carries(ends, by, levels, ["_be"], fan=fan), [*by, "page"]).select(
        *by, "at", (F.col("_be") + running("_edge") + F.when(F.col("_active") > 0, F.col("at")).otherwise(F.lit(0))).alias("below"),
        (F.col("at").cast("decimal(20,0)") * F.col("_active") - F.col("_starts")).cast("long").alias("mass"), "opened", "closed")


def _at_both_ends(wanted: DataFrame, spans: DataFrame, by: Sequence[str], values: Sequence[str], start: str, end: str,
                  page: int, fan: int = FAN) -> DataFrame:
    """Wanted ranges with the sweep's values at their first position (``_lo_*``) and behind their last (``_hi_*``).

    Each different range is asked once, by its bounds alone; whatever else the wanted rows hold moves for one join.
    """
    by = list(by)
    once = wanted.select(*by, start, end).distinct()
    points = once.select(*by, F.explode(F.array(F.col(start), F.col(end) + 1)).alias("at"))
    swept = sweep(spans, points, by, start, end, "at", page, fan).select(*by, "at", *values)
    rows = once.withColumn("_lo", F.col(start)).withColumn("_hi", F.col(end) + 1)
    for side in ("_lo", "_hi"):
        rows = rows.join(swept.select(*by, F.col("at").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in values]), [*by, side])
    return wanted.join(rows.drop("_lo", "_hi"), [*by, start, end])


def union_cover(wanted: DataFrame, spans: DataFrame, by: Sequence[str], name: str = "covered",
                start: str = "start_b", end: str = "end_b", page: int = PAGE, fan: int = FAN) -> DataFrame:
    """Add to each wanted range the positions that the union of ``spans`` covers."""
    rows = _at_both_ends(wanted, spans, by, ["below"], start, end, page, fan)
    return rows.select(*wanted.columns, (F.col("_hi_below") - F.col("_lo_below")).alias(name))


def overlap_totals(wanted: DataFrame, spans: DataFrame, by: Sequence[str], start: str = "start_b", end: str = "end_b",
                   page: int = PAGE, fan: int = FAN) -> DataFrame:
    """Add how many spans overlap each wanted range and the positions they share, every span counted; no pairs are formed."""
    rows = _at_both_ends(wanted, spans, by, ["mass", "opened", "closed"], start, end, page, fan)
    return rows.select(*wanted.columns, (F.col("_hi_opened") - F.col("_lo_closed")).alias("overlapping"),
                       (F.col("_hi_mass") - F.col("_lo_mass")).alias("shared"))


def islands(spans: DataFrame, by: Sequence[str], start: str = "start_b", end: str = "end_b",
            page: int = PAGE, fan: int = FAN) -> DataFrame:
    """Start of every maximal run of overlapping spans, with the start of the next run.

    Touching spans share no position, so they are separate runs.
    """
    by = list(by)
    events = _events(spans, None, by, start, end, "at", page).withColumn("net", F.col("o") - F.col("c"))
    in_page = Window.partitionBy(*by, "page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pages = events.groupBy(*by, "page").agg(F.sum("net").alias("base"))
    open_before = F.col("base") + F.coalesce(F.sum("net").over(in_page), F.lit(0))
    return (events.join(carries(pages, by, tree_levels(page, fan), ["base"], fan=fan), [*by, "page"])
            .withColumn("left", open_before - F.col("c"))
            .where((F.col("o") > 0) & (F.col("left") == 0)).select(*by, F.col("at").alias("island")))


def clip_to_pages(df: DataFrame, start: str, end: str, page: int) -> DataFrame:
    """One row per page a range touches, with the clipped bounds ``_s`` and ``_e`` (inclusive)."""
    first, last = page_of(F.col(start), page), page_of(F.col(end), page)
    return (df.withColumn("page", F.explode(F.sequence(first, last)))
            .withColumn("_s", F.greatest(F.col(start), F.col("page") * page))
            .withColumn("_e", F.least(F.col(end), F.col("page") * page + (page - 1))))


_NEVER = np.iinfo(np.int64).max


def _lowest(begin: np.ndarray, stop: np.ndarray, moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut points and, from each to the next, the lowest moment of the half-open spans covering it.

    A range minimum table filled backwards: a span of n cuts is two blocks of
    the largest power of two below n, and blocks hand their minimum down.
    """
    cuts = np.unique(np.concatenate([begin, stop]))
    i, j = np.searchsorted(cuts, begin), np.searchsorted(cuts, stop)
    level = np.log2(j - i).astype(np.int64)
    low = np.full(len(cuts), _NEVER, dtype=np.int64)
    for k in range(int(level.max()), -1, -1):
        mine = level == k
        np.minimum.at(low, i[mine], moment[mine])
        np.minimum.at(low, j[mine] - (1 << k), moment[mine])
        if k:
            half = 1 << (k - 1)
            low[half:] = np.minimum(low[half:], low[:-half].copy())
    return cuts, low


def _runs_per_page(begin: np.ndarray, stop: np.ndarray, moment: np.ndarray, page: int) -> pd.DataFrame:
    """The lowest-moment runs of one block, cut at page borders, as one row of lists per page."""
    cuts, low = _lowest(begin, stop, moment)
    borders = np.arange(cuts[0] // page + 1, cuts[-1] // page + 1) * page
    points = np.union1d(cuts, borders)
    value = low[np.searchsorted(cuts, points, side="right") - 1][:-1]
    s, e = points[:-1], points[1:] - 1
    first = np.concatenate([[True], (value[1:] != value[:-1]) | (s[1:] % page == 0)])
    head = np.flatnonzero(first)
    tail = np.concatenate([head[1:], [len(s)]]) - 1
    s, e, value = s[head], e[tail], value[head]
    keep = value != _NEVER
    s, e, value = s[keep], e[keep], value[keep]
    pages, at = np.unique(s // page, return_index=True)
    return pd.DataFrame({"page": pages, "s": np.split(s, at[1:]), "e": np.split(e, at[1:]), "m": np.split(value, at[1:])})


def earliest_map(spans: DataFrame, by: Sequence[str], moment: str, start: str = "start_b", end: str = "end_b",
                 page: int = MAP_PAGE, block: int = MAP_BLOCK) -> DataFrame:
    """The earliest ``moment`` (long) of every position: one row per (``by``, page) with disjoint runs.

    A span inside a block is the union of two power-of-two pieces, so
    ``min(moment)`` per (piece length, piece start) is combined before the
    shuffle and a block group holds at most ``block * log2(block)`` rows.
    Columns out: ``by``, ``page``, ``runs array<struct<s,e,m>>`` (at most ``page`` entries).
    """
    by = list(by)
    clipped = clip_to_pages(spans.select(*by, start, end, moment), start, end, block)
    level = F.floor(F.log2((F.col("_e") - F.col("_s") + 1).cast("double"))).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level"))
    pieces = (clipped.withColumn("level", level)
              .select(*by, "page", width.alias("width"), F.col(moment).alias("moment"),
                      F.explode(F.array(F.col("_s"), F.col("_e") - width + 1)).alias("at"))
              .groupBy(*by, F.col("page").alias("block"), "width", "at").agg(F.min("moment").alias("moment")))
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in by] + ["page long", "s array<long>", "e array<long>", "m array<long>"])

    def collapse(group: pd.DataFrame) -> pd.DataFrame:
        at = group["at"].to_numpy()
        out = _runs_per_page(at, at + group["width"].to_numpy(), group["moment"].to_numpy(), page)
        for place, column in enumerate(by):
            out.insert(place, column, group[column].iloc[0])
        return out

    mapped = pieces.groupBy(*by, "block").applyInPandas(collapse, schema)
    return mapped.select(*by, "page", F.arrays_zip("s", "e", "m").alias("runs"))


def border_ranks(ranges: Sequence[DataFrame], by: Sequence[str], start: str = "start_b", end: str = "end_b",
                 moment: str | None = None) -> DataFrame:
    """Both borders of every different range (where it begins, and where it has just ended) in the order of (``by``, ``at``).

    Columns out: ``by``, ``start``, ``end``; ``_m``, the range's lowest ``moment``, null where no table has one; ``at``; ``rank``,
    the border's place among all. One range sort of the borders is the only order that is needed.
    """
    by, held = list(by), None
    for df in ranges:
        own = df.select(*by, start, end, (F.col(moment) if moment in df.columns else F.lit(None)).cast("long").alias("_m"))
        held = own if held is None else held.unionByName(own)
    for column in (*by, start, end):
        held = held.where(F.col(column).isNotNull())
    once = held.where(F.col(end) >= F.col(start)).groupBy(*by, start, end).agg(F.min("_m").alias("_m"))
    return ordered_index(once.select("*", F.explode(F.array(F.col(start), F.col(end) + 1)).alias("at")),
                         [*by, "at", start, end], (), "rank")


def covered_before(wanted: DataFrame, spans: DataFrame, key: Sequence[str], by: Sequence[str], moment: str, span_moment: str,
                   name: str = "covered", start: str = "start_b", end: str = "end_b", page: int = MAP_PAGE,
                   block: int = MAP_BLOCK) -> DataFrame:
    """Positions of each wanted range whose earliest span has a moment strictly before the row's own ``moment``.

    Positions are numbered by the borders of the ranges, so the work follows the
    number of ranges and not their length: between two borders nothing changes.
    Borders of one object are neighbours, so one numbering serves all objects.
    A page is ``page`` such stretches; each (range, page) meets one row of the
    map of first moments and one list of borders, and no pairs are emitted.
    ``key`` must identify a wanted row.
    """
    key, by = list(key), list(by)
    asked = wanted.select(*key, *[c for c in (*by, start, end) if c not in key], F.col(moment).alias("_moment"))
    borders = border_ranks([asked.select(*by, start, end), spans.select(*by, start, end, F.col(span_moment).alias("_m"))],
                           by, start, end, "_m")
    ranked = borders.groupBy(*by, start, end).agg(F.min("rank").alias("_first"), (F.max("rank") - 1).alias("_last"),
                                                  F.min("_m").alias("_m"))
    first = earliest_map(ranked.where(F.col("_m").isNotNull()), [], "_m", "_first", "_last", page, block)
    # A border between two pages ends the last stretch of the one before.
    places = (borders.select("rank", "at", F.explode(F.array_distinct(F.array(
        page_of(F.col("rank"), page), page_of(F.greatest(F.col("rank") - 1, F.lit(0)), page)))).alias("page"))
              .groupBy("page").agg(F.sort_array(F.collect_list(F.struct("rank", "at"))).alias("_borders")))
    met = (clip_to_pages(asked.join(ranked.select(*by, start, end, "_first", "_last"), [*by, start, end])
                         .select(*key, "_moment", "_first", "_last"), "_first", "_last", page)
           .join(first, "page").join(places, "page"))
    base = F.col("page") * page

    def at(rank: Column) -> Column:
        return F.get("_borders", (rank - base).cast("int"))["at"]

    inside = F.aggregate(
        F.filter("runs", lambda r: (r["m"] < F.col("_moment")) & (r["s"] <= F.col("_e")) & (r["e"] >= F.col("_s"))),
        F.lit(0).cast("long"),
        lambda acc, r: acc + at(F.least(r["e"], F.col("_e")) + 1) - at(F.greatest(r["s"], F.col("_s"))))
    sums = met.withColumn("_inside", inside).groupBy(*key).agg(F.sum("_inside").alias("_inside"))
    return (wanted.join(sums, key, "left")
            .withColumn(name, F.coalesce(F.col("_inside"), F.lit(0).cast("long"))).drop("_inside"))


def micros(column: Column | str) -> Column:
    """Microseconds of a timestamp as a long (naive timestamps count as UTC)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


__all__ = ["PAGE", "MAP_PAGE", "MAP_BLOCK", "FAN", "carries", "tree_levels", "sweep", "union_cover", "overlap_totals", "islands", "clip_to_pages", "earliest_map",
           "covered_before", "border_ranks", "micros", "page_of"]
