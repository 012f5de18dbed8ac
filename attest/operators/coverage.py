"""Which bytes were read, when and by whom: coverage of requests by a ledger of first reads.

A ledger has ``url, start_b, end_b, sha256, first_read_at, first_read_by``;
byte ranges are inclusive at both ends and "before" is strict.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.expressions import packed_hash
from attest.functions.intervals import (FAN, MAP_PAGE, PAGE, carries, covered_before, islands, micros, overlap_totals,
                                        page_of, tree_levels, union_cover)
from attest.session import cut_lineage

RANGE = ("url", "start_b", "end_b")
LEDGER = (*RANGE, "sha256", "first_read_at", "first_read_by")


def length() -> Column:
    return F.col("end_b") - F.col("start_b") + 1


def distinct_entries(ledger: DataFrame) -> DataFrame:
    """One entry per exact range: the first read wins."""
    return first_entries(ledger).select(*RANGE, "e.sha256", "e.first_read_at", "e.first_read_by")


def first_entries(ledger: DataFrame, keys: Sequence[str] = RANGE) -> DataFrame:
    """The least entry ``e`` of each range; hashes move in half their length, and other texts in their place as they are."""
    sha, packs = F.col("sha256"), F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    def least(when: Column, value: Column) -> Column:
        return F.min(F.when(when, F.struct("first_read_at", "first_read_by", value.alias("sha256"))))
    both = ledger.groupBy(*keys).agg(least(packs, F.unhex(sha)).alias("_packed"), least(~packs, sha).alias("_other"))
    packed = F.when(F.col("_packed").isNotNull(), F.struct("_packed.first_read_at", "_packed.first_read_by",
                                                           F.lower(F.hex("_packed.sha256")).alias("sha256")))
    return both.select(*keys, F.least(packed, "_other").alias("e"))


def exact_entry(ranges: DataFrame, ledger: DataFrame) -> DataFrame:
    """The entry logged for exactly this range, or nulls."""
    return ranges.join(distinct_entries(ledger), list(RANGE), "left")


def overlap_bytes(ranges: DataFrame, others: DataFrame, by: Sequence[str] = ("url",), page: int = PAGE) -> DataFrame:
    """Per range: how many of ``others`` overlap it and the bytes they share with it, each counted.

    The sum over all overlapping partners comes from prefix sums, so a range
    that a third of all entries overlap costs no more than any other.
    """
    return overlap_totals(ranges, others.select(*by, "start_b", "end_b"), by, page=page)


def covered_bytes(ranges: DataFrame, others: DataFrame, by: Sequence[str] = ("url",), page: int = PAGE) -> DataFrame:
    """Bytes of each range in the union of ``others`` (overlaps counted once)."""
    return union_cover(ranges, others.select(*by, "start_b", "end_b"), by, "covered", page=page)


def bytes_unseen(ranges: DataFrame, ledger: DataFrame, page: int = PAGE) -> DataFrame:
    """Bytes of each range that the ledger has no record of."""
    return covered_bytes(ranges, ledger, page=page).withColumn("unseen", length() - F.col("covered")).drop("covered")


def bytes_read_before(ranges: DataFrame, ledger: DataFrame, moment: str, key: str | Sequence[str] = "req_id",
                      page: int = MAP_PAGE) -> DataFrame:
    """Bytes of each range first read strictly before the range's own moment."""
    spans = ledger.select("url", "start_b", "end_b", micros("first_read_at").alias("_m"))
    rows = ranges.withColumn("_before", micros(moment))
    return covered_before(rows, spans, [key] if isinstance(key, str) else key, ["url"], "_before", "_m", "read_before",
                          page=page).drop("_before")


def _seen_and_logged(ranges: DataFrame, ledger: DataFrame, page: int) -> DataFrame:
    """Each different range once: its ``unseen`` bytes and the hash logged for exactly this range (``_logged``, packed)."""
    exact = distinct_entries(ledger).select(*RANGE, packed_hash("sha256").alias("_logged"))
    return bytes_unseen(ranges.select(*RANGE).distinct(), ledger, page).join(exact, list(RANGE), "left")


def require_seen(reads: DataFrame, ledger: DataFrame, page: int = PAGE) -> DataFrame:
    """Gate for reads that must not be first reads: ``unseen``, ``content_changed``, ``ok_exact`` or ``ok_covered``."""
    rows = reads.withColumn("_own", packed_hash("sha256")).join(_seen_and_logged(reads, ledger, page), list(RANGE))
    gate = (F.when(F.col("unseen") > 0, "unseen")
            .when(F.col("_logged").isNull(), "ok_covered")
            .when(F.col("_logged") != F.col("_own"), "content_changed")
            .otherwise("ok_exact"))
    return rows.withColumn("gate", gate).drop("_logged", "_own")


def judge_reads(ledger: DataFrame, reads: DataFrame, seq: str = "seq", page: int = MAP_PAGE) -> DataFrame:
    """Outcome of each read of an ordered batch: ``appended``, ``known``, ``covered`` or ``content_changed``.

    A read that is not logged adds no byte, so what is covered before read *i*
    is the ledger plus every earlier read. "New" then means some byte whose
    earliest reader is *i* itself, and the batch needs no ordered fold.
    """
    before = ledger.select("url", "start_b", "end_b", F.lit(-1).cast("long").alias("_m"))
    spans = before.unionByName(reads.select("url", "start_b", "end_b", F.col(seq).cast("long").alias("_m")))
    rows = covered_before(reads.withColumn("_own", F.col(seq).cast("long")), spans, [seq], ["url"], "_own", "_m", "_old",
                          page=page).withColumn("_new", length() > F.col("_old")).drop("_own", "_old")
    opener = (rows.groupBy(*RANGE).agg(F.min(F.struct(seq, "sha256", "_new")).alias("o"))
              .select(*RANGE, F.when(F.col("o._new"), F.col("o.sha256")).alias("_opened")))
    logged = distinct_entries(ledger).select(*RANGE, F.col("sha256").alias("_logged"))
    known = F.coalesce("_logged", "_opened")
    outcome = (F.when(F.col("_logged").isNull() & F.col("_new"), "appended")
               .when(known.isNull(), "covered")
               .when(known != F.col("sha256"), "content_changed")
               .otherwise("known"))
    return (rows.join(opener, list(RANGE)).join(logged, list(RANGE), "left")
            .withColumn("outcome", outcome).drop("_new", "_opened", "_logged"))


def record_reads(ledger: DataFrame, reads: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """The rows a batch of reads appends to the ledger, and the reads it refuses."""
    judged = judge_reads(ledger, reads, seq)
    return judged.where("outcome = 'appended'").drop("outcome"), judged.where("outcome = 'content_changed'")


def short_range() -> Column:
    """``file [first, last]`` as problems name a range."""
    return F.concat(F.element_at(F.split("url", "/"), -1), F.lit(" ["), F.col("start_b"), F.lit(", "),
                    F.col("end_b"), F.lit("]"))


def extends(earlier: DataFrame, later: DataFrame, by: Sequence[str] = (),
            values: Sequence[str] = ("first_read_at", "first_read_by", "sha256")) -> DataFrame:
    """Entries that stop ``later`` from being ``earlier`` plus new entries, each with its problem."""
    keys = [*by, *RANGE]
    now = later.select(*keys, F.struct(*values).alias("_now"))
    return _broken(earlier.join(now, keys, "left"), keys, values)


def _broken(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows of an earlier version whose entry in the later one (``_now``) is gone or has other values."""
    changed = F.array_compact(F.array(*[
        F.when(~F.col(v).eqNullSafe(F.col(f"_now.{v}")), F.lit(v)) for v in sorted(values)]))
    rows = rows.withColumn("_changed", changed)
    problem = (F.when(F.col("_now").isNull(), F.concat(short_range(), F.lit(": entry removed")))
               .when(F.size("_changed") > 0, F.concat(short_range(), F.lit(": "), F.array_join("_changed", ", "),
                                                      F.lit(" changed"))))
    return rows.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(*keys, "problem")


def history_extends(versions: DataFrame, by: str = "seq") -> DataFrame:
    """Append-only problems between each version and the next one; versions are in the order of their numbers.

    The numbers, one for each version of one document, go to the rows; the rows do not move to their number, so no task
    meets a whole version. All versions of a range meet once, and not at all where they lie together already.
    """
    ahead = Window.partitionBy(F.lit(0)).orderBy(by)
    numbers = versions.select(by).distinct().select(by, F.row_number().over(ahead).alias("_nth"), F.lead(by).over(ahead).alias("_next"))
    values = ("first_read_at", "first_read_by", "sha256")
    packed = versions.select(by, *RANGE, packed_hash("sha256").alias("sha256"), "first_read_at", "first_read_by").join(F.broadcast(numbers), by)
    following = Window.partitionBy(*RANGE).orderBy("_nth").rangeBetween(1, 1)
    rows = packed.withColumn("_there", F.collect_list(F.struct(*values)).over(following)).where(F.col("_next").isNotNull())
    rows = rows.select(F.col("_next").alias(by), *RANGE, *values, F.explode_outer("_there").alias("_now"))
    return _broken(rows, [by, *RANGE], values)


def ledger_accounted(ledger: DataFrame, consumed: DataFrame, experiments: DataFrame, page: int = PAGE) -> DataFrame:
    """Per entry: ``foreign`` (an exploration read it first), ``unaccounted`` or ``accounted``."""
    known = experiments.select(F.col("exp_id").alias("first_read_by")).distinct().withColumn("_known", F.lit(True))
    spans = consumed.select(F.col("exp_id").alias("first_read_by"), "url", "start_b", "end_b")
    # A range that was consumed as it is logged is used up; only the others need a sweep, and only their gaps meet the rows.
    keys = ["first_read_by", *RANGE]
    apart = cut_lineage(ledger.select(*keys).distinct().join(spans.distinct(), keys, "left_anti"))
    rows, gap = ledger, F.lit(False)
    if not apart.isEmpty():
        left = union_cover(apart, spans, ["first_read_by", "url"], "_used", page=page).where(F.col("_used") != length())
        rows, gap = ledger.join(left.select(*keys, F.lit(True).alias("_gap")), keys, "left"), F.coalesce("_gap", F.lit(False))
    rows = rows.join(known, "first_read_by", "left")
    state = (F.when(F.col("first_read_by") == "exploration", "foreign")
             .when(F.col("_known").isNull() | gap, "unaccounted").otherwise("accounted"))
    return rows.withColumn("state", state).drop("_known", "_gap")


def check_run_data(files: DataFrame, ledger: DataFrame, page: int = PAGE) -> DataFrame:
    """Dataset files of runs against the ledger: ``content_differs``, ``never_logged`` or ``ok``."""
    rows = files.withColumn("_own", packed_hash("sha256")).join(_seen_and_logged(files, ledger, page), list(RANGE))
    state = (F.when(F.col("_logged").isNotNull() & (F.col("_logged") != F.col("_own")), "content_differs")
             .when(F.col("_logged").isNull() & (F.col("unseen") > 0), "never_logged").otherwise("ok"))
    return rows.withColumn("state", state).drop("_logged", "_own", "unseen")


def check_exploration_data(files: DataFrame, ledger: DataFrame, key: str, stamp: str) -> DataFrame:
    """Were all bytes of an exploration's files seen before it began (its stamp plus one second)?"""
    began = F.col(stamp) + F.expr("INTERVAL 1 SECOND")
    rows = bytes_read_before(files.withColumn("_began", began), ledger, "_began", key)
    exact = distinct_entries(ledger).select(*RANGE, F.col("sha256").alias("_logged"))
    rows = rows.join(exact, list(RANGE), "left")
    return (rows.withColumn("seen_before", F.col("read_before") == length())
            .withColumn("content_same", F.coalesce(F.col("_logged") == F.col("sha256"), F.lit(True)))
            .drop("_logged", "_began", "read_before"))


def range_totals(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of ranges and their bytes."""
    return ranges.groupBy(*by).agg(F.count(F.lit(1)).alias("ranges"), F.sum(length()).alias("bytes"))


def unacknowledged(ranges: DataFrame, reserved: DataFrame, acknowledged: DataFrame, page: int = PAGE) -> DataFrame:
    """Experiments whose reserved ranges overlap ``ranges`` without being acknowledged.

    ``ranges`` belong to one new experiment; overlap is tested per reserved
    range by union coverage, so no pairs are formed.
    """
    met = union_cover(reserved, ranges.select("url", "start_b", "end_b"), ["url"], "_shared", page=page)
    names = met.where(F.col("_shared") > 0).select("exp_id").distinct()
    return names.join(acknowledged.select("exp_id").distinct(), "exp_id", "left_anti")


def holdout_families(reserved: DataFrame, page: int = PAGE) -> DataFrame:
    """Experiments judged on overlapping reserved bytes, as ``(family, exp_id)`` with at least two members.

    Overlapping ranges of an object form runs; experiments and runs make a
    bipartite graph whose components are the families. Edges grow with the
    ranges, not with pairs of experiments.
    """
    runs = islands(reserved.select("url", "start_b", "end_b"), ["url"], page=page)
    starts = reserved.select("url", F.col("start_b").alias("at"), "exp_id").distinct()
    marks = runs.select("url", F.col("island").alias("at"), "island")
    places = starts.select("url", "at").distinct().join(marks, ["url", "at"], "left")
    edges = (starts.join(last_known(places, ["url"], "at", "island", page), ["url", "at"])
             .select(F.concat(F.lit("e:"), "exp_id").alias("a"),
                     F.concat(F.lit("r:"), "url", F.lit("#"), F.col("island")).alias("b")).distinct())
    component = connected_components(edges)
    members = (component.where(F.col("node").startswith("e:"))
               .select(F.expr("substring(node, 3)").alias("exp_id"), "component"))
    families = members.groupBy("component").agg(F.min("exp_id").alias("family"), F.count(F.lit(1)).alias("_n"))
    return members.join(families.where(F.col("_n") > 1), "component").select("family", "exp_id")


def last_known(df: DataFrame, by: Sequence[str], at: str, value: str, page: int, fan: int = FAN) -> DataFrame:
    """Fill ``value`` with the last non-null one at or before ``at`` (as-of): within pages, and up and down the page tree."""
    by = list(by)
    rows = df.withColumn("_page", page_of(F.col(at), page))
    latest = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("at"), F.col(value).alias("value"))))
    pages = carries(rows.groupBy(*by, "_page").agg(latest.alias("_carry")), by, tree_levels(page, fan), latest=["_carry"],
                    node="_page", fan=fan)
    inside = Window.partitionBy(*by, "_page").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return (rows.join(pages, [*by, "_page"])
            .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_carry.value")))
            .drop("_page", "_carry"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, as ``(node, component)`` with the smallest node as name.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): a
    logarithmic number of joins, no neighbour list, checkpointed every round.
    """
    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    previous = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(lowest.select("u", F.col("m").alias("v"))))
        pairs = cut_lineage(small.where("u <> v").distinct())
        state = pairs.agg(F.count(F.lit(1)).alias("n"),
                          F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if previous == state:
            break
        previous = state
    return nodes.join(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left") \
        .select("node", F.coalesce("component", "node").alias("component"))
