import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attest.functions.intervals import (border_ranks, carries, covered_before, islands, sweep, tree_levels,
                                        union_cover)
from attest.operators import coverage as cov

SHA = "a" * 64
LEDGER = "url string, start_b long, end_b long, sha256 string, first_read_at timestamp_ntz, first_read_by string"


def day(month, number=1):
    return dt.datetime(2026, month, number)


@pytest.fixture(scope="module")
def ledger(spark):
    return spark.createDataFrame([("u", 100, 199, SHA, day(1), "E"), ("u", 150, 299, SHA, day(3), "E")], LEDGER)


def asked(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "req_id int, url string, start_b long, end_b long")


def test_unseen_counts_overlaps_once(spark, ledger):
    rows = cov.bytes_unseen(asked(spark, [("u", 100, 299), ("u", 0, 399), ("other", 0, 9)]), ledger).collect()
    assert {r.req_id: r.unseen for r in rows} == {0: 0, 1: 200, 2: 10}


def test_read_before_is_strict(spark, ledger):
    moments = [dt.datetime(2025, 12, 31), day(2), day(4), day(3)]
    req = spark.createDataFrame([(i, "u", 100, 299, m) for i, m in enumerate(moments)],
                                "req_id int, url string, start_b long, end_b long, moment timestamp_ntz")
    got = {r.req_id: r.read_before for r in cov.bytes_read_before(req, ledger, "moment").collect()}
    assert got == {0: 0, 1: 100, 2: 200, 3: 100}


def cases(seed, n=60, m=25, width=400):
    rng = random.Random(seed)
    spans = [("hot" if rng.random() < .7 else "cold", s := rng.randrange(width), s + rng.randrange(60), rng.randrange(9)) for _ in range(n)]
    asks = [(i, rng.choice(["hot", "cold", "none"]), s := rng.randrange(width), s + rng.randrange(120), rng.randrange(10)) for i in range(m)]
    return spans, asks


@pytest.mark.parametrize("seed, page", [(1, 8), (2, 64), (3, 1 << 12)])
def test_sweep_and_map_match_brute_force(spark, seed, page):
    spans, asks = cases(seed)
    s = spark.createDataFrame(spans, "url string, start_b long, end_b long, m long")
    a = spark.createDataFrame(asks, "id int, url string, start_b long, end_b long, t long")
    bytes_of = {i: [b for b in range(lo, hi + 1)] for i, _, lo, hi, _ in asks}
    union = {r.id: r.covered for r in union_cover(a, s, ["url"], page=page).collect()}
    early = {r.id: r.covered for r in
             covered_before(a, s, ["id"], ["url"], "t", "m", page=page, block=4 * page).collect()}
    for i, url, _, _, t in asks:
        mine = [x for x in spans if x[0] == url]
        assert union[i] == sum(any(lo <= b <= hi for _, lo, hi, _ in mine) for b in bytes_of[i])
        assert early[i] == sum(any(lo <= b <= hi and m < t for _, lo, hi, m in mine) for b in bytes_of[i])


def test_a_terabyte_range_costs_a_handful_of_rows(spark):
    tb = 1 << 40
    s = spark.createDataFrame([("u", 0, tb - 1, 3), ("u", tb // 2, 2 * tb, 1)], "url string, start_b long, end_b long, m long")
    a = spark.createDataFrame([(1, "u", 5, 3 * tb, 2), (2, "u", 5, 3 * tb, 9)], "id int, url string, start_b long, end_b long, t long")
    assert border_ranks([a, s], ["url"]).count() == 6
    got = {r.id: r.covered for r in covered_before(a, s, ["id"], ["url"], "t", "m").collect()}
    assert got == {1: 3 * tb // 2 + 1, 2: 2 * tb - 4}


@pytest.mark.parametrize("seed", [4, 5])
def test_a_tree_of_pages_equals_one_page(spark, seed):
    """Pages of 4 positions with 4 children a node: the positions need four levels and more."""
    spans, asks = cases(seed, n=50, m=20, width=900)
    s = spark.createDataFrame(spans, "url string, start_b long, end_b long, m long")
    a = spark.createDataFrame(asks, "id int, url string, start_b long, end_b long, t long")
    points = a.selectExpr("url", "start_b AS at")
    flat, tree = (sorted(map(tuple, sweep(s, points, ["url"], page=page, fan=fan, levels=levels).collect()))
                  for page, fan, levels in ((1 << 20, 1 << 15, 1), (4, 4, 5)))
    assert flat == tree and len(flat) > 60
    mine = [x for x in spans if x[0] == "hot"]
    for url, at, below, mass, opened, closed in flat:
        if url == "hot":
            assert below == len({b for _, lo, hi, _ in mine for b in range(lo, min(hi, at - 1) + 1)})
            assert mass == sum(max(0, min(hi, at - 1) - lo + 1) for _, lo, hi, _ in mine)
            assert (opened, closed) == (sum(lo < at for _, lo, _, _ in mine), sum(hi < at for _, _, hi, _ in mine))
    assert sorted(islands(s, ["url"], page=8, fan=1 << 10).collect()) == sorted(islands(s, ["url"]).collect())


def test_carries_hand_sums_and_latest_values_down(spark):
    rows = [("u", p, p * p % 7, None if p % 3 else p) for p in (0, 1, 5, 6, 7, 40, 41, 999)] + [("v", 5, 3, 5)]
    nodes = spark.createDataFrame(rows, "url string, page long, n long, last long")
    for fan, levels in ((2, 10), (4, 5), (1 << 15, 1)):
        got = {(r.url, r.page): (r.n, r.last) for r in carries(nodes, ["url"], levels, ["n"], ["last"], fan=fan).collect()}
        for url, page, _, _ in rows:
            before = [r for r in rows if r[0] == url and r[1] < page]
            assert got[url, page] == (sum(r[2] for r in before), max((r[3] for r in before if r[3] is not None), default=None))
    assert tree_levels(1 << 18) == 3 and tree_levels(4, 4) == 31


def test_touching_spans_are_separate_islands(spark):
    s = spark.createDataFrame([("u", 0, 9), ("u", 10, 19), ("u", 15, 40), ("u", 41, 41)], "url string, start_b long, end_b long")
    assert sorted(r.island for r in islands(s, ["url"], page=16).collect()) == [0, 10, 41]


def fold(ledger, reads):
    """The batch read one by one."""
    entries, out = list(ledger), {}
    for seq, url, lo, hi, sha in reads:
        exact = next((e for e in entries if e[:3] == (url, lo, hi)), None)
        covered = all(any(e[0] == url and e[1] <= b <= e[2] for e in entries) for b in range(lo, hi + 1))
        if exact is not None:
            out[seq] = "known" if exact[3] == sha else "content_changed"
        elif covered:
            out[seq] = "covered"
        else:
            out[seq] = "appended"
            entries.append((url, lo, hi, sha))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_batch_of_reads_equals_reading_one_by_one(spark, seed):
    rng = random.Random(seed)
    known = list({("u", s := rng.randrange(80), s + rng.randrange(20)): None for _ in range(5)})
    known = [(*k, SHA) for k in known]
    reads = [(i, "u" if rng.random() < .8 else "v", s := rng.randrange(60), s + rng.choice([3, 7, 20]), rng.choice([SHA, "b" * 64])) for i in range(40)]
    reads += [(40 + i, *rng.choice(reads)[1:4], rng.choice([SHA, "b" * 64])) for i in range(15)]
    base = spark.createDataFrame([(*k, day(1), "E") for k in known], LEDGER)
    batch = spark.createDataFrame(reads, "seq long, url string, start_b long, end_b long, sha256 string")
    got = {r.seq: r.outcome for r in cov.judge_reads(base, batch, page=16).collect()}
    assert got == fold(known, reads)


def test_seen_gate(spark, ledger):
    reads = spark.createDataFrame([(0, "u", 100, 199, SHA), (1, "u", 100, 199, "b" * 64), (2, "u", 120, 280, SHA), (3, "u", 0, 120, SHA)],
                                  "id int, url string, start_b long, end_b long, sha256 string")
    got = {r.id: r.gate for r in cov.require_seen(reads, ledger).collect()}
    assert got == {0: "ok_exact", 1: "content_changed", 2: "ok_covered", 3: "unseen"}


def test_history_may_only_grow(spark, ledger):
    assert cov.extends(ledger, ledger.unionByName(ledger.withColumn("url", F.lit("w")))).count() == 0
    changed = ledger.withColumn("first_read_at", F.when(F.col("start_b") == 100, F.lit(day(2)).cast("timestamp_ntz")).otherwise(F.col("first_read_at")))
    assert [r.problem for r in cov.extends(ledger, changed).collect()] == ["u [100, 199]: first_read_at changed"]
    lost = ledger.where("start_b = 100")
    assert [r.problem for r in cov.extends(ledger, lost).collect()] == ["u [150, 299]: entry removed"]


def test_families_join_through_chains(spark):
    reserved = spark.createDataFrame([("A", "u", 0, 9), ("B", "u", 5, 19), ("C", "u", 19, 30), ("D", "u", 31, 40), ("E", "v", 0, 3), ("F", "v", 2, 9),
                                      ("F", "w", 0, 5), ("G", "w", 5, 6)], "exp_id string, url string, start_b long, end_b long")
    got = {}
    for r in cov.holdout_families(reserved, page=8).collect():
        got.setdefault(r.family, set()).add(r.exp_id)
    assert got == {"A": {"A", "B", "C"}, "E": {"E", "F", "G"}}


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(30)]
    got = {}
    for r in cov.connected_components(spark.createDataFrame(chain + star, "a string, b string")).collect():
        got.setdefault(r.component, []).append(r.node)
    assert {k: len(x) for k, x in got.items()} == {"c000": 61, "hub": 31}


def test_accounting_and_exploration(spark, ledger):
    rows = ledger.withColumn("first_read_by", F.when(F.col("start_b") == 100, "exploration").otherwise("E"))
    used = spark.createDataFrame([("E", "u", 150, 250), ("E", "u", 251, 299)], "exp_id string, url string, start_b long, end_b long")
    known = spark.createDataFrame([("E",)], "exp_id string")
    assert {r.start_b: r.state for r in cov.ledger_accounted(rows, used, known).collect()} == {100: "foreign", 150: "accounted"}
    files = spark.createDataFrame([(0, "u", 100, 199, SHA, day(1)), (1, "u", 150, 299, "b" * 64, day(3, 2)), (2, "u", 200, 299, SHA, day(2))],
                                  "id int, url string, start_b long, end_b long, sha256 string, stamp timestamp_ntz")
    got = {r.id: (r.seen_before, r.content_same) for r in cov.check_exploration_data(files, ledger, "id", "stamp").collect()}
    assert got == {0: (True, True), 1: (True, False), 2: (False, True)}
