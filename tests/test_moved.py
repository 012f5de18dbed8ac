"""What operators move between tasks: wide columns once, hashes in few bytes."""

import re

from pyspark.sql import functions as F

from attest.functions.expressions import packed_hash
from attest.functions.intervals import union_cover
from attest.operators import audit as au
from attest.operators import coverage as cov
from attest.operators import lineage as ln


def moved(df, column):
    """Shuffles of the plan that carry ``column``."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    held = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", text)
    return sum(any(re.match(rf"{column}#", c.strip()) for c in one.split(",")) for one in held)


def spans(spark, rows):
    return spark.createDataFrame(rows, "url string, start_b long, end_b long, payload string, sha256 string")


def test_wide_rows_move_once_for_coverage(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wanted = spans(spark, [("a", 0, 9, "p", "x"), ("a", 0, 9, "q", "y"), ("a", 5, 20, "r", "z"), ("b", 0, 1, "s", "x"), (None, 0, 1, "t", "x")])
        held = spans(spark, [("a", 3, 7, "", ""), ("a", 6, 11, "", "")]).select("url", "start_b", "end_b")
        got = union_cover(wanted, held, ["url"])
        assert moved(got, "payload") == 1
        assert sorted((r.payload, r.covered) for r in got.collect()) == [("p", 7), ("q", 7), ("r", 7), ("s", 0)]
        ledger = spans(spark, [("a", 0, 9, "", "x")]).withColumns({
            "first_read_at": F.lit("2020-01-01").cast("timestamp_ntz"), "first_read_by": F.lit("e")})
        for judged, column, told in ((cov.require_seen(wanted, ledger), "gate", ["ok_exact", "content_changed", "unseen", "unseen"]),
                                     (cov.check_run_data(wanted, ledger), "state", ["ok", "content_differs", "never_logged", "never_logged"])):
            assert moved(judged, "payload") == 1
            assert [r[column] for r in sorted(judged.collect(), key=lambda r: r.payload)] == told
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packed_hashes_tell_texts_apart(spark):
    sha = "ab" * 32
    texts = [sha, sha.upper(), sha[:-1], sha + "0", "", "zz", "«" * 16, "\x00" * 33, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed_hash("t").alias("p")).collect()
    packed = [bytes(r.p) if r.p is not None else None for r in rows]
    assert len(set(packed)) == len(texts) and packed[0] == bytes.fromhex(sha) and packed[-1] is None


def test_artifacts_are_joined_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a shuffle that is used again then shows in the plan
    try:
        sha = "0" * 64
        refs = spark.createDataFrame([("r", "n1", "u1", sha, 1, False), ("r", "n2", "u2", sha, 1, False), ("r", "n3", "u3", sha, 1, True),
                                      ("r", "n4", None, "x", 1, None), ("q", "n5", "u1", "x", 1, False)],
                                     "run_id string, name string, uri string, sha256 string, bytes long, stored boolean")
        found = spark.createDataFrame([("u1", sha, 1)], "uri string, sha256 string, bytes long")
        got = au.artifact_checks(refs.select("run_id").distinct(), refs, found)
        assert moved(got, "_own") == 1 and moved(got, "sha256") == 0
        assert {r.subject: (r.status, r.detail) for r in got.collect()} == {
            "r": ("fail", "n4 missing; u2 missing"), "q": ("fail", "u1 changed")}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_graph_digest_moves_hashes_once(spark):
    """One shuffle up to the lowest nodes; the digest is that of the tree over each hash once."""
    nodes = spark.range(300).select(F.concat(F.lit("n"), "id").alias("id"))
    edges = spark.range(500).select(F.concat(F.lit("n"), F.col("id") % 250).alias("src"), F.lit("to").alias("dst"))
    got = ln.graph_digest(nodes, edges)
    hashes = (nodes.select(F.sha2(F.concat(F.lit("n:"), ln.canonical(nodes, nodes.columns)), 256).alias("hash"))
              .unionByName(edges.distinct().select(F.sha2(F.concat(F.lit("e:"), ln.canonical(edges, edges.columns)), 256).alias("hash"))))
    assert got.first() == ln.tree_digest(hashes).first()
    assert moved(got, "_h") == 1
    assert ln.graph_digest(nodes, edges.repartition(7)).first() == got.first()


def test_every_core_makes_files(spark, tmp_path):
    """One file of documents is one task of the scan; making a file for each must not be one task's work."""
    from pyspark.sql import Row

    from attest.plans.catalogue import QUERIES

    spark.createDataFrame([Row(doc_id=i, text=f"t{i}") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    from attest.plans import sources
    dealt = []
    plain = sources.spread
    sources.spread = lambda df, *keys, **how: dealt.append(plain(df, *keys, **how).rdd.getNumPartitions()) or plain(df, *keys, **how)
    try:
        made = QUERIES["file_inventory"](spark, str(tmp_path))
    finally:
        sources.spread = plain
    assert dealt and dealt[0] > 1
    assert {(r.doc_id, r.bytes) for r in made.collect()} == {(i, len(f"t{i}") + 1) for i in range(40)}


def test_texts_become_signals_once(spark):
    """The files are made once, however often headers and contents are read; both tables of paired series share one pass."""
    from attest.plans.catalogue import QUERIES

    for name in ("signal_decode", "paired_series"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and "ArrowEvalPython" not in plan


def test_code_points_and_packing(spark):
    from attest.sources import signals as src

    rows = spark.createDataFrame([("aé😀",), ("",), (None,)], "t string").select(src.code_points(F.col("t")).alias("c")).collect()
    assert [r.c for r in rows] == [[97, 233, 128512], [], None]
    codes = F.array(*[F.lit(x).cast("long") for x in (-2048, 2047, -1, 5)])
    got = spark.range(1).select(src.pack212(codes).alias("a"), src.pack16(codes).alias("b"), src.pack212(F.expr("array()").cast("array<bigint>")).alias("c")).first()
    assert bytes(got.a) == bytes([0x00, 0x78, 0xFF, 0xFF, 0x0F, 0x05]) and bytes(got.b) == bytes([0, 0xF8, 0xFF, 7, 0xFF, 0xFF, 5, 0])
    assert bytes(got.c) == b""


def test_study_is_tested_once(spark):
    """The measures read tests that are there, not each its own surrogates."""
    from attest.plans.catalogue import QUERIES

    plan = QUERIES["study_measures"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "embeddings.parquet" not in plan and "Python" not in plan and "MapIn" not in plan


def test_compared_files_move_packed(spark):
    from attest.operators import compare as cm

    sha = "0" * 64
    files = spark.createDataFrame([(1, "u", 0, 9, sha), (1, "u", 5, 9, "x"), (2, "u", 0, 9, None)], "run_id long, url string, start_b long, end_b long, sha256 string")
    ledger = spark.createDataFrame([("u", 0, 9, sha, None, "e")], "url string, start_b long, end_b long, sha256 string, first_read_at timestamp_ntz, first_read_by string")
    got = cm.compare_data(files, ledger, files.where("run_id = 1 AND start_b = 0"))
    assert [(r.run_id, r.start_b, r.matches_ledger, r.matches_run) for r in got.orderBy("run_id", "start_b").collect()] == [
        (1, 0, True, True), (1, 5, True, False), (2, 0, None, False)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts = cm.compare_data(files, ledger, files).groupBy("run_id").agg(F.count_if("matches_ledger"), F.count_if("matches_run"))
        assert moved(counts, "sha256") == 0 and moved(counts, "_own") >= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checks_are_not_kept(spark, tmp_path):
    """Counts, levels and claims read all checks in one pass: nothing is written, and checks that tell nothing do not move."""
    import attest.plans.catalogue  # noqa: F401
    from attest.plans import audit as pa

    assert "parquet" in pa.every_check(spark, "/root/testdata/sf0.001", ())._jdf.queryExecution().optimizedPlan().toString()
    rows = [("run.anchor", "r1", "ok", "a"), ("run.published", "r1", "ok", "b"), ("run.code", "r1", "ok", "c"), ("run.code", "r2", "warn", "d"),
            ("run.data", "r2", "fail", "e"), ("holdout.x", "e1", "ok", "f"), ("holdout.x", "e2", "warn", "g"), ("run.anchor", "r3", "ok", "h"),
            ("run.published", "r3", "ok", "i"), ("run.data", "r3", "fail", None)]
    checks = spark.createDataFrame(rows, "name string, subject string, status string, detail string")
    runs = spark.createDataFrame([("r1", "e1", True), ("r2", "e1", True), ("r3", "e2", True), ("r4", "e3", False)], "run_id string, exp_id string, holdout boolean")
    got = au.evidence_levels(checks, runs, "lenient")
    assert {r.run_id: (r.level, r.lenient) for r in got.collect()} == {
        "r1": ("confirmatory", "confirmatory"), "r2": ("unverified", "registered"), "r3": ("unverified", "preregistered"), "r4": ("registered", "registered")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert moved(got, "detail") == 0 and "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
        families = spark.createDataFrame([("e1", "e1")], "family string, exp_id string")
        replays = spark.createDataFrame([("r1", "o")], "run_id string, outcome string")
        novel = spark.createDataFrame([("e1", 2, 1)], "exp_id string, records long, analysed_earlier long")
        told = au.claims(checks, runs, families, replays, novel)
        assert {r.run_id: (r.level, r.broken_links, r.weaker_links, r.family, r.replays) for r in told.collect()} == {
            "r1": ("confirmatory", [], [], "e1", ["o"]), "r2": ("unverified", ["run.data: e"], ["run.code: d"], "e1", []),
            "r3": ("unverified", [], ["holdout.x: g"], None, []), "r4": ("registered", [], [], None, [])}
        assert "ReusedExchange" in told._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_only_nodes_with_edges_are_walked(spark, monkeypatch):
    """What leads nowhere is joined once at the end; cycles, diamonds and edges that are there twice change nothing."""
    pairs = [("v", "r"), ("v", "r"), ("r", "x"), ("x", "r"), ("r", "a"), ("x", "a"), ("x", "y"), ("y", "b"), ("w", "y"), ("y", "y"), *[("r", f"leaf{i}") for i in range(50)]]
    kept = []
    monkeypatch.setattr(ln, "cut_lineage", lambda df: kept.append(df.count()) or df)
    got = ln.ancestors(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("v",), ("w",), ("b",), ("w",)], "id string"))
    assert sorted(map(tuple, got.collect())) == sorted([
        ("v", "v", 0), ("v", "r", 1), ("v", "x", 2), ("v", "a", 2), ("v", "y", 3), ("v", "b", 4), *[("v", f"leaf{i}", 2) for i in range(50)],
        ("w", "w", 0), ("w", "y", 1), ("w", "b", 2), ("b", "b", 0)])
    assert max(kept) < 10


def test_no_version_is_one_task(spark):
    """Versions are told their successor where they are: no shuffle is dealt by the version's number alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        day = F.lit("2020-01-01").cast("timestamp_ntz")
        rows = [(1, "d/a", 0, 9, "x", "e"), (1, "d/b", 0, 9, "x", "e"), (4, "d/a", 0, 9, "y", "e"), (6, "d/a", 0, 9, "y", "f"), (6, "d/c", 0, 9, None, "f")]
        versions = spark.createDataFrame(rows, "seq long, url string, start_b long, end_b long, sha256 string, first_read_by string").withColumn("first_read_at", day)
        got = cov.history_extends(versions)
        # The only shuffle by the number alone is that of the distinct numbers.
        assert [line.count("first_read_by") for line in shuffled_by(got, "seq")] == [0]
        assert sorted((r.seq, r.problem) for r in got.collect()) == [(4, "a [0, 9]: sha256 changed"), (4, "b [0, 9]: entry removed"), (6, "a [0, 9]: first_read_by changed")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffled_by(df, column):
    """Inputs of the plan's shuffles that are dealt by ``column`` alone."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(rf"\(\d+\) Exchange\nInput \[\d+\]: (\[.*?\])\nArguments: hashpartitioning\({column}#\d+L?, \d+\)", text)


def test_versions_of_a_ledger_come_from_one_pass(spark):
    """Entries are merged once for all versions, and a version meets the next where they lie."""
    from attest.plans.catalogue import QUERIES

    # Once for the rows and once for the versions' numbers, which share the shuffle when it runs.
    assert moved(QUERIES["ledger_history"](spark, "/root/testdata/sf0.001"), "start_b") <= 2


def test_versions_meet_as_in_a_join(spark):
    """Entries that are there twice, numbers with gaps, hashes that are none, and ranges that come back."""
    from functools import reduce

    rows = [(1, "u/a", 0, 9, "x", 1, "E"), (1, "u/a", 0, 9, "y", 1, "E"), (1, "u/b", 0, 9, "0" * 64, 1, "E"), (4, "u/a", 0, 9, "x", 1, "E"),
            (4, "u/b", 0, 9, "0" * 64, 1, None), (6, "u/b", 0, 9, "0" * 64, 2, "F"), (6, "u/a", 0, 9, "x", 1, "E"), (6, "u/a", 0, 9, "z", 3, "E"),
            (9, "u/c", 0, 9, "x", 1, "E")]
    versions = spark.createDataFrame(rows, "seq int, url string, start_b long, end_b long, sha256 string, first_read_at long, first_read_by string")
    steps = [cov.extends(versions.where(f"seq = {a}").drop("seq"), versions.where(f"seq = {b}").drop("seq")).withColumn("seq", F.lit(b))
             for a, b in ((1, 4), (4, 6), (6, 9))]
    want = reduce(lambda a, b: a.unionByName(b), steps).select("seq", "url", "problem")
    got = cov.history_extends(versions).select("seq", "url", "problem")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5


def test_consumed_as_logged_needs_no_sweep(spark):
    names = "first_read_by string, url string, start_b long, end_b long"
    ledger = spark.createDataFrame([("E", "a", 0, 9), ("E", "a", 5, 20), ("E", "b", 0, 1), ("exploration", "b", 0, 1), ("F", "b", 0, 1)], names)
    known = spark.createDataFrame([("E",)], "exp_id string")
    exact = cov.ledger_accounted(ledger, ledger.withColumnRenamed("first_read_by", "exp_id"), known)
    assert "Window" not in exact._jdf.queryExecution().optimizedPlan().toString()
    state = lambda df: sorted((r.first_read_by, r.url, r.start_b, r.state) for r in df.collect())
    other = [("exploration", "b", 0, "foreign")]
    assert state(exact) == sorted([("E", "a", 0, "accounted"), ("E", "a", 5, "accounted"), ("E", "b", 0, "accounted"), ("F", "b", 0, "unaccounted"), *other])
    some = spark.createDataFrame([("E", "a", 0, 15), ("E", "b", 0, 1), ("F", "b", 0, 1)], names.replace("first_read_by", "exp_id"))
    assert state(cov.ledger_accounted(ledger, some, known)) == sorted(
        [("E", "a", 0, "accounted"), ("E", "a", 5, "unaccounted"), ("E", "b", 0, "accounted"), ("F", "b", 0, "unaccounted"), *other])


def test_nodes_of_the_digest_do_not_move_to_their_parents(spark):
    hashes = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    got = ln.set_digest(hashes.union(hashes))
    assert got.first() == ln.tree_digest(hashes).first() and moved(got, "_h") == 1
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first() == ln.set_digest(hashes.repartition(3)).first() and "RepartitionByExpression [_q" in text
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 2  # the hashes, and the 4,096 nodes below the root


def test_artifacts_move_without_their_labels(spark):
    from attest.plans.catalogue import QUERIES

    checks = QUERIES["run_artifact_checks"](spark, "/root/testdata/sf0.001")
    assert moved(checks, "_label") == 0 and moved(checks, "sha256") == 0
