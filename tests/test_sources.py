import datetime as dt
import hashlib
import json
import random

from pyspark.sql import functions as F

from attest.operators import coverage as cov
from attest.sources import corpus as co
from attest.sources import ledger as ld
from attest.streaming import ledger as st

SHA = "a" * 64
COLUMNS = "url string, start_b long, end_b long, sha256 string, seq long"


def entry(**changes):
    return {"url": "u/x", "byte_range": [0, 9], "sha256": SHA, "first_read_at": "2026-01-01T00:00:00Z", "first_read_by": "E", **changes}


def test_malformed_entries_are_named_by_index(spark, tmp_path):
    bad = [entry(byte_range=[9, 0]), entry(sha256="XYZ"), entry(first_read_at="2026-01-01T00:00:00"), entry(first_read_by=""), {"byte_range": [0, 1]}]
    (tmp_path / "ledger.json").write_text(json.dumps({"schema": "s", "entries": [entry(), *bad]}))
    good, problems = ld.read_ledger(spark, str(tmp_path / "ledger.json"))
    assert [(r.start_b, r.end_b, r.first_read_at) for r in good.collect()] == [(0, 9, dt.datetime(2026, 1, 1))]
    rules = {}
    for r in problems.collect():
        rules.setdefault(r["index"], set()).add(r["rule"])
    assert {i: rules[i] for i in range(1, 5)} == {1: {"byte_range"}, 2: {"sha256"}, 3: {"first_read_at"}, 4: {"first_read_by"}}
    assert {"missing_url", "missing_sha256"} <= rules[5] and 0 not in rules


def test_a_missing_ledger_is_empty(spark, tmp_path):
    good, problems = ld.read_ledger(spark, str(tmp_path / "none.json"))
    assert good.count() == problems.count() == 0


def test_the_sink_keeps_the_stable_order(spark, tmp_path):
    rows = [("b", 5, 9, SHA, dt.datetime(2026, 1, 2), "E"), ("a", 7, 9, SHA, dt.datetime(2026, 1, 2), "E"), ("z", 0, 1, SHA, dt.datetime(2026, 1, 1), "E")]
    ledger = spark.createDataFrame(rows, "url string, start_b long, end_b long, sha256 string, first_read_at timestamp_ntz, first_read_by string")
    ld.write_ledger(ledger, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.first_read_at, r.url) for r in back.collect()) == [(dt.datetime(2026, 1, 1), "z"), (dt.datetime(2026, 1, 2), "a"), (dt.datetime(2026, 1, 2), "b")]


def test_unreadable_documents_do_not_stop_the_scan(spark, tmp_path):
    for i, text in enumerate(['{"run_id": "R1", "status": "passed"}', "{", '{"run_id": "R2"}']):
        (tmp_path / f"{i}.json").write_text(text)
    tables = co.read_corpus(spark, {"runs": (str(tmp_path / "*.json"), "run_id string, status string")})
    assert sorted(r.run_id for r in tables["runs"].collect()) == ["R1", "R2"]
    assert [r.file.rsplit("/", 1)[1] for r in tables["unreadable"].collect()] == ["1.json"]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.bin").write_bytes(b"abc")
    row = co.file_inventory(spark, str(tmp_path)).first()
    assert (row.bytes, row.sha256) == (3, hashlib.sha256(b"abc").hexdigest()) and row.uri.endswith("/d/f.bin")


def test_reports_become_long_tests(spark):
    test = {"fwd_score": .5, "fwd_lag": 2, "fwd_adj_p": .01}
    report = {"run_id": "R", "windows": [{"window_id": 1, "record": "a", "segment": 0, "freq_hz": .2, "arms": {"s": test, "l": test},
                                          "mismatched": {"partner": "b", "arms": {"s": test, "l": test}}},
                                         {"window_id": 2, "record": "b", "segment": 1, "freq_hz": None, "arms": {"s": test, "l": test}}],
              "synthetic": {"s": {"null": [test, test], "positive": [test]}, "l": {"null": [test]}}}
    window = f"struct<window_id:int,record:string,segment:int,freq_hz:double,arms:map<string,{co.TEST}>,mismatched:struct<partner:string,arms:map<string,{co.TEST}>>>"
    schema = f"run_id string, windows array<{window}>, synthetic map<string,map<string,array<{co.TEST}>>>"
    rows = co.flatten_report(spark.createDataFrame([(json.dumps(report),)], "t string").select(F.from_json("t", schema).alias("r")).select("r.*")).collect()
    kinds = [r.kind for r in rows]
    assert (kinds.count("real"), kinds.count("mismatched"), kinds.count("null"), kinds.count("positive")) == (4, 2, 3, 1)
    assert {r.partner for r in rows if r.kind == "mismatched"} == {"b"}


# Streams
def reads(n=120, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        s = rng.randrange(400)
        out.append(("hot" if rng.random() < .7 else "cold", s, s + rng.choice([5, 20, 60]), rng.choice([SHA, "b" * 64]), i))
    return out


def staged(spark, tmp_path, rows, parts):
    """Rows as a file stream of ``parts`` files in order of arrival."""
    folder = tmp_path / "in"
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size:(k + 1) * size], COLUMNS).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_the_stream_logs_what_the_batch_logs(spark, tmp_path):
    rows = reads()
    def stamped(df):
        return df.withColumn("first_read_at", F.lit(None).cast("timestamp_ntz")).withColumn("first_read_by", F.lit("E"))
    base = stamped(spark.createDataFrame([("hot", 0, 49, SHA, -1)], COLUMNS))
    out, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    st.first_reads(stamped(staged(spark, tmp_path, rows, 4)), base, out, state).awaitTermination()
    new, refused = cov.record_reads(base, spark.createDataFrame(rows, COLUMNS))
    got = spark.read.parquet(out).select("url", "start_b", "end_b", "seq").collect()
    assert sorted(got) == sorted(new.select("url", "start_b", "end_b", "seq").collect())
    assert spark.read.parquet(out + "_refused").count() == refused.count()


def test_spans_merge_and_count_what_is_new():
    rng = random.Random(5)
    for _ in range(200):
        starts, ends, known = [], [], set()
        for _ in range(30):
            first = rng.randrange(80)
            last = first + rng.randrange(12)
            new = set(range(first, last + 1)) - known
            assert st.add_span(starts, ends, first, last) == len(new)
            known |= new
            assert {b for s, e in zip(starts, ends) for b in range(s, e + 1)} == known
            assert all(e + 1 < s for e, s in zip(ends, starts[1:]))


def test_the_stream_resumes_from_its_state_over_many_pages(spark, tmp_path):
    """Pages of 16 positions, and a second run on more files: the ledger's table is not read again."""
    rows = reads(160, 7)
    def stamped(df):
        return df.withColumn("first_read_at", F.lit(None).cast("timestamp_ntz")).withColumn("first_read_by", F.lit("E"))
    base = stamped(spark.createDataFrame([("hot", 30, 49, SHA, -1), ("hot", 100, 120, SHA, -1), ("else", 0, 5, SHA, -1)], COLUMNS))
    out, state = str(tmp_path / "ledger"), str(tmp_path / "state")
    for part in (rows[:90], rows[90:]):
        st.first_reads(stamped(staged(spark, tmp_path, part, 3)), base, out, state, page=16).awaitTermination()
        seen = rows[:part[-1][-1] + 1]
        new, refused = cov.record_reads(base, spark.createDataFrame(seen, COLUMNS))
        key = ["url", "start_b", "end_b", "seq"]
        assert sorted(spark.read.parquet(out).select(*key).collect()) == sorted(new.select(*key).collect())
        assert sorted(spark.read.parquet(out + "_refused").select(*key).collect()) == sorted(refused.select(*key).collect())


def test_gate_and_window_quality_stream_like_their_batch(spark, tmp_path):
    rows = reads(60, 3)
    ledger = spark.createDataFrame([(*r[:4], dt.datetime(2026, 1, 1), "E") for r in reads(30, 4)],
                                   "url string, start_b long, end_b long, sha256 string, first_read_at timestamp_ntz, first_read_by string")
    out = str(tmp_path / "gate")
    st.seen_gate(staged(spark, tmp_path, rows, 3), ledger, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"),
                 str(tmp_path / "gate-state")).awaitTermination()
    want = cov.require_seen(spark.createDataFrame(rows, COLUMNS), ledger)
    assert sorted(spark.read.parquet(out).select("seq", "gate").collect()) == sorted(want.select("seq", "gate").collect())

    base = dt.datetime(2026, 1, 1)
    samples = [("r", base + dt.timedelta(seconds=7 * i), float(i) if i % 5 else float("nan")) for i in range(50)]
    df = spark.createDataFrame(samples, "record string, ts timestamp, x double")
    df.repartition(3).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    q = (st.window_quality(stream, "1 minute", "1 hour").writeStream.outputMode("complete").format("memory").queryName("quality")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    def plain(rows):
        return sorted((r.window_start, r.record, r.samples, round(r.invalid_share, 9)) for r in rows)
    assert plain(spark.table("quality").collect()) == plain(st.window_quality(df, "1 minute").collect())


def test_well_formed_entries_are_known_where_they_are_read(spark, tmp_path):
    """No entry moves to be judged; compressed documents are read as others are."""
    import gzip
    entry = {"url": "u", "byte_range": [0, 9], "sha256": "a" * 64, "first_read_at": "2024-01-01T00:00:00+00:00", "first_read_by": "x"}
    document = {"schema": "ledger/v1", "entries": [entry, {**entry, "byte_range": [9, 0]}, {**entry, "byte_range": [0, 1, 2]}, {**entry, "url": None}]}
    (tmp_path / "ledger.json.gz").write_bytes(gzip.compress(json.dumps(document).encode()))
    good, problems = ld.read_ledger(spark, str(tmp_path))
    assert [(r.start_b, r.end_b) for r in good.collect()] == [(0, 9)]
    assert sorted(r["index"] for r in problems.collect()) == [1, 2, 3]
    assert "Join" not in good._jdf.queryExecution().optimizedPlan().toString()


def test_signals_of_odd_texts_follow_their_sql(spark, tmp_path):
    """An empty text is no record, texts of one id are one, and an id may be missing."""
    import duckdb

    from attest.plans.catalogue import ORACLES, QUERIES

    texts = [(1, "abcde"), (2, ""), (3, None), (4, "x"), (4, "yé😀zz"), (5, "uv"), (5, "w"), (None, "no id")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("signal_headers", "signal_decode"):
        got = QUERIES[name](spark, str(tmp_path))
        result = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]}) q")
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, result.fetchall())), name


def test_signal_files_are_made_from_texts_in_pieces(spark):
    """No samples move as arrays, and a worker hands on parts of a batch (an iterator, 204)."""
    from attest.plans import sources as so

    made = so._document_files(spark, "/root/testdata/sf0.001")
    udfs = [line for line in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "ArrowEvalPython" in line]
    assert len(udfs) == 1 and udfs[0].rstrip().endswith(", 204") and [t for _, t in made.dtypes] == ["string", "binary"]


def test_files_of_documents_need_no_folders(spark, tmp_path):
    """A folder for each file cost more than the file; texts of one id, an empty one and several lines keep their own size and hash."""
    import duckdb

    from attest.plans import sources as so
    from attest.plans.catalogue import ORACLES

    texts = [(i, f"text {i}\nline") for i in range(30)] + [(7, "again"), (8, ""), (9, "é😀")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made, plain = [], so.scratch
    so.scratch = lambda spark, name: made.append(plain(spark, name)) or made[-1]
    try:
        got = so.file_inventory(spark, str(tmp_path))
    finally:
        so.scratch = plain
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id, bytes, sha256 FROM ({ORACLES['file_inventory']}) q").fetchall()
    assert sorted(map(tuple, got.select("doc_id", "bytes", "sha256").collect())) == sorted(want)
    from pathlib import Path
    assert not [p for p in Path(made[0].removeprefix("file:")).iterdir() if p.is_dir()]
