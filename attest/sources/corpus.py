"""Record documents and files as tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_corrupt_record"


def read_documents(spark: SparkSession, glob: str, schema: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Documents that parse, with their file, and the unreadable ones as rows; one bad file never stops the scan."""
    texts = spark.read.text(glob, wholetext=multi_line).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    rows = texts.withColumn("_doc", F.from_json("content", f"{schema}, {BAD} string", options))
    broken = F.col("_doc").isNull() | F.col(f"_doc.{BAD}").isNotNull()
    return rows.where(~broken).select("_doc.*", "file").drop(BAD), rows.where(broken).select("file", "content")


def read_corpus(spark: SparkSession, globs: Mapping[str, tuple[str, str]], multi_line: bool = True) -> dict[str, DataFrame]:
    """Named document kinds (glob, schema) -> tables, plus ``unreadable`` with the kind of every bad document."""
    out: dict[str, DataFrame] = {}
    bad: DataFrame | None = None
    for kind, (glob, schema) in globs.items():
        out[kind], broken = read_documents(spark, glob, schema, multi_line)
        broken = broken.withColumn("kind", F.lit(kind))
        bad = broken if bad is None else bad.unionByName(broken)
    if bad is not None:
        out["unreadable"] = bad
    return out


TEST = "struct<fwd_score:double,fwd_lag:int,fwd_p:double,fwd_adj_p:double,rev_score:double,rev_lag:int,rev_adj_p:double,max_lag:int,seed:bigint>"


def flatten_report(reports: DataFrame, key: str = "run_id") -> DataFrame:
    """Nested study reports -> long tests.

    A report has ``windows array<struct<window_id, record, segment, freq_hz,
    arms map<arm,test>, mismatched struct<partner, arms map<arm,test>>>>`` and
    ``synthetic map<arm, map<kind, array<test>>>``.
    """
    windows = reports.select(key, F.explode("windows").alias("w"))
    head = [key, F.col("w.window_id").alias("window_id"), F.col("w.record").alias("record"), F.col("w.segment").alias("segment"),
            F.col("w.freq_hz").alias("freq_hz")]
    real = windows.select(*head, F.lit("real").alias("kind"), F.lit(None).cast("string").alias("partner"), F.explode("w.arms").alias("arm", "t"))
    other = windows.where("w.mismatched IS NOT NULL").select(
        *head, F.lit("mismatched").alias("kind"), F.col("w.mismatched.partner").cast("string").alias("partner"),
        F.explode("w.mismatched.arms").alias("arm", "t"))
    kinds = dict(real.dtypes)
    controls = reports.select(key, F.explode("synthetic").alias("arm", "k")).select(key, "arm", F.explode("k").alias("kind", "l")) \
        .select(key, "arm", "kind", F.posexplode("l").alias("trial", "t"))
    control = controls.select(key, F.col("trial").cast(kinds["window_id"]).alias("window_id"), F.lit(None).cast(kinds["record"]).alias("record"),
                              F.lit(None).cast(kinds["segment"]).alias("segment"), F.lit(None).cast("double").alias("freq_hz"), "kind",
                              F.lit(None).cast("string").alias("partner"), "arm", "t")
    both = real.unionByName(other).unionByName(control)
    return both.select(key, "kind", "window_id", "record", "segment", "partner", "freq_hz", "arm", "t.*")


def file_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Path, size and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("uri"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
