"""Ledger tables from JSON documents, and the stable-order sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from attest.operators.coverage import LEDGER
from attest.operators.rows import ledger_rules, validate

ENTRY = ("struct<url:string,byte_range:array<bigint>,sha256:string,first_read_at:string,first_read_by:string,note:string>")
DOCUMENT = f"schema string, entries array<{ENTRY}>, _corrupt_record string"
EMPTY = "url string, start_b bigint, end_b bigint, sha256 string, first_read_at timestamp_ntz, first_read_by string, note string"


def raw_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of every ledger document under ``path`` with their index; nothing is rejected here."""
    docs = (spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    return docs.select(F.col("_metadata.file_path").alias("file"), F.posexplode("entries").alias("index", "e")).select(
        "file", "index", "e.url", F.get("e.byte_range", F.lit(0)).alias("start_b"), F.get("e.byte_range", F.lit(1)).alias("end_b"),
        F.size("e.byte_range").alias("bounds"), "e.sha256", "e.first_read_at", "e.first_read_by", "e.note")


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed entries, and every problem of the others named by entry index. A missing file is an empty ledger."""
    try:
        raw = raw_entries(spark, path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        empty = spark.createDataFrame([], EMPTY)
        return empty, spark.createDataFrame([], "file string, index int, rule string, message string")
    rules = [*ledger_rules(), ("bounds", F.coalesce(F.col("bounds") == 2, F.lit(False)), "byte_range needs two bounds")]
    problems = validate(raw, rules, ["file", "index"])
    # A rule is about its own row, so the well-formed ones are known where they are read.
    good = raw.where(reduce(Column.__and__, [F.coalesce(ok, F.lit(False)) for _, ok, _ in rules]))
    moment = F.to_timestamp("first_read_at").cast("timestamp_ntz")
    return good.select("url", "start_b", "end_b", "sha256", moment.alias("first_read_at"), "first_read_by", "note"), problems


def write_ledger(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write in the stable order (first_read_at, url, start_b): range-partitioned, so any size stays sorted across files."""
    order = ["first_read_at", "url", "start_b", "end_b"]
    columns = [c for c in (*LEDGER, "note") if c in ledger.columns]
    ledger.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)
