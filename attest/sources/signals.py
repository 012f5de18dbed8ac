"""Waveform files (16-bit and packed 12-bit samples with a text header) as long sample tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.functions.batches import in_pieces

GAIN = r"^([-+0-9.eE]+)?(?:\((-?\d+)\))?(?:/(\S+))?$"
CHUNK_FRAMES = 1 << 16


def parse_headers(texts: DataFrame, text: str = "text") -> DataFrame:
    """Header text -> one row per record and channel, with a ``problem`` where the record cannot be decoded.

    Comment and blank lines are skipped. Gain 0 or absent means 200, a missing
    baseline falls back to the ADC zero, units default to mV, and only
    single-file records in format 16 or 212 are accepted.
    """
    lines = F.filter(F.split(text, r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    head = F.split(F.trim(F.get("_lines", F.lit(0))), r"\s+")
    rows = (texts.withColumn("_lines", lines).withColumn("_head", head)
            .withColumn("record", F.get("_head", F.lit(0))).withColumn("n_signals", F.get("_head", F.lit(1)).cast("int"))
            .withColumn("fs", F.split(F.get("_head", F.lit(2)), "/")[0].cast("double"))
            .withColumn("n_samples", F.get("_head", F.lit(3)).cast("bigint")))
    specs = rows.select("record", "n_signals", "fs", "n_samples", F.posexplode(F.slice("_lines", F.lit(2), F.col("n_signals"))).alias("channel", "_line"))
    f = F.split(F.trim("_line"), r"\s+")
    gain = F.get(f, F.lit(2))
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(gain, GAIN, i), F.lit(""))
    scale = F.coalesce(F.nullif(part(1).cast("double"), F.lit(0.0)), F.lit(200.0))
    zero = F.coalesce(F.get(f, F.lit(4)).cast("bigint"), F.lit(0))
    named = F.when(F.size(f) > 8, F.array_join(F.slice(f, 9, 100), " ")).otherwise(F.concat(F.lit("signal"), "channel"))
    out = specs.select("record", "channel", "n_signals", "fs", "n_samples", named.alias("name"), F.get(f, F.lit(0)).alias("file"),
                       F.get(f, F.lit(1)).alias("fmt"), scale.alias("gain"), F.coalesce(part(2).cast("bigint"), zero).alias("baseline"),
                       F.coalesce(part(3), F.lit("mV")).alias("units"), gain.rlike(GAIN).alias("_ok"))
    whole = Window.partitionBy("record")  # a record's channels
    known, gains = F.every(F.col("fmt").isin("16", "212")).over(whole), F.every("_ok").over(whole)
    kinds = F.size(F.collect_set(F.when(F.col("fmt").isNotNull() & F.col("file").isNotNull(), F.struct("fmt", "file"))).over(whole))
    problem = (F.when(~gains, "unreadable gain field")
               .when((kinds != 1) | ~known, "only single-file format 16 or 212 is supported"))
    return (out.withColumn("problem", problem).drop("_ok")
            .withColumn("bytes_per_sample", F.when(F.col("fmt") == "16", 2.0).otherwise(1.5)))


def _unpack(raw: bytes | memoryview, fmt: str) -> np.ndarray:
    if fmt == "16":
        return np.frombuffer(raw[:len(raw) // 2 * 2], dtype="<i2").astype(np.int64)
    triples = np.frombuffer(raw[:len(raw) // 3 * 3], dtype=np.uint8).reshape(-1, 3).astype(np.int64)
    low = triples[:, 0] + 256 * (triples[:, 1] % 16)
    high = triples[:, 2] + 256 * (triples[:, 1] // 16)
    pairs = np.stack([low, high], axis=1).ravel()
    return pairs - 4096 * (pairs > 2047)  # twelve-bit two's complement


def decode_signals(files: DataFrame, headers: DataFrame, chunk_frames: int = CHUNK_FRAMES) -> DataFrame:
    """(file, content) with parsed headers -> (record, channel, idx, digital, value).

    A file is cut into chunks of whole frames before decoding, so a long
    record is decoded by many tasks. Chunks hold an even number of frames,
    which keeps packed pairs aligned.
    """
    chunk_frames += chunk_frames % 2
    usable = headers.where("problem IS NULL")
    plan = usable.groupBy("record", "file", "fmt", "n_signals", "bytes_per_sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "gain", "baseline"))), lambda c: c["gain"]).alias("gains"),
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "gain", "baseline"))), lambda c: c["baseline"]).alias("baselines"))
    size = (F.col("bytes_per_sample") * F.col("n_signals") * chunk_frames).cast("int")
    joined = files.join(plan, "file").withColumn("_size", size)
    chunks = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("content") / F.col("_size")).cast("int") - 1, F.lit(0)))
    cut = joined.withColumn("_k", F.explode(chunks)).select(
        "record", "fmt", "n_signals", "gains", "baselines", (F.col("_k").cast("bigint") * chunk_frames).alias("first"),
        F.substring("content", F.col("_k") * F.col("_size") + 1, F.col("_size")).alias("content"))
    spread = cut.repartition("record", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = batch.column("content")
            rows = batch.drop_columns(["content"]).to_pylist()
            for row, content in zip(rows, contents):  # a chunk at a time, whatever a batch holds
                n = int(row["n_signals"])
                flat = _unpack(memoryview(content.as_buffer()), row["fmt"])
                frames = flat[:len(flat) // n * n].reshape(-1, n)
                values = (frames - np.array(row["baselines"][:n])) / np.array(row["gains"][:n])
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(row["record"], frames.size), pa.array(np.tile(np.arange(n, dtype=np.int32), len(frames))),
                    pa.array(np.repeat(row["first"] + np.arange(len(frames)), n)), pa.array(frames.ravel()), pa.array(values.ravel())],
                    ["record", "channel", "idx", "digital", "value"])

    return spread.mapInArrow(run, "record string, channel int, idx bigint, digital bigint, value double")


def read_signals(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Samples and headers of every record in a folder of ``.hea`` and ``.dat`` files."""
    texts = spark.read.text(f"{folder}/*.hea", wholetext=True).withColumnRenamed("value", "text")
    headers = parse_headers(texts)
    files = spark.read.format("binaryFile").load(f"{folder}/*.dat").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return decode_signals(files, headers), headers


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<i4")


def code_points(text: Column) -> Column:
    """Text -> array of its characters' code points."""
    @F.pandas_udf("array<int>")
    def points(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield from in_pieces(None if t is None else points_of(t) for t in texts)
    return points(text)


def bytes16(digital: np.ndarray) -> bytes:
    """16-bit integers -> little-endian bytes."""
    return (digital & 0xFFFF).astype("<u2").tobytes()


def bytes212(digital: np.ndarray) -> bytes:
    """An even number of 12-bit integers -> three bytes per pair."""
    low, high = (digital & 0xFFF).reshape(-1, 2).T
    return np.stack([low & 0xFF, (low >> 8) | (high >> 8 << 4), high & 0xFF], axis=1).astype(np.uint8).tobytes()


def _packed(digital: Column, pack: Callable[[np.ndarray], bytes]) -> Column:
    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in batches:
            yield from in_pieces(None if a is None else pack(np.asarray(a, dtype=np.int64)) for a in arrays)
    return packed(digital)


def pack16(digital: Column) -> Column:
    """Array of 16-bit integers -> little-endian bytes."""
    return _packed(digital, bytes16)


def pack212(digital: Column) -> Column:
    """Array of an even number of 12-bit integers -> three bytes per pair."""
    return _packed(digital, bytes212)


def sample_columns(names: Sequence[str]) -> Column:
    """Channel number -> channel name."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col("channel") + 1)
