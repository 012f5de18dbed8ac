"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.session import shared_folder

#: Words are runs of anything but these bytes.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that are worked on at a time in numpy; a larger text is worked on alone.
SLICE_BYTES = 2 << 20
#: The same where numpy holds about 50 bytes for each byte of text: what a worker holds counts beside the JVM's heap.
WIDE_SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder; what is written there goes when the session's JVM ends."""
    folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and a lost executor costs nothing."""
    folder = scratch(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, computed once per row however often ``body`` refers to it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


# ---- words of whole Arrow batches in numpy -------------------------------------------------------

_rng = np.random.default_rng(20240229)
_POSITIONS = 256
#: A random value for each (position in the word modulo 256, byte); blanks count nothing.
_TABLE = _rng.integers(0, 2**64, size=(_POSITIONS, 256), dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_TABLE[:, _IS_SPACE] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z only


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch on end, and where each text starts; null texts are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of the column's text, or of one row."""
    for batch in batches:
        _, ends = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def hash_words(column: pa.Array, prefixes: tuple[int, ...] = (),
               separators: np.ndarray = _IS_SPACE) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the lower-cased words of a batch, in order, and the bounds of each text's words.

    ``prefixes`` adds one array per length: hashes of the words' first so many bytes. ``separators`` says which bytes
    belong to no word.
    Bytes are summed from a table indexed by position, so equal words hash alike wherever they stand.
    """
    data, offsets = text_bytes(column)
    if not len(data):
        return [np.zeros(0, dtype=np.uint64) for _ in range(1 + len(prefixes))], np.zeros(len(offsets), dtype=np.int64)
    data = _LOWER[data]
    blank = separators[data]
    inside = ~blank
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = inside[edges]  # a text starts a word of its own
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in range(1 + len(prefixes))], bounds
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    values = _TABLE[place & (_POSITIONS - 1), data[starts[0]:]]
    if separators is not _IS_SPACE:
        values[blank[starts[0]:]] = 0
    at = starts - starts[0]
    out = [mix(np.add.reduceat(values, at))]
    for n in prefixes:
        out.append(mix(np.add.reduceat(np.where(place < n, values, np.uint64(0)), at) + np.uint64(n)))
    return out, bounds
