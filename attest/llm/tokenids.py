"""Token ids in files of range asymmetric numeral system (rANS) blocks with one shared, static frequency table.

A folder holds ``table`` (id, freq: frequencies that sum to ``2**SCALE``) and ``blocks``, Parquet rows in order of the
ids' positions. A block is a byte string that can be read by itself: interleaved lanes (id i of the block belongs to
lane i modulo the number of lanes) share one stream of 32-bit words, and at every checkpoint the lanes' states and the
place in the stream are kept, so that any run of checkpoints can be decoded alone. A checksum covers the bytes, another
the ids; a run also has to end in the states of the next checkpoint. Beside the bytes stand the documents that reach into the block.

Documents are sorted by range, tokenised where they then stand, and positions come from one total per partition.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.llm.common import scratch, sliced, text_bytes, written

#: Frequencies sum to 2**SCALE; a state lies in [2**31, 2**63) and gives off 32 bits at a time.
SCALE, LOW = 20, np.uint64(1 << 31)
BLOCK, LANES, EVERY = 1 << 19, 1024, 256
MAGIC = b"rANS\x01"
_HEAD = struct.Struct("<5sIIIIII")  # magic, ids, lanes, steps between checkpoints, checkpoints, words, checksum of ids
#: Chunks whose ids a worker keeps at most, and the longest that it keeps.
KEPT_CHUNKS, KEPT_LENGTH = 1_200_000, 40

_ID = np.dtype("<u4")
#: How byte-level tokenizers write bytes: printable Latin-1 characters stand for themselves, the others follow from U+0100 on.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PLAIN]
_BYTE_LEVEL = [chr(b) if b in _PLAIN else chr(0x100 + _OTHERS.index(b)) for b in range(256)]
_S, _32, _MASK = np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)


# ---- the code ------------------------------------------------------------------------------------


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2**SCALE``, in proportion to ``counts`` and at least 1 for what occurs."""
    counts = np.asarray(counts, dtype=np.int64)
    seen, whole = counts > 0, 1 << SCALE
    if seen.sum() > whole:
        raise ValueError(f"more than {whole} different ids")
    freq = np.where(seen, 1, 0)
    if not seen.any():
        return freq
    share = counts / counts.sum() * (whole - seen.sum())
    freq += share.astype(np.int64)
    most_lost = np.argsort(-(share - np.floor(share)), kind="stable")
    freq[most_lost[:whole - freq.sum()]] += 1
    return freq


class Table:
    """Frequencies by id, their sums below each id, and the id that owns each of the ``2**SCALE`` slots."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.below = np.cumsum(self.freq) - self.freq
        self.owner = np.repeat(np.arange(len(freq), dtype=_ID), freq)


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One block of at least one id. Steps run from the last to the first, so that decoding runs forward."""
    n, index = len(ids), ids.astype(np.intp)
    lanes = max(1, min(lanes, n // 64))
    state = np.full(lanes, LOW, dtype=np.uint64)
    if not table.freq[index].all():
        raise ValueError("an id has no frequency in the shared table")
    words: list[np.ndarray] = []
    marks: list[tuple[np.ndarray, int]] = []
    given = 0
    for step in range((n - 1) // lanes, -1, -1):
        part = index[step * lanes:(step + 1) * lanes]
        freq, x = table.freq[part], state[:len(part)]
        full = x >= freq << np.uint64(31 - SCALE + 32)
        words.append((x[full] & _MASK).astype(_ID))
        given += len(words[-1])
        x = np.where(full, x >> _32, x)
        whole = x // freq
        state[:len(part)] = (whole << _S) + (x - whole * freq) + table.below[part]
        if step % every == 0:
            marks.append((state.copy(), given))
    marks.reverse()
    body = b"".join([np.array([given - g for _, g in marks], dtype=_ID).tobytes(),
                     *(s.astype("<u8").tobytes() for s, _ in marks), *(w.tobytes() for w in reversed(words))])
    head = _HEAD.pack(MAGIC, n, lanes, every, len(marks), given, zlib.crc32(ids.astype(_ID).tobytes()))
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


def decode(block: bytes, table: Table, part: int = 0, parts: int = 1) -> tuple[int, np.ndarray]:
    """Where in the block the ids begin, and the ids, of the ``part``-th of ``parts`` runs of checkpoints.

    Raises ValueError for bytes that are not what was written.
    """
    if len(block) < _HEAD.size + 4 or block[:5] != MAGIC or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("not a block of ids, or a damaged one")
    _, n, lanes, every, marks, given, check = _HEAD.unpack_from(block)
    at = _HEAD.size
    places = np.frombuffer(block, _ID, marks, at)
    states = np.frombuffer(block, "<u8", marks * lanes, at + 4 * marks).reshape(marks, lanes)
    words = np.frombuffer(block, _ID, given, at + 4 * marks + 8 * marks * lanes)
    first, last = marks * part // parts, marks * (part + 1) // parts
    begin, end = min(n, first * every * lanes), min(n, last * every * lanes)
    out = np.zeros(end - begin, dtype=_ID)
    if begin == end:
        return begin, out
    state, place = states[first].astype(np.uint64), int(places[first])
    for low in range(begin, end, lanes):
        k = min(lanes, n - low)
        slot = state[:k] & np.uint64((1 << SCALE) - 1)
        ids = table.owner[slot.astype(np.intp)].astype(np.intp)
        x = table.freq[ids] * (state[:k] >> _S) + slot - table.below[ids]
        short = np.flatnonzero(x < LOW)
        x[short] = x[short] << _32 | words[place:place + len(short)].astype(np.uint64)
        place += len(short)
        state[:k] = x
        out[low - begin:low - begin + k] = ids
    if not np.array_equal(state, states[last] if last < marks else np.full(lanes, LOW)) or (
            parts == 1 and zlib.crc32(out.tobytes()) != check):
        raise ValueError("the ids of a block do not agree with its checkpoints")
    return begin, out


def _product(a: int, b: int) -> int:
    """Of two polynomials modulo the one of CRC-32; bit 31 is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings on end, from the (checksum, bytes) of each."""
    crc = 0
    for part, n in parts:
        shift, power = 1 << 31, 1 << 23  # 1 and x**8
        while n:
            if n & 1:
                shift = _product(shift, power)
            power, n = _product(power, power), n >> 1
        crc = _product(shift, crc) ^ part
    return crc


# ---- tokenising ----------------------------------------------------------------------------------


#: A run of these behind a word is one piece; an apostrophe may begin a contraction.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens(dict):
    """Chunk -> the bytes of its ids, by the tokenizers library at first sight; when full, forgets what was not used of late.

    A byte-level tokenizer ends a piece before every blank that follows something else than white space, so texts are
    cut there and each chunk is encoded by itself. Latin letters behind a blank or none are one piece, which goes to the
    library's model at once; the marks behind them and a line end between words are pieces of their own. With any other
    kind of tokenizer a text is one chunk.
    """

    _cut = re.compile(r"(?<=\S)(?= )")
    _rare = re.compile(r"\s |\0")
    _word = re.compile(rf"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([{re.escape(_MARKS)}]*)").fullmatch
    _lines = re.compile(r" ?\S+(?:\n\S+)+").fullmatch

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.library = Tokenizer.from_str(definition)
        self.model = self.library.model
        held = json.loads(definition)
        before = held.get("pre_tokenizer") or {}
        self.cuts = (before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
                     and before.get("use_regex", True) and not held.get("normalizer")
                     and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or " " in x["content"]
                                 or x["content"][:1].isalpha() or x["content"] in ".,;:!?" for x in held.get("added_tokens") or []))

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            # Most new chunks are plain words, with marks behind them or not, which needs no pattern to be seen.
            word = None
            if not self.cuts:
                pass
            elif chunk.isascii():
                bare = chunk.rstrip(_MARKS)
                if (bare[1:] if bare[:1] == " " else bare).isalpha():
                    word = bare, chunk[len(bare):]
            elif found := self._word(chunk):
                word = found[1], found[2]
            if word and word[1]:
                ids = self[word[0]] + self[word[1]]
            elif word:
                written_as = (chunk.replace(" ", _BYTE_LEVEL[32]) if chunk.isascii() else
                              "".join([_BYTE_LEVEL[b] for b in chunk.encode()]))
                found = self.model.tokenize(written_as)
                ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
            elif self.cuts and self._lines(chunk):
                ids = self["\n"].join([self[part] for part in chunk.split("\n")])
            else:
                found = self.library.encode(chunk, add_special_tokens=False).ids
                ids = struct.pack(f"<{len(found)}I", *found)
        if len(chunk) <= KEPT_LENGTH:
            if len(self) >= KEPT_CHUNKS // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuts:
            return self[text]
        if self._rare.search(text):
            return b"".join(map(self.__getitem__, self._cut.split(text)))
        chunks = text.replace(" ", "\0 ").split("\0")
        if not chunks[0]:
            del chunks[0]
        return b"".join(map(self.__getitem__, chunks))


@lru_cache(maxsize=2)
def tokens_of(definition: str) -> Tokens:
    return Tokens(definition)


def _positions(docs: DataFrame, definition: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) in ascending order of the id; written once, as range bounds are sampled."""
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # the tokenizer file's size
    end = np.array([end_id], dtype=_ID).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, before = tokens_of(shared.value), 0
        for batch in sliced(batches, 1):
            ids = [tokens.ids(text or "") + end for text in batch.column(1).to_pylist()]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            sums = np.cumsum(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(before + sums - n), pa.array(n),
                 pa.array([np.frombuffer(x, _ID).astype("<u2").tobytes() if narrow else x for x in ids], pa.binary())],
                ["doc_id", "_part", "_before", "n_tokens", "ids"])
            before += int(sums[-1])

    narrow = fits_16_bits(definition, end_id)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("_tie"),
                       F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_tie", "_row"]  # a repeated id is split as well; its rows are in order of their texts' hashes
    ranged = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
              .select("doc_id", "_text", F.spark_partition_id().alias("_part")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = written(ranged.mapInArrow(run, f"doc_id {kind}, _part int, _before long, n_tokens long, ids binary"), "ids")
    totals = held.groupBy("_part").agg(F.sum("n_tokens").alias("_all"))
    across = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_all").over(across), F.lit(0)).alias("_offset"))
    return held.join(F.broadcast(offsets), "_part").select(  # one row per partition
        "doc_id", (F.col("_offset") + F.col("_before")).alias("start"), "n_tokens", "ids")


def fits_16_bits(definition: str, end_id: int) -> bool:
    held = json.loads(definition)
    ids = [*(held["model"].get("vocab") or {}).values(), *(x["id"] for x in held.get("added_tokens") or []), end_id]
    return all(isinstance(x, int) and x < 1 << 16 for x in ids)


def _counted(ids: DataFrame, narrow: bool) -> np.ndarray:
    """How often each id occurs: one row per id and task is shuffled, one per id comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, dtype=np.int64)
        for batch in sliced(batches, 0):
            more = np.bincount(text_bytes(batch.column(0))[0].view("<u2" if narrow else _ID))
            if len(more) > len(counts):
                counts, more = more, counts
            counts[:len(more)] += more
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


# ---- files ---------------------------------------------------------------------------------------

_BLOCKS = "first long, n int, docs array<struct<doc_id: {kind}, start: long, n_tokens: long>>, block binary"


def write_ids(docs: DataFrame, folder: str, definition: str, end_id: int = 0, id_col: str = "doc_id",
              text_col: str = "text", block: int = BLOCK, freq: np.ndarray | None = None) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending order of the id to ``folder``.

    ``definition`` is the tokenizer's JSON. A null text is empty and has the end id alone; rows without an id come first;
    rows of one id are in order of a hash of their texts; identical rows take neighbouring places. A text longer
    than a block is cut. Other columns are not read. An empty table gives no block. ``freq`` is a table to share
    with other folders; it has to cover every id that occurs.
    """
    spark = docs.sparkSession
    held = _positions(docs, definition, end_id, id_col, text_col)
    narrow = fits_16_bits(definition, end_id)
    freq = normalised(_counted(held, narrow)) if freq is None else freq
    shared = spark.sparkContext.broadcast(freq)  # one number per id of the vocabulary
    kind = held.schema["doc_id"].dataType.simpleString()
    schema = _BLOCKS.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        waiting: list[tuple[object, int, int, np.ndarray]] = []  # id, start and tokens of a document; its ids in this block
        held_ids = 0

        def packed() -> pa.RecordBatch:
            first = waiting[0][4]
            ids = np.concatenate([w[3] for w in waiting])
            return pa.RecordBatch.from_pylist(
                [{"first": first, "n": len(ids), "block": encode(ids, table),
                  "docs": [{"doc_id": w[0], "start": w[1], "n_tokens": w[2]} for w in waiting]}], arrow)

        for batch in sliced(batches, 3):
            for doc_id, start, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, "<u2" if narrow else _ID).astype(_ID)
                if waiting and waiting[-1][1] + waiting[-1][2] != start:  # a new file begins
                    yield packed()
                    waiting, held_ids = [], 0
                at = 0
                while at < n:
                    part = ids[at:at + block - held_ids]
                    waiting.append((doc_id, start, n, part, start + at))
                    at, held_ids = at + len(part), held_ids + len(part)
                    if held_ids == block:
                        yield packed()
                        waiting, held_ids = [], 0
        if waiting:
            yield packed()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    held.mapInArrow(run, schema).sortWithinPartitions("first").write.parquet(f"{folder}/blocks")
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id long, freq long").coalesce(1).write.parquet(
        f"{folder}/table")


def read_table(spark: SparkSession, folder: str) -> np.ndarray:
    rows = spark.read.parquet(f"{folder}/table").toPandas()  # one row per id of the vocabulary
    freq = np.zeros(int(rows["id"].max()) + 1 if len(rows) else 0, dtype=np.int64)
    freq[rows["id"].to_numpy(np.int64)] = rows["freq"].to_numpy(np.int64)
    return freq


def read_ids(spark: SparkSession, folder: str, parts: int = 1, first: int | None = None, last: int | None = None,
             digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, offset, n, ids``: a row for each piece of a document, from the files.

    ``offset`` and ``n`` say which of the document's ids the piece has; a document within one block and run of checkpoints has
    one piece. Every block is decoded as ``parts`` runs of checkpoints that may go to different tasks. ``first`` and
    ``last`` (a position after the end) leave out blocks that hold none of these positions. With ``digest`` the column
    ``crc`` with the checksum of the piece stands for ``ids``. A damaged block raises an error.
    """
    shared = spark.sparkContext.broadcast(read_table(spark, folder))
    blocks = spark.read.parquet(f"{folder}/blocks")
    if first is not None:
        blocks = blocks.where(F.col("first") + F.col("n") > first)
    if last is not None:
        blocks = blocks.where(F.col("first") < last)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    kind = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(shared.value)
        for batch in sliced(batches, 2):
            for row in range(batch.num_rows):
                position, docs, block, which = (c[row] for c in batch.columns)
                begin, ids = decode(block.as_py(), table, which.as_py(), parts)
                begin += position.as_py()
                fields = docs.values.flatten()
                start, n = (x.to_numpy(zero_copy_only=False) for x in fields[1:])
                low, high = np.maximum(start, begin), np.minimum(start + n, begin + len(ids))
                keep = np.flatnonzero(high > low)
                raw = memoryview(ids.tobytes())
                pieces = [raw[4 * (low[i] - begin):4 * (high[i] - begin)] for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [fields[0].take(pa.array(keep)), pa.array(start[keep]), pa.array(n[keep]),
                     pa.array((low - start)[keep]), pa.array((high - low)[keep]),
                     pa.array([zlib.crc32(x) for x in pieces], pa.int64()) if digest else pa.array([x.tobytes() for x in pieces], pa.binary())],
                    ["doc_id", "start", "n_tokens", "offset", "n", "crc" if digest else "ids"])

    return blocks.select("first", "docs", "block", part.alias("part")).mapInArrow(
        run, f"doc_id {kind}, start long, n_tokens long, offset long, n long, {'crc long' if digest else 'ids binary'}")


def digests(spark: SparkSession, folder: str, parts: int = 1) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files; pieces are put together by checksum."""
    pieces = written(read_ids(spark, folder, parts, digest=True), "pieces")
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"]
    whole = pieces.where("n = n_tokens").withColumnRenamed("crc", "ids_crc32").select(columns)
    # A position belongs to one document; its pieces are as many as the blocks that it fills.
    cut = pieces.where("n < n_tokens").groupBy("start").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sum("n").alias("_n"),
        F.sort_array(F.collect_list(F.struct("offset", "n", "crc"))).alias("_all"))

    @F.pandas_udf("long")
    def joined(rows: pd.Series) -> pd.Series:
        return rows.map(lambda row: joined_crc([(r["crc"], 4 * r["n"]) for r in row]))

    missing = F.when(F.col("_n") != F.col("n_tokens"), F.raise_error(F.lit("a piece of a document is missing"))).cast("long")
    return whole.unionByName(cut.withColumn("ids_crc32", F.coalesce(missing, joined("_all"))).select(columns))


def round_trip(docs: DataFrame, definition: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to a folder of the shared one, and give their digests as read from its files."""
    folder = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, folder, definition, end_id, id_col, text_col)
    return digests(docs.sparkSession, folder)
