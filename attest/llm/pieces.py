"""SentencePiece merge encoding with seeded dropout, and lossless decoding.

A text is cut before each run of blanks; such chunks are independent, because no piece of the vocabulary has a blank
after another letter. A chunk starts as letters. Its agenda holds every pair of neighbours that forms a piece; the
best one (highest score, then leftmost) is taken off again and again and merged, and the new neighbours' pairs join
the agenda. With dropout, a candidate taken off the agenda is skipped if a hash of (seed, document, number of the chunk
in the document, place, piece), keyed by the seed, falls below the rate. So each occurrence of a chunk is cut by
itself, in ways as varied as the merges allow, always the same ones for the same seed.

Many chunks of a batch are processed side by side: a step takes the best candidate off every chunk's agenda. Long
chunks, which are few, are processed alone with a heap. Only without dropout are equal chunks cut once.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import mix, sliced, text_bytes

DROPOUT = 0.1
#: Longest chunk that is processed side by side with others.
MATRIX = 24
#: Chunks that are processed side by side at a time.
BLOCK = 1 << 14
BLANK = 0x2581
#: Stands for a written U+2581, which the vocabulary takes for a blank; it is encoded as bytes, so nothing is lost.
WRITTEN_BLANK = 0x110000
NONE = -1


@dataclass
class Vocabulary:
    """Pieces of a merge-type model, and the merges that make them: sorted keys (left << 32 | right)."""

    texts: list[bytes]  # by id; blanks as spaces
    byte_id: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    rank: np.ndarray  # by id: 0 is merged first
    code_points: np.ndarray
    code_ids: np.ndarray

    @staticmethod
    def read(model_file: str) -> "Vocabulary":
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        normal, byte_id, texts = {}, np.full(256, NONE, dtype=np.int64), [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(piece[3:5], 16)] = i
                texts[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if "▁" in piece.lstrip("▁"):
                    raise ValueError(f"piece {piece!r} spans words")
                normal[piece] = i
                texts[i] = piece.replace("▁", " ").encode()
        if (byte_id < 0).any():
            raise ValueError("the vocabulary has no piece for some byte")
        pairs = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p))
                 if p[:k] in normal and p[k:] in normal]
        pairs.sort()
        keys = np.array([a << 32 | b for a, b, _ in pairs], dtype=np.int64)
        # Highest score first; equal scores are alike to the agenda and the leftmost goes first.
        scores = np.array([model.get_score(i) for i in range(size)])
        _, rank = np.unique(-scores, return_inverse=True)
        letters = {ord(p): i for p, i in normal.items() if len(p) == 1}
        points = np.array(sorted(letters), dtype=np.int64)
        return Vocabulary(texts, byte_id, keys, np.array([m for _, _, m in pairs], dtype=np.int64), rank,
                          points, np.array([letters[p] for p in points.tolist()], dtype=np.int64))

    def ids(self, points: np.ndarray) -> np.ndarray:
        """Ids of letters; an unknown letter is ``-2 - code point``."""
        at = np.minimum(np.searchsorted(self.code_points, points), len(self.code_points) - 1)
        return np.where(self.code_points[at] == points, self.code_ids[at], -2 - points)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair forms, or ``NONE``."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], NONE)


def _skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Keyed hash of a candidate, as a share of the hash range, below ``rate``."""
    h = mix(np.asarray(key) ^ mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + piece.astype(np.uint64)))
    return (h >> np.uint64(11)).astype(np.float64) < rate * 2.0**53


def _side_by_side(vocabulary: Vocabulary, ids: np.ndarray, length: np.ndarray, key: np.ndarray, rate: float):
    """Segment many chunks at once. ids: (chunks, width), padded with ``NONE``; returns ids and lengths."""
    ids = ids.copy()
    chunks, width = ids.shape
    start = np.tile(np.arange(width), (chunks, 1))  # where each symbol begins in its chunk
    far = np.int64(1) << 40
    todo, done_ids, done_length = np.arange(chunks), np.full((chunks, width), NONE, dtype=np.int64), length.copy()
    length = length.copy()

    def agenda(left, right, at, key):
        """Priority of each pair; ``far`` where there is none or it is skipped."""
        piece = vocabulary.merges(left, right)
        ok = piece >= 0
        if rate > 0:
            ok &= ~_skipped(key, at, piece, rate)
        return np.where(ok, vocabulary.rank[piece] * width + at, far), piece

    best, piece = agenda(ids[:, :-1], ids[:, 1:], start[:, :-1], key[:, None])
    while len(todo):
        k = best.argmin(axis=1) if best.shape[1] else np.zeros(len(todo), dtype=np.int64)
        rows = np.arange(len(todo))
        live = best[rows, k] < far if best.shape[1] else np.zeros(len(todo), dtype=bool)
        if not live.all():
            ended = todo[~live]
            done_ids[ended, :ids.shape[1]] = ids[~live]
            done_length[ended] = length[~live]
            todo, ids, start, key, length, best, piece, k = (
                x[live] for x in (todo, ids, start, key, length, best, piece, k))
            rows = np.arange(len(todo))
            if not len(todo):
                break
        # Merge symbols k and k + 1: what stands to the right moves one to the left.
        ids[rows, k] = piece[rows, k]
        columns = np.arange(ids.shape[1])
        source = np.minimum(columns[None, :] + (columns[None, :] > k[:, None]), ids.shape[1] - 1)
        ids, start = np.take_along_axis(ids, source, 1), np.take_along_axis(start, source, 1)
        ids[:, -1] = NONE
        length = length - 1
        pairs = np.arange(best.shape[1])
        moved = np.minimum(pairs[None, :] + (pairs[None, :] >= k[:, None]), best.shape[1] - 1)
        best, piece = np.take_along_axis(best, moved, 1), np.take_along_axis(piece, moved, 1)
        best[:, -1] = far
        for at in (k - 1, k):  # the pairs on either side of the new symbol
            some = np.flatnonzero((at >= 0) & (at < best.shape[1]))
            at = at[some]
            best[some, at], piece[some, at] = agenda(ids[some, at], ids[some, at + 1], start[some, at], key[some])
        ids, start = ids[:, :max(1, length.max())], start[:, :max(1, length.max())]
        best, piece = best[:, :max(0, length.max() - 1)], piece[:, :max(0, length.max() - 1)]
    return done_ids, done_length


def _alone(vocabulary: Vocabulary, ids: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
    """Segment one long chunk with a heap; the same pieces as side by side. key: an array of one."""
    ids, n = ids.copy(), len(ids)
    after, before = np.arange(1, n + 1).tolist(), np.arange(-1, n - 1).tolist()
    symbols, heap = ids.tolist(), []
    first = vocabulary.merges(ids[:-1], ids[1:])
    skipped = _skipped(np.repeat(key, n - 1), np.arange(n - 1), first, rate) if rate > 0 else np.zeros(n - 1, dtype=bool)
    rank = vocabulary.rank
    heap = [(int(rank[first[i]]), i, symbols[i], symbols[i + 1], int(first[i]))
            for i in np.flatnonzero((first >= 0) & ~skipped).tolist()]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            piece = vocabulary.merges(np.array([symbols[i]]), np.array([symbols[j]]))
            if piece[0] >= 0 and not (rate > 0 and _skipped(key, np.array([i]), piece, rate)[0]):
                heapq.heappush(heap, (int(rank[piece[0]]), i, symbols[i], symbols[j], int(piece[0])))

    gone = [False] * n
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or symbols[i] != left or symbols[j] != right:
            continue  # one of the two was merged otherwise meanwhile
        symbols[i] = piece
        gone[j] = True
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return np.array([s for s, g in zip(symbols, gone) if not g], dtype=np.int64)


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a batch with a leading blank before each text that isn't empty, and bounds of the texts."""
    texts = [t or "" for t in column.to_pylist()]
    joined = np.frombuffer("".join(" " + t if t else "" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    points = joined.astype(np.int64)
    points[joined == BLANK] = WRITTEN_BLANK
    points[joined == 0x20] = BLANK
    return points, np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])


def encode_batch(vocabulary: Vocabulary, column: pa.Array, seed: int = 0, rate: float = DROPOUT,
                 documents: np.ndarray | None = None):
    """Piece ids of all texts of a batch on end, and the bounds of each text.

    ``documents`` has a 64-bit hash for each text, on which its dropout depends; without it all texts have the same.
    """
    points, bounds = _points(column)
    if not len(points):
        return np.zeros(0, dtype=np.int64), bounds
    blank = points == BLANK
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[bounds[:-1][bounds[:-1] < len(points)]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, len(points)))
    ids = vocabulary.ids(points)
    if rate > 0:
        text = np.searchsorted(bounds, starts, side="right") - 1
        number = np.arange(len(starts)) - np.searchsorted(starts, bounds)[text]
        own = np.zeros(len(bounds) - 1, dtype=np.uint64) if documents is None else documents
        own = mix(own + mix(np.array([2 * seed + 1], dtype=np.uint64)))
        key = mix(own[text] + number.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        sample = which = np.arange(len(starts))
    else:
        # A chunk's hash: its letters, each mixed with its place.
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        key = mix(np.add.reduceat(
            mix(points.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + place.astype(np.uint64)), starts))
        _, sample, which = np.unique(key, return_index=True, return_inverse=True)
    found_length = np.zeros(len(sample), dtype=np.int64)
    long_rows, parts = {}, []
    offsets = np.zeros(len(sample), dtype=np.int64)
    total = 0
    for low, high in ((0, 6), (6, 9), (9, 12), (12, MATRIX)):
        every = np.flatnonzero((lengths[sample] > low) & (lengths[sample] <= high))
        for rows in (every[i:i + BLOCK] for i in range(0, len(every), BLOCK)):
            at, n = starts[sample[rows]], lengths[sample[rows]]
            columns = np.arange(high)
            matrix = np.where(columns[None, :] < n[:, None], ids[np.minimum(at[:, None] + columns, len(ids) - 1)], NONE)
            cut, count = _side_by_side(vocabulary, matrix, n, key[sample[rows]], rate)
            offsets[rows] = total + np.cumsum(count) - count
            found_length[rows] = count
            parts.append(cut[np.arange(cut.shape[1])[None, :] < count[:, None]])
            total += count.sum()
    for row in np.flatnonzero(lengths[sample] > MATRIX).tolist():
        at = starts[sample[row]]
        cut = _alone(vocabulary, ids[at:at + lengths[sample[row]]], key[sample[row]][None], rate)
        offsets[row], found_length[row] = total, len(cut)
        parts.append(cut)
        total += len(cut)
    held = np.concatenate(parts)
    out_length = found_length[which]
    ends = np.cumsum(out_length)
    pieces = held[np.arange(ends[-1]) - np.repeat(ends - out_length - offsets[which], out_length)]
    per_text = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
    return _as_bytes(vocabulary, pieces, per_text)


def _as_bytes(vocabulary: Vocabulary, pieces: np.ndarray, bounds: np.ndarray):
    """Letters that the vocabulary doesn't know become the pieces of their bytes."""
    unknown = np.flatnonzero(pieces < 0)
    if not len(unknown):
        return pieces, bounds
    letters = ["▁" if -2 - p == WRITTEN_BLANK else chr(-2 - p) for p in pieces[unknown].tolist()]
    encoded = [letter.encode() for letter in letters]
    count = np.ones(len(pieces), dtype=np.int64)
    count[unknown] = [len(e) for e in encoded]
    ends = np.cumsum(count)
    out = np.repeat(pieces, count)
    out[out < 0] = vocabulary.byte_id[np.frombuffer(b"".join(encoded), dtype=np.uint8)]
    return out, np.concatenate([[0], ends])[bounds]


class Decoder:
    """Bytes of piece ids by one gather."""

    def __init__(self, vocabulary: Vocabulary):
        self.length = np.array([len(t) for t in vocabulary.texts], dtype=np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(vocabulary.texts), dtype=np.uint8)

    def decode(self, pieces: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all texts on end and their bounds; the leading blank is taken off."""
        length = self.length[pieces]
        ends = np.cumsum(length)
        size = int(ends[-1]) if len(ends) else 0
        data = self.data[np.arange(size) - np.repeat(ends - length - self.offset[pieces], length)]
        at = np.concatenate([[0], ends])[bounds]
        some = np.flatnonzero(np.diff(at) > 0)
        keep = np.ones(size, dtype=bool)
        keep[at[some]] = False
        return data[keep], at - np.searchsorted(at[some], at)


def encode(docs: DataFrame, model_file: str, seed: int = 0, dropout: float = DROPOUT, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, pieces`` for every row: the ids of a varied segmentation, the plain one without ``dropout``.

    Null, empty texts have no pieces. Rows of the same id and text are cut alike, all others each in its own way; a null
    id stays null. An empty table gives no rows; other columns are not read.
    """
    return _run(docs, model_file, seed, dropout, id_col, text_col, digest=False)


def round_trip(docs: DataFrame, model_file: str, seed: int = 0, dropout: float = DROPOUT, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_pieces, pieces_crc32, lossless``: encode and decode every text in one pass, keeping digests only.

    Null and empty texts have no pieces and the checksum of nothing, and count as lossless; rows of one id and text are cut alike.
    An empty table gives no rows; other columns are not read.
    """
    return _run(docs, model_file, seed, dropout, id_col, text_col, digest=True)


def _run(docs: DataFrame, model_file: str, seed: int, dropout: float, id_col: str, text_col: str,
         digest: bool) -> DataFrame:
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be at least 0 and below 1")
    from zlib import crc32

    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(model_file))  # as large as the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        decoder = Decoder(vocabulary)
        for batch in sliced(batches, 1):
            documents = batch.column(2).to_numpy().view(np.uint64)
            pieces, bounds = encode_batch(vocabulary, batch.column(1), seed, dropout, documents)
            small = pieces.astype(np.int32)
            if not digest:
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(small))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "pieces"])
                continue
            data, at = decoder.decode(pieces, bounds)
            want, offsets = text_bytes(batch.column(1))
            same = [a1 - a0 == b1 - b0 and np.array_equal(data[a0:a1], want[b0:b1])
                    for a0, a1, b0, b1 in zip(at[:-1], at[1:], offsets[:-1], offsets[1:])]
            checks = [crc32(small[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(bounds)), pa.array(checks, pa.int64()), pa.array(same, pa.bool_())],
                ["doc_id", "n_pieces", "pieces_crc32", "lossless"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(id_col, text).alias("_document"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, " + (
        "n_pieces long, pieces_crc32 long, lossless boolean" if digest else "pieces array<int>"))


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """``doc_id, text``; null or no pieces decode to the empty text. Bytes that are no UTF-8 are replaced.

    A piece that is null, negative or beyond the vocabulary stands for nothing. Repeated rows are decoded alike; a null id
    stays null. An empty table gives no rows; other columns are not read.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.read(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            lists = batch.column(1)
            lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = pa.compute.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (flat >= 0) & (flat < len(decoder.length))
            bounds = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(lengths)])]
            data, at = decoder.decode(flat[known], bounds)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(pieces_col).cast("array<int>").alias("_pieces"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string")
