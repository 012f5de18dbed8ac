"""Ranked lexical search: term at a time over blocks of documents, with a limited number of accumulators.

Documents are indexed in blocks: the terms of a block with the documents that hold them and how often. Document
frequencies and lengths are summed over all blocks first, so every block scores with the same whole-corpus statistics.
In a block an item's terms are worked off rarest first. A term opens accumulators for its documents until the terms
that are left could not lift a new document to the kth best score so far; from then on only accumulators that exist are
updated, exactly. What "the kth best so far" means is the kth best score that the task has seen for the item, in
finished blocks or as partial scores of this one. Each task gives its best k of an item, and the global order picks k.

Terms are compared as 64-bit hashes: two of a million terms of items and a billion of the corpus agree by chance with a
probability below 1e-4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import hash_words, sliced, written

K = 10
#: Text in a block of the index, and how many terms of items (with repeats) are worked on in one pass over it.
BLOCK_BYTES, PASS_TERMS = 2 << 20, 1 << 20
#: The bytes that belong to no term.
SEPARATORS = np.ones(256, dtype=bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_BLOCK = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (id, text) as blocks: postings in order of the term's hash."""
    for batch in sliced(batches, 1, BLOCK_BYTES):
        (hashes,), bounds = hash_words(batch.column(1), separators=SEPARATORS)
        lengths = np.diff(bounds)
        doc = np.repeat(np.arange(batch.num_rows, dtype=np.int32), lengths)
        order = np.lexsort((doc, hashes))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(doc)))
        terms, starts = np.unique(hashes[at], return_index=True)
        arrays = [batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), lengths.astype(np.int64), terms,
                  np.append(starts, len(at)).astype(np.int64), doc[at].astype(np.int32), counts.astype(np.uint32)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), *(pa.array([a.tobytes()]) for a in arrays)],
            ["n_docs", "n_terms", "ids", "lengths", "terms", "starts", "places", "counts"])


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The blocks of all documents that have an id, written to the shared folder."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"),
                                                        F.col(text_col).cast("binary").alias("_text"))
    return written(rows.mapInArrow(_index, _BLOCK), "postings")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) summed over the blocks of a batch."""
    for batch in batches:
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(0)]
        n = [np.diff(np.frombuffer(x.as_buffer(), np.int64)) for x in batch.column(1)]
        terms, at = np.unique(np.concatenate(held), return_inverse=True) if held else (np.zeros(0, np.uint64), [])
        sums = np.zeros(len(terms), dtype=np.int64)
        if len(terms):
            np.add.at(sums, at, np.concatenate(n))
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(sums)], ["term", "df"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (item, text) as a row for each different term of the item, with its repeats."""
    for batch in sliced(batches, 1):
        (hashes,), bounds = hash_words(batch.column(1), separators=SEPARATORS)
        item = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        order = np.lexsort((hashes, item))
        item, hashes = item[order], hashes[order]
        new = np.ones(len(item), dtype=bool)
        new[1:] = (item[1:] != item[:-1]) | (hashes[1:] != hashes[:-1])
        at = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(item[at])), pa.array(hashes[at].view(np.int64)), pa.array(np.diff(np.append(at, len(item))))],
            ["item_id", "term", "repeats"])


class Block:
    """The postings of a block; ``impact`` is a posting's score for a weight of 1, worked out once per term."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        def array(name, kind):
            return np.frombuffer(row[name], kind)

        self.ids, lengths = array("ids", np.int64), array("lengths", np.int64)
        self.m = 8 * (100 - 75 + 75 * lengths * n_docs // max(n_terms, 1))
        self.terms, self.starts = array("terms", np.uint64), array("starts", np.int64)
        self.places, self.counts = array("places", np.int32), array("counts", np.uint32)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places, impacts and greatest impact of the block's ``at``-th term."""
        if at not in self.held:
            part = slice(self.starts[at], self.starts[at + 1])
            tf, places = self.counts[part].astype(np.int64), self.places[part]
            impact = 1_000_000_000 * tf // (1000 * tf + self.m[places])
            self.held[at] = places, impact, int(impact.max())
        return self.held[at]

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents that may be among the best ``k``, given that ``k`` with at least ``floor`` are known.

        ``terms`` stand in order of rarity, ``weights`` have the repeats in them.
        """
        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) if len(self.terms) else []
        steps = [(int(w), *self.postings(a)) for a, w in zip(at[there].tolist(), weights[there])] if len(self.terms) else []
        left = sum(w * most for w, _, _, most in steps)
        score = np.zeros(len(self.ids), dtype=np.int64)
        opened = np.zeros(len(self.ids), dtype=bool)
        opening = True
        for w, places, impact, most in steps:
            if opening and left < floor:
                opening = False
            elif opening and (some := score[opened]).size >= k:
                opening = left >= max(floor, int(np.partition(some, -k)[-k]))
            if opening:
                opened[places] = True
                score[places] += w * impact
            else:
                kept = opened[places]
                score[places[kept]] += w * impact[kept]
            left -= w * most
        found = np.flatnonzero(opened & (score > 0) & (score >= floor))
        if len(found) > k:
            found = found[np.lexsort((self.ids[found], -score[found]))[:k]]
        return self.ids[found], score[found]


def _search(items: list, n_docs: int, n_terms: int, k: int, item_type: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [(item, np.frombuffer(t, np.uint64), np.frombuffer(w, np.int64)) for item, t, w in items.value]
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(wanted)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block({name: batch.column(name)[row].as_buffer() for name in batch.schema.names}, n_docs, n_terms)
                for i, (_, terms, weights) in enumerate(wanted):
                    ids, scores = best[i]
                    more = block.best(terms, weights, k, int(scores.min()) if len(scores) == k else 0)
                    if len(more[0]):
                        ids, scores = np.append(ids, more[0]), np.append(scores, more[1])
                        order = np.lexsort((ids, -scores))[:k]
                        best[i] = ids[order], scores[order]
        at = np.repeat(np.arange(len(best)), [len(ids) for ids, _ in best])
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [pa.array([wanted[i][0] for i in at], item_type), pa.array(np.concatenate([x for x, _ in best])),
                 pa.array(np.concatenate([x for _, x in best]))], ["item_id", "doc_id", "score"])
    return search


def ranked(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", pass_terms: int = PASS_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest score above 0 for each item.

    Terms are runs of ASCII letters, digits and any other than ASCII characters, with A-Z lower-cased. Equal scores are in order of the
    document's id; rows of one id are documents of their own. Rows without an id take no part on either side; null
    and blank texts have no terms and are counted nowhere; an item without terms, or with none that occurs, gives no
    rows. Several rows of one item id are one item, with the terms of all. Empty tables give no rows. Other
    columns are not read. Items are worked on in passes over the index of about ``pass_terms`` terms each.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if k < 1:
        raise ValueError("k must be at least 1")
    blocks = index(docs, id_col, text_col)
    whole = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    n_docs, n_terms = int(whole[0]), int(whole[1])
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("_text"))
    kind = asked.schema["item_id"].dataType
    queries = written(asked.mapInArrow(_terms, f"item_id {kind.simpleString()}, term long, repeats long")
                      .groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")), "terms")
    wanted = queries.select("term").distinct()
    if queries.count() <= pass_terms:  # else Spark chooses the join
        wanted = F.broadcast(wanted)
    df = (blocks.select("terms", "starts").mapInArrow(_frequencies, "term long, df long")
          .join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(queries.join(df, "term").select("item_id", "term", "df", (weight * F.col("repeats")).alias("w")), "items")
    passes = max(1, -(-weighted.count() // pass_terms))
    found = None
    for turn in range(passes):  # each pass holds about pass_terms terms in every task, however many items there are
        rows = (weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == turn)
                .groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("df", "term", "w"))).alias("t")).collect())
        held = docs.sparkSession.sparkContext.broadcast([
            (r["item_id"], np.array([x["term"] for x in r["t"]], dtype=np.int64).tobytes(),
             np.array([x["w"] for x in r["t"]], dtype=np.int64).tobytes()) for r in rows])
        part = blocks.drop("n_docs", "n_terms").mapInArrow(
            _search(held, n_docs, n_terms, k, to_arrow_type(kind)), f"item_id {kind.simpleString()}, doc_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))
