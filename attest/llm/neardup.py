"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star edges.

1. One pass over the texts sketches each document: its set of 5-word shingles (64-bit hashes) is cut into ``K``
   bins of the hash range, the least hash of each bin is the signature, and an empty bin takes the value of the
   first filled bin in its own fixed random order of bins. ``ROWS`` bins make a band. Equal sets are one class
   from here on, whatever number of documents has them.
2. Classes that share a band's value meet in a bucket. Two sets with similarity 0.75 miss each other in all 32
   bands with probability (1 - 0.75**4)**32 < 1e-5.
3. A bucket of up to ``SMALL`` classes is compared pair by pair (a constant number). A larger one gets a star: its
   members are compared with its centre, the class with the fewest shingles that no other class has.
4. Members of large buckets that the stars left in different components may still be linked. What such a pair
   shares is at most ``min(i, i') + min(o, o')``: i is what a member shares with the centre, o how many of its
   other shingles any other class has. Pairs that this bound rules out are never formed; the rest are compared.
   So no link is lost to the star. A group of near copies costs its size; a family of pages that are nearly but not
   quite similar enough to each other still costs up to its square here.
5. Every link is confirmed on the full sets; components are found by large-star/small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import WIDE_SLICE_BYTES, hash_words, mix, sliced, written
from attest.operators.coverage import connected_components

WORDS = 5
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Largest bucket that is compared pair by pair.
SMALL = 16
#: Members of a star that meet one copy of its centre's set.
STAR = 256

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - K.bit_length() + 1)
_EDGES = np.arange(K, dtype=np.uint64) << _SHIFT
_ORDERS = np.array([np.random.default_rng(j).permutation(K) for j in range(K)])
_BAND = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def _fold(parts: list[np.ndarray]) -> np.ndarray:
    out = parts[0]
    for part in parts[1:]:
        out = out * _FACTOR + part
    return mix(out)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts of one to four words have one, empty ones none."""
    (words,), bounds = hash_words(column)
    rolled = _fold([words[k:len(words) - WORDS + 1 + k] for k in range(WORDS)]) if len(words) >= WORDS else words[:0]
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a:b - WORDS + 1]))
        else:
            out.append(_fold([np.full(1, b - a, dtype=np.uint64), *words[a:b].reshape(-1, 1)]) if b > a else words[:0])
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each of ``K`` equal ranges; empty ranges borrow from the first filled one in their order."""
    at = np.minimum(np.searchsorted(shingles, _EDGES), len(shingles) - 1)
    found = shingles[at]
    filled = (found >> _SHIFT) == np.arange(K, dtype=np.uint64)
    if not filled.all():
        orders = _ORDERS[~filled]
        lender = orders[np.arange(len(orders)), filled[orders].argmax(axis=1)]
        found[~filled] = found[lender]
    return found


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1, WIDE_SLICE_BYTES):
        sets = shingle_sets(batch.column(1))
        some = np.array([len(s) > 0 for s in sets], dtype=bool)
        if batch.column(0).null_count:
            some &= batch.column(0).is_valid().to_numpy(zero_copy_only=False)
        ids = [blake2b(s.tobytes(), digest_size=16).digest() if ok else None for s, ok in zip(sets, some)]
        signed = np.array([signature(s) for s, ok in zip(sets, some) if ok], dtype=np.uint64).reshape(-1, BANDS, ROWS)
        keys = mix(_fold([signed[:, :, k] for k in range(ROWS)]) + _BAND).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(some) * BANDS]).astype(np.int32)
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), bands],
            ["doc_id", "n_shingles", "set_id", "bands"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches, 1, WIDE_SLICE_BYTES):
        sets = shingle_sets(batch.column(1))
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        held = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
        ids = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(held))],
            ["set_id", "shingles"])


def _linked(shared: str, a: str, b: str):
    """100 * shared >= 75 * union, with union = a + b - shared."""
    return 7 * F.col(shared) >= 3 * (F.col(a) + F.col(b))


def _compare(pairs: DataFrame, sets: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(a, b) with ``n_a``, ``n_b`` and the number of common shingles.

    Where one class stands on the left of many pairs, ``copies`` (a, copies) says how often its set is laid out;
    ``pairs`` then have ``copies`` as well, and each meets one of them by a hash of its right side.
    """
    left = sets.select(F.col("set_id").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("set_id").alias("b"), F.col("shingles").alias("_b"))
    on = ["a"]
    if copies is not None:
        left = left.join(copies, "a").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        pairs = pairs.withColumn("_copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int"))
        on = ["a", "_copy"]
    return (pairs.join(right, "b").join(left, on)
            .select("a", "b", F.size("_a").cast("long").alias("n_a"), F.size("_b").cast("long").alias("n_b"),
                    F.size(F.array_intersect("_a", "_b")).cast("long").alias("common")))


def _small_pairs(members: DataFrame) -> DataFrame:
    few = members.where(F.col("m") <= SMALL)
    a, b = (few.select("key", F.col("set_id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    near = 4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")
    return a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def _large_members(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of large buckets that can be linked at all, with how many of their shingles another such class has."""
    many = members.where(F.col("m") > SMALL)
    items = (sets.join(many.select("set_id").distinct(), "set_id", "left_semi")
             .select("set_id", F.explode("shingles").alias("shingle")))
    common = items.groupBy("shingle").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("shingle")
    held = items.join(common, "shingle").groupBy("set_id").agg(F.count(F.lit(1)).alias("held"))
    return many.join(held, "set_id").where(4 * F.col("held") >= 3 * F.col("n")).select("key", "set_id", "n", "held")


def _left_over(compared: DataFrame, held: DataFrame, component: DataFrame) -> DataFrame:
    """Pairs that share a centre, stand in different components, and are not ruled out by the bound.

    Members of a bucket share its centre, so these are all pairs of large buckets that may still be linked.
    """
    of, of_centre = (component.select(F.col("node").alias(x), F.col("component").alias(f"_of_{x}")) for x in ("b", "a"))
    rows = (compared.join(held, compared["b"] == held["set_id"]).join(of, "b", "left").join(of_centre, "a", "left")
            .select(F.col("a").alias("centre"), "set_id", F.col("n_b").alias("n"), "common",
                    (F.col("held") - F.col("common")).alias("other"), F.coalesce("_of_b", "b").alias("component"),
                    F.coalesce("_of_a", "a").alias("main")))
    least = rows.groupBy("centre").agg(F.min("n").alias("_least"))
    rows = (rows.join(least, "centre")
            .where(7 * (F.col("common") + F.col("other")) >= 3 * (F.col("n") + F.col("_least"))))
    a, b = (rows.select("centre", F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("common").alias(f"i_{x}"),
                        F.col("other").alias(f"o_{x}"), F.col("component").alias(f"c_{x}"), F.col("main").alias(f"m_{x}"))
            for x in "ab")
    most = F.least("i_a", "i_b") + F.least("o_a", "o_b")
    pairs = a.where("c_a <> m_a").join(b, (a["centre"] == b["centre"]) & (F.col("c_a") != F.col("c_b"))
                                       & (7 * most >= 3 * (F.col("n_a") + F.col("n_b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _components(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(set_id, component_id) of the classes that are linked to another class."""
    keys = classes.select("set_id", "n", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(keys.join(sizes, "key"), "buckets")
    met = written(members.select("set_id").distinct(), "met")
    asked = classes.join(met, "set_id", "left_semi").select(F.col("rep").alias("_rep"))
    texts = docs.join(asked, F.col("doc_id") == F.col("_rep"), "left_semi")
    sets = texts.select("doc_id", "_text").mapInArrow(_full_sets, "set_id binary, shingles array<long>")
    sets = written(sets.join(met, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")

    large = written(_large_members(members, sets), "large")
    centres = large.groupBy("key").agg(
        F.min_by("set_id", F.struct(F.col("n") - F.col("held"), F.col("set_id"))).alias("centre"))
    # A copy of the centre's set for every STAR members of its largest bucket, so that no task meets all of a star.
    shares = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("_copies"))
    copies = written(centres.join(shares, "key").groupBy(F.col("centre").alias("a")).agg(F.max("_copies").alias("copies")), "centres")
    edges = (large.join(centres, "key").where("set_id <> centre")
             .select(F.col("centre").alias("a"), F.col("set_id").alias("b")).distinct().join(copies, "a"))
    compared = written(_compare(edges, sets, copies), "stars")
    links = written(_compare(_small_pairs(members), sets).where(_linked("common", "n_a", "n_b")).select("a", "b")
                    .unionByName(compared.where(_linked("common", "n_a", "n_b")).select("a", "b")), "links")
    component = connected_components(links)
    held = large.select("set_id", "held").distinct()
    rest = written(_compare(_left_over(compared, held, component), sets).where(_linked("common", "n_a", "n_b"))
                   .select("a", "b"), "rest")
    if not rest.isEmpty():
        component = connected_components(links.unionByName(rest))
    named = component.join(classes.select(F.col("set_id").alias("node"), "rep"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select(F.col("node").alias("set_id"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked when ``100 * intersection >= 75 * union`` of their shingle sets; ``component_id`` is the
    smallest id reachable over links, ``kept`` says that it is the row's own.
    Null, empty and blank texts have no shingles and are linked with nothing. A row without an id takes no part: its
    component is null and it is kept. Rows that share an id are one document with several texts. An empty table gives
    no rows; other columns are not read.
    """
    return _judged(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``near_duplicates`` with the key of their set."""
    held = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = held.schema["doc_id"].dataType.simpleString()
    sketch = written(held.mapInArrow(_sketch, f"doc_id {kind}, n_shingles long, set_id binary, bands array<long>"),
                     "sketch")
    classes = written(sketch.where("set_id is not null").groupBy("set_id").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    merged = _components(held, classes)
    names = (classes.select("set_id", "rep").join(merged, "set_id", "left")
             .select("set_id", F.coalesce("component_id", "rep").alias("_name")))
    return (sketch.select("doc_id", "n_shingles", "set_id").join(names, "set_id", "left")
            .select("doc_id", "n_shingles", "set_id", F.coalesce("_name", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without the documents that are near copies of another.

    Of rows that share an id, one stays for each different set of shingles that no smaller id has a near copy of: the
    first in order of text and of the whole row's hash. Texts without words are equal sets. Rows without an id are all kept.
    """
    judged = _judged(docs, id_col, text_col).where("doc_id is not null")
    ids = written(judged.groupBy("doc_id").agg(F.max("kept").alias("_any"), (F.count(F.lit(1)) > 1).alias("_many"))
                  .where("_any").select(F.col("doc_id").alias("_kept_id"), "_many"), "kept")
    # An id of one row needs no look at its text again, and its row moves at most once.
    out = (docs.join(ids.where("not _many"), F.col(id_col) == F.col("_kept_id"), "left_semi")
           .unionByName(docs.where(F.col(id_col).isNull())))
    many = ids.where("_many").select("_kept_id")
    if many.isEmpty():
        return out
    none = F.lit(b"")
    kept = (judged.where("kept").join(many, F.col("doc_id") == F.col("_kept_id"), "left_semi")
            .select(F.col("doc_id").alias("_kept_id"), F.coalesce("set_id", none).alias("_kept_set")).distinct())
    names = [f.name for f in docs.schema.fields]
    rows = docs.join(many, F.col(id_col) == F.col("_kept_id"), "left_semi").select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_row"), F.col(id_col).alias("_id"),
        F.col(text_col).cast("binary").alias("_text"))
    kinds = rows.schema
    keyed = rows.mapInArrow(_set_ids, f"_row {kinds['_row'].dataType.simpleString()}, _id {kinds['_id'].dataType.simpleString()}, _set binary")
    named = keyed.join(kept, (F.col("_id") == F.col("_kept_id")) & (F.col("_set") == F.col("_kept_set")), "left_semi")
    text = F.col(f"_row.c{names.index(text_col)}").cast("binary")
    order = F.struct(F.coalesce(text, none), F.xxhash64(F.to_json("_row")))
    one = named.groupBy("_id", "_set").agg(F.min_by("_row", order).alias("_row"))
    return out.unionByName(one.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)]))


def _set_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the key of their text's set, empty for a text without words."""
    for batch in sliced(batches, 2, WIDE_SLICE_BYTES):
        ids = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"" for s in shingle_sets(batch.column(2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], ["_row", "_id", "_set"])
