"""Token ids, hard negatives and ranked search against brute force."""

import collections
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge import edge_table, sentence, texts  # noqa: E402

from attest.llm import lexical, negatives, tokenids  # noqa: E402

TOKENIZER = Path("/opt/tokenizers/byte_bpe_50k.json")
needs_tokenizer = pytest.mark.skipif(not TOKENIZER.exists(), reason="the public tokenizer files are not here")


# ---- token ids


def some_ids(n, kinds=3000, seed=0):
    return np.random.default_rng(seed).zipf(1.3, n).clip(1, kinds).astype("<u4") - 1


def test_frequencies_cover_what_occurs_and_sum_to_the_scale():
    for counts in ([5], [0, 1, 0], [1] * 5000, [10**12, 1, 1, 0], np.bincount(some_ids(9999))):
        freq = tokenids.normalised(np.array(counts))
        assert freq.sum() == 1 << tokenids.SCALE and ((freq > 0) == (np.array(counts) > 0)).all()
    assert not tokenids.normalised(np.zeros(3, dtype=int)).any()


def test_blocks_decode_whole_and_in_runs_of_checkpoints():
    for n in (1, 2, 63, 64, 65, 4097, 70_000):
        ids = some_ids(n)
        table = tokenids.Table(tokenids.normalised(np.bincount(ids)))
        block = tokenids.encode(ids, table, lanes=32, every=16)
        assert (tokenids.decode(block, table)[1] == ids).all()
        for parts in (2, 7):
            runs = [tokenids.decode(block, table, p, parts) for p in range(parts)]
            assert (np.concatenate([r[1] for r in runs]) == ids).all()
            assert [r[0] for r in runs] == np.cumsum([0, *(len(r[1]) for r in runs)])[:-1].tolist()


def test_blocks_come_near_to_the_entropy():
    ids = some_ids(200_000)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    bits = 8 * len(tokenids.encode(ids, tokenids.Table(tokenids.normalised(counts)))) / len(ids)
    assert bits < -(share * np.log2(share)).sum() * 1.1


def test_damage_is_noticed():
    ids = some_ids(5000)
    table = tokenids.Table(tokenids.normalised(np.bincount(ids)))
    block = tokenids.encode(ids, table)
    for at in (0, 7, 30, len(block) // 2, len(block) - 1):
        with pytest.raises(ValueError):
            tokenids.decode(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:], table)
    with pytest.raises(ValueError):
        tokenids.decode(block[:-1], table)
    other = tokenids.Table(tokenids.normalised(np.bincount(some_ids(5000, seed=5), minlength=3000) + 1))
    with pytest.raises(ValueError):
        tokenids.decode(block, other)
    with pytest.raises(ValueError):
        tokenids.encode(np.array([2999], dtype="<u4"), tokenids.Table(tokenids.normalised(np.array([1] * 2999 + [0]))))


def test_checksums_join():
    parts = [b"", b"a", b"bc" * 999, b"", b"\0" * 12]
    assert tokenids.joined_crc([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(b"".join(parts))


@needs_tokenizer
def test_chunks_are_encoded_as_whole_texts():
    tokens = tokenids.Tokens(TOKENIZER.read_text())
    assert tokens.cuts
    rng = random.Random(1)
    alphabet = [" ", "  ", "\n", " \n", " ", "　", " ", "\x1c", "\x85", "a", "It", "'s", " 's", "é", "12", ".", "…", "<|endoftext|>", "☃", "\t", "\0"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        whole = tokens.library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == whole, repr(text)


def plain_digest(rows, end=0):
    """rows: (id, text) in order."""
    library, at, out = tokenids.Tokens(TOKENIZER.read_text()).library, 0, []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@needs_tokenizer
@pytest.mark.parametrize("block,parts", [(tokenids.BLOCK, 1), (700, 1), (700, 3)])
def test_files_give_back_all_ids(spark, tmp_path, block, parts):
    rows = [(i, t) for i, t, _ in texts() if i != 3] + [(3, texts()[2][1])] * 2
    docs = edge_table(spark, [(i, t, "a") for i, t in rows]).repartition(3)
    folder = str(tmp_path / "ids")
    tokenids.write_ids(docs, folder, TOKENIZER.read_text(), block=block)
    got = sorted(map(tuple, tokenids.digests(spark, folder, parts).collect()), key=lambda r: r[1])
    want = plain_digest(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert got == want
    assert len(got) == len(rows)
    blocks = spark.read.parquet(f"{folder}/blocks").collect()
    assert all(b["n"] <= block for b in blocks) and sum(b["n"] for b in blocks) == sum(r[2] for r in want)
    part = tokenids.read_ids(spark, folder, parts, first=100, last=101).collect()
    assert any(r["start"] + r["offset"] <= 100 < r["start"] + r["offset"] + r["n"] for r in part)
    shared = tokenids.read_table(spark, folder)
    tokenids.write_ids(docs, folder + "2", TOKENIZER.read_text(), block=block, freq=shared)  # with the other folder's table
    assert sorted(map(tuple, tokenids.digests(spark, folder + "2").collect()), key=lambda r: r[1]) == got


@needs_tokenizer
def test_no_documents_no_ids(spark):
    assert tokenids.round_trip(edge_table(spark, []), TOKENIZER.read_text()).count() == 0
    got = tokenids.round_trip(edge_table(spark, [(5, None, "a")]), TOKENIZER.read_text()).collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(5, 0, 1)]


# ---- hard negatives


def vectors(n, dim=6, labels=4, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(0, spread, dim)], int(rng.integers(labels))) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int, score double, v long, rank int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, 1.0, 7, 3) for r in rows], SCHEMA)


def plain_negatives(rows, every, n_positives=5, n_negatives=3, share=(50, 95)):
    held = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ([math.floor(256 * x) for x in v], label)
        held[i] = min(held.get(i, row), row)
    out = []
    for a, (v, label) in held.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (w, other) in held.items()
                        if i != a and len(w) == len(v))
        for p, i, _ in [s for s in scored if s[2]][:n_positives]:
            fits = [s for s in scored if not s[2] and share[0] * -p <= -100 * s[0] <= share[1] * -p][:n_negatives]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, **settings):
    return sorted(map(tuple, negatives.hard_negatives(df, **settings).collect()))


def test_negatives_against_every_pair(spark):
    rows = vectors(600) + [(700 + i, [0.25] * 6, i % 2) for i in range(60)] + [(800 + i, [0.0] * 6, i % 3) for i in range(9)]
    want = plain_negatives(rows, 20)
    assert len(want) > 100
    assert mined(vector_table(spark, rows).repartition(5), every=20, block=64, group=7) == want


def test_negatives_with_big_numbers(spark):
    rows = vectors(200, spread=1e6, seed=3)
    assert mined(vector_table(spark, rows), every=10, block=50) == plain_negatives(rows, 10)


def test_the_search_stops_before_the_lists_end():
    rng = np.random.default_rng(0)
    matrix = np.floor(256 * rng.normal(0, 1, (4096, 3)))
    block = negatives.Candidates(np.arange(4096), np.zeros(4096, dtype=int), matrix, np.argsort(matrix, axis=0).T.astype(np.int32))
    scored = []
    block.scores = lambda rows, anchor: (scored.append(len(rows)), (matrix[rows] @ anchor).astype(np.int64))[1]
    ends = np.array([-(2**62)]), np.array([2**62])
    anchor = np.array([200.0, -100.0, 0.0])
    (ids, _), = block.search(anchor, np.ones(4096, dtype=bool), *ends, 5)
    assert ids.tolist() == np.lexsort((np.arange(4096), -(matrix @ anchor)))[:5].tolist() and sum(scored) < 2000


def test_negatives_stand_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.75, 0.75], 1), (2, [0.75, 0.75], 1), (3, [0.5, 1.0], 1), (4, None, 1),
           (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 0), (8, [1.0, 1.0], None), (9, [1.0], 1),
           (10, [], 0), (11, [], 0), (12, [], 1), (13, [0.5, 0.5], 1), (14, [0.5, 0.5], 1), (15, [2.0, 2.0], 2)]
    assert mined(vector_table(spark, odd), every=5) == plain_negatives(odd, 5)
    assert mined(vector_table(spark, odd), every=1) == plain_negatives(odd, 1)
    assert mined(vector_table(spark, []), every=1) == []
    with pytest.raises(ValueError):
        negatives.hard_negatives(vector_table(spark, []), every=0)


# ---- ranked search


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_ranked(docs, items, k):
    held = [(i, collections.Counter(terms(t))) for i, t in docs if i is not None]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    asked = collections.defaultdict(list)
    for item, text in items:
        if item is not None:
            asked[item] += terms(text)
    out = []
    for item, wanted in asked.items():
        scores = []
        for doc, counts in held:
            m = 100 - 75 + 75 * sum(counts.values()) * n_docs // n_terms if n_terms else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                        for t in wanted if t in counts)
            if score > 0:
                scores.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def item_table(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "item_id long, text string, doc_id long, term string, df int")


@pytest.mark.parametrize("block,pass_terms", [(8 << 20, 1 << 20), (600, 7)])
def test_ranking_against_every_document(spark, monkeypatch, block, pass_terms):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i % 190, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(60)))) for i in range(200)] + [(i, t) for i, t, _ in texts()]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for i in range(30)]
    items += [(40, None), (41, " . "), (42, "W1 w1, w1"), (42, "w7"), (None, "w3"), (43, "nowhere"), (44, "Ünï ☃ one"), (45, sentence(40, 1))]
    want = plain_ranked(docs, items, 4)
    rows = lexical.index(edge_table(spark, [(i, t, "a") for i, t in docs]).repartition(3))
    assert rows.count() >= 3
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    got = lexical.ranked(edge_table(spark, [(i, t, "a") for i, t in docs]).repartition(3), item_table(spark, items), 4, pass_terms=pass_terms)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_accumulators_are_limited():
    """A common term of small weight opens no document once a rare one has found enough."""
    n = 50
    posting = [np.arange(3, dtype=np.int32), np.arange(n, dtype=np.int32)]
    row = {"ids": np.arange(n), "lengths": np.full(n, 10), "terms": np.array([5, 9], dtype=np.uint64), "starts": np.array([0, 3, 3 + n]),
           "places": np.concatenate(posting), "counts": np.ones(3 + n, dtype=np.uint32)}
    block = lexical.Block({k: v.tobytes() for k, v in row.items()}, n, 10 * n)
    ids, scores = block.best(np.array([5, 9], dtype=np.uint64), np.array([900, 2]), 3, 0)
    assert ids.tolist() == [0, 1, 2] and len(set(scores.tolist())) == 1
    ids, _ = block.best(np.array([5, 9], dtype=np.uint64), np.array([2, 900]), 3, 0)
    assert ids.tolist() == [0, 1, 2]
    assert not len(block.best(np.array([9], dtype=np.uint64), np.array([2]), 3, 10**9)[0])


def test_ranking_of_nothing(spark):
    docs, items = edge_table(spark, []), item_table(spark, [(1, "a b")])
    assert lexical.ranked(docs, items).count() == 0
    assert lexical.ranked(edge_table(spark, [(1, None, "a"), (2, "", "a")]), items).count() == 0
    assert lexical.ranked(edge_table(spark, [(1, "a", "a")]), item_table(spark, [])).count() == 0


def test_plain_words_need_no_pattern(monkeypatch):
    tokens, asked = tokenids.Tokens(TOKENIZER.read_text()), []
    plain = tokenids.Tokens._word
    monkeypatch.setattr(tokens, "_word", lambda chunk: asked.append(chunk) or plain(chunk), raising=False)
    for chunk in ("word", " word", " word,", "word.", " wörd!", " a1", " ,", ",", " ", " wo.rd", " a\nb.", " ªb", "a?!"):
        want = np.array(tokens.library.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert tokens[chunk] == want, chunk
    assert asked and not any(chunk.isascii() for chunk in asked)


@needs_tokenizer
def test_marks_behind_a_word_go_by_themselves():
    """Runs of marks are pieces of their own, so that a word before them is not shown to the library's whole path."""
    tokens, asked = tokenids.Tokens(TOKENIZER.read_text()), []
    assert tokens.cuts
    library = tokens.library

    class Watched:
        def encode(self, chunk, **how):
            asked.append(chunk)
            return library.encode(chunk, **how)

    tokens.library = Watched()
    marks = [a + b * n for a in ("", ".", ",", "!", "_", "<|", "\\", "]^") for b in "$%#&*!`" for n in (0, 1, 2, 3, 5)]
    words = [w + m for w in ("Thon", "quexa", "éanment", "entzchsch") for m in marks]
    odd = ["it's$$", "don't.", "'s", "a'", "x'll!!", "a1$$", "$$a", "<|endoftext|>", "word<|endoftext|>", "word$<|endoftext|>!!", "a\0b", "\0", "\0 c", "ab×$", "ab·"]
    for text in [*words, *odd, " ".join(words), " " + " ".join(odd) + " ", "a  b \n c$$$ ", " ", "\0 a\0 b"]:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == want, text
    assert not [x for x in asked if re.fullmatch(r" ?[^\W\d_]+[$%#&*!`.,]+", x)]
