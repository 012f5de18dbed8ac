"""Packing, licenses, URLs, pieces, token counts, top-k and shards against brute force."""

import collections
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))

from edge import edge_table, sentence, texts  # noqa: E402

from attest.llm import licenses, packing, pieces, sharding, tokencount, topk, urls  # noqa: E402

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
needs_model = pytest.mark.skipif(not Path(MODEL).exists(), reason="the public vocabulary files are not here")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- packing


class PlainBins:
    """Best fit by trying every bin."""

    def __init__(self, capacity):
        self.capacity, self.bins = capacity, []

    def place(self, size, source, cluster):
        fits = [(b["left"], i) for i, b in enumerate(self.bins)
                if b["left"] >= size and not (source & b["s"] or cluster & b["c"]) and b["left"] > 0]
        if not fits:
            self.bins.append({"left": self.capacity, "s": 0, "c": 0})
            fits = [(self.capacity, len(self.bins) - 1)]
        _, i = min(fits)
        self.bins[i]["left"] -= size
        self.bins[i]["s"] |= source
        self.bins[i]["c"] |= cluster
        return i


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(4)
    for _ in range(30):
        fast, plain = packing.OpenBins(50), PlainBins(50)
        for _ in range(120):
            job = (rng.randint(1, 50), 1 << rng.randrange(12) if rng.random() < 0.7 else 0,
                   1 << rng.randrange(30) if rng.random() < 0.5 else 0)
            assert fast.place(*job) == plain.place(*job)


def test_packed_rows_are_whole_and_compatible(spark):
    rng = random.Random(8)
    rows = texts() + [(100 + i, sentence(rng.randint(1, 90), i // 2), rng.choice("abcdefgh") if i % 3 else "hot")
                      for i in range(150)]
    got = packing.best_fit(edge_table(spark, rows), capacity=64, group=40).collect()
    size = collections.Counter()
    for i, t, _ in rows:
        size[i] += len(words(t)) + 1
    packed, bins = collections.Counter(), collections.defaultdict(list)
    for r in got:
        packed[r.doc_id] += r["size"]
        bins[r.bin].append(r)
        assert r.start == r.piece * 64
    assert packed == size
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert held[0].offset == 0 and all(a.offset + a["size"] == b.offset for a, b in zip(held, held[1:]))
        assert held[-1].offset + held[-1]["size"] <= 64
        known = [source[r.doc_id] for r in held if source[r.doc_id]]
        assert len(known) == len(set(known))
        same = [text[r.doc_id] for r in held if text[r.doc_id]]
        assert len(same) == len(set(same))
    assert packing.best_fit(edge_table(spark, [])).collect() == []


# ---- licenses


def test_licenses(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = texts() + [(50, sentence(30, 1) + " " + notice, None), (51, gpl, None), (52, sentence(7, 2) + "\n" + gpl
                      + sentence(300, 3) + " Released under the MIT License.", None), (53, "licensed under the", None),
                      (54, "LICENSED under (the Apache License version 2.0)", None), (None, gpl, None)]
    # A notice with a word changed at its end still holds three quarters of the shingles; in the middle it does not.
    long = licenses.TEMPLATES[8][1].split()
    rows += [(55, " ".join([*long[:-1], "MET?ALL"]), None), (56, " ".join([*long[:10], "other", *long[11:]]), None)]
    docs = edge_table(spark, rows)
    got = {(r.doc_id, r.license): (r.word, round(r.share, 6)) for r in licenses.license_matches(docs).collect()}
    assert got[50, "Apache-2.0"] == (30, 1.0)
    assert set(got) == {(50, "Apache-2.0"), (51, "GPL-3.0"), (52, "GPL-3.0"), (52, "MIT"), (54, "Apache-2.0"),
                        (None, "GPL-3.0"), (55, "BSD-3-Clause")}
    assert licenses.license_matches(edge_table(spark, [])).collect() == []


def test_every_template_is_found_at_every_place(spark):
    rows = [(n * 100 + k, f"{sentence(k, 40 + k)} {text} {sentence(9, k)}", name) for n, (name, text) in
            enumerate(licenses.TEMPLATES) for k in range(1, 14)]
    got = {(r.doc_id, r.template) for r in licenses.license_matches(edge_table(spark, rows)).where("share = 1").collect()}
    assert got >= {(n * 100 + k, n) for n in range(len(licenses.TEMPLATES)) for k in range(1, 14)}


def fullest(text, notice):
    """The largest share of the notice's shingles in a window of the text, by trying every window."""
    def shingles(text):
        w = re.sub(r"[\x20\x09-\x0D.,;:!?()\[\]\"'*#>|/]+", " ", text.lower()).split()
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    held, want = shingles(text), set(shingles(notice))
    width = len(want) + len(want) // 4
    return max((len(want & set(held[i:i + width])) / len(want) for i in range(len(held))), default=0)


def test_notices_with_inserted_words_at_every_place(spark):
    rows, want = [], {}
    for n in (1, 5, 8):  # the long notices
        notice = licenses.TEMPLATES[n][1].split()
        for more in range(6):
            for before in range(7):
                doc, half = n * 100 + more * 10 + before, len(notice) // 2
                text = " ".join([sentence(before, 60 + doc), *notice[:half], *["--"] * more, *notice[half:], sentence(40, doc)])
                rows.append((doc, text, None))
                if (share := fullest(text, licenses.TEMPLATES[n][1])) >= licenses.SHARE:
                    want[doc, n] = round(share, 6)
    got = {(r.doc_id, r.template): round(r.share, 6) for r in licenses.license_matches(edge_table(spark, rows)).collect()}
    assert got == want and len(want) >= 3 * 5 * 7


# ---- URLs

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fits = [(len(r), r, v) for v, r in RULES for h, p in [(r.partition("/")[0], "/" + r.partition("/")[2])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_trees(spark):
    given = [None, "", "no scheme", "http://", "http://WWW.Example.com/en/1?a=b", "https://a.example.com/en/x#y",
             "http://notexample.com/en/", "http://example.com", "http://x.net/es/?q", "ftp://a://b/c", "http://É.com/ü",
             "http://host?x/en/", "http://x.net/ES/1", "http://examplexcom/en/"]
    docs = spark.createDataFrame([(i, u, "p", "v", 1.0) for i, u in enumerate(given)] + [(None, given[4], "p", "v", 1.0)] * 2,
                                 "page_id long, url string, path string, verdict string, score double")
    got = urls.judge(docs, RULES, urls.train([], [], [])).collect()
    assert len(got) == len(given) + 2
    for r in got:
        host, path = parts(given[r.page_id] if r.page_id is not None else given[4])
        rule, verdict = ruled(host, path)
        assert (r.host, r.path, r["rule"], r.verdict) == (host, path, rule, verdict or "allow")
    assert urls.judge(docs.limit(0), RULES, urls.train([], [], [])).collect() == []


def plain_words(url, host, path):
    """The lexical features one by one."""
    def entropy(text):
        return -sum(c / len(text) * math.log2(c / len(text)) for c in collections.Counter(text).values()) if text else 0.0

    def digits(text):
        return sum(c in "0123456789" for c in text)
    labels, query = host.split("."), url.partition("#")[0].partition("?")[2]
    return [len(url), len(host), len(path), sum(1 for x in path.split("/") if x), digits(url) / max(1, len(url)), digits(host), entropy(url),
            entropy(host), sum(1 for x in query.split("&") if x), len(labels), max(map(len, labels)), host.count("-"), path.count("."), int("#" in url)]


def plain_keys(host):
    return [f"{k}:" + ".".join(host.split(".")[-k:]) for k in (1, 2, 3)]


def test_features_are_what_they_say(spark):
    given = [None, "", "x", "http://", "http://WWW.Ex-ample.com/en//1.html?a=b&&c#d?e", "ftp://a://b/c", "http://É.com/ü☃", "//é?x#",
             "http://9.9/?a&b&c", "http://h" + "a" * 3000]
    docs = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    for r in urls._described(docs, "url", urls.F.col("page_id")).withColumns(
            {"w": urls.lexical(urls.F.col("url"), urls.F.col("host"), urls.F.col("path")), "k": urls.suffixes(urls.F.col("host"))}).collect():
        assert r["w"] == pytest.approx(plain_words(given[r.page_id] or "", r.host, r.path), abs=1e-9), given[r.page_id]
        assert r["k"] == plain_keys(r.host)


def spam_sample(rng, n):
    rows, labels = [], []
    for _ in range(n):
        spam = rng.random() < 0.4
        name = "".join(rng.choice("abcdefgh0123456789" if spam else "abcdefgh") for _ in range(rng.randint(6, 14)))
        url = f"http://{name}.example/{'/'.join('x' * rng.randint(1, 4))}?{'&'.join('a=1' for _ in range(rng.randint(0, 5 if spam else 2)))}"
        rows.append((url, *parts(url)))
        labels.append(int(spam))
    return [plain_words(*r) for r in rows], [plain_keys(r[1]) for r in rows], labels


def test_trees_learn_lexical_patterns():
    rng = random.Random(3)
    model = urls.train(*spam_sample(rng, 1500))
    words, keys, labels = spam_sample(rng, 500)
    scores = model.scores(np.array(words), keys)
    assert ((scores >= model.threshold) == np.array(labels)).mean() > 0.93
    assert urls.train(words[:3], keys[:3], [1, 1, 1]).scores(np.array(words[:2]), keys[:2]).min() > 0.99


def test_trees_judge_hosts_of_a_rule_that_they_never_saw():
    """Labels come from rules by host; what tells them apart is in the words, and one rule is held out whole."""
    rng = random.Random(5)
    words, keys, labels, rules = [], [], [], []
    for rule in range(6):
        for _ in range(200):
            bad = rule % 2
            host = "".join(rng.choice("abcd012" if bad else "abcd") for _ in range(9)) + f".site{rule}.c{rule}"
            url = f"http://{host}/{'y' * rng.randint(1, 5)}"
            words.append(plain_words(url, host, parts(url)[1]))
            keys.append(plain_keys(host))
            labels.append(bad)
            rules.append(f"c{rule}/")
    for out in (2, 3):
        kept = [i for i, r in enumerate(rules) if r != f"c{out}/"]
        model = urls.train([words[i] for i in kept], [keys[i] for i in kept], [labels[i] for i in kept], [rules[i] for i in kept])
        rest = [i for i in range(len(rules)) if i not in set(kept)]
        scores = model.scores(np.array([words[i] for i in rest]), [keys[i] for i in rest])
        assert ((scores >= model.threshold) == np.array([labels[i] for i in rest])).mean() > 0.9


def plain_tree(x, g, h, edges, depth=0):
    """Every feature and cut tried in turn."""
    best, found = 1e-6, None
    for f in range(x.shape[1]) if depth < urls.DEPTH else ():
        for cut in edges[f]:
            left = x[:, f] <= cut
            if h[left].sum() >= 1 and h[~left].sum() >= 1:
                gain = g[left].sum()**2 / (h[left].sum() + 1) + g[~left].sum()**2 / (h[~left].sum() + 1) - g.sum()**2 / (h.sum() + 1)
                if gain > best + 1e-9:
                    best, found = gain, (f, cut)
    if found is None:
        return lambda row: -g.sum() / (h.sum() + 1)
    left = x[:, found[0]] <= found[1]
    low, high = (plain_tree(x[m], g[m], h[m], edges, depth + 1) for m in (left, ~left))
    return lambda row: (high if row[found[0]] > found[1] else low)(row)


def test_a_tree_equals_one_that_tries_every_cut():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 9, (300, 4)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 2] > 6) | (rng.random(300) < 0.1)).astype(float)
    g, h = 0.4 - y, np.full(300, 0.24)
    edges = [np.unique(x[:, f])[:-1] for f in range(4)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    tree, plain = urls._tree(x, binned, edges, g, h), plain_tree(x, g, h, edges)
    got = urls.Trees(0.0, trees=[tree]).margin(x) / urls.RATE
    assert got == pytest.approx([plain(row) for row in x])


# ---- pieces


@needs_model
def test_ids_that_are_no_pieces_stand_for_nothing(spark):
    whole = pieces.encode(edge_table(spark, [(1, "one two", "a")]), MODEL, dropout=0.0).first()["pieces"]
    rows = [(1, whole), (2, [-1, *whole, 10**6, None]), (3, [None]), (4, None), (5, []), (None, whole)]
    got = pieces.decode(spark.createDataFrame(rows, "doc_id long, pieces array<int>"), MODEL).collect()
    assert {r.doc_id: r.text for r in got} == {1: "one two", 2: "one two", 3: "", 4: "", 5: "", None: "one two"}


@needs_model
def test_pieces_match_the_library_and_decode(spark):
    from sentencepiece import SentencePieceProcessor

    model, vocabulary = SentencePieceProcessor(model_file=MODEL), pieces.Vocabulary.read(MODEL)
    given = [t for _, t, _ in texts()] + ["  a  b\n c ", "x" * 90 + " " * 70 + "end", "▁▁ ▁a", "tab\there", "ééé" * 30]
    plain, bounds = pieces.encode_batch(vocabulary, pa.array(given, pa.string()), 0, 0.0)
    for text, a, b in zip(given, bounds[:-1], bounds[1:]):
        if "▁" not in (text or ""):
            assert plain[a:b].tolist() == model.encode(text or "")
    docs = edge_table(spark, [(i, t, None) for i, t in enumerate(given)])
    seen = set()
    for seed in range(3):
        encoded = pieces.encode(docs, MODEL, seed=seed, dropout=0.3)
        decoded = {r.doc_id: r.text for r in pieces.decode(encoded, MODEL).collect()}
        assert decoded == {i: t or "" for i, t in enumerate(given)}
        cut, again = (tuple(tuple(r.pieces) for r in encoded.orderBy("doc_id").collect()) for _ in range(2))
        assert cut == again
        seen.add(cut)
    assert len(seen) == 3
    done = pieces.round_trip(docs, MODEL, seed=1).collect()
    assert len(done) == len(given) and all(r.lossless for r in done)
    assert pieces.round_trip(edge_table(spark, []), MODEL).collect() == []


@needs_model
def test_long_chunks_are_cut_like_short_ones(monkeypatch):
    vocabulary = pieces.Vocabulary.read(MODEL)
    column = pa.array([sentence(300, 4) + " internationalisation" * 5])
    for rate in (0.0, 0.4):
        beside, at = pieces.encode_batch(vocabulary, column, 5, rate)
        ids, bounds = pieces._points(column)
        monkeypatch.setattr(pieces, "MATRIX", 12)
        alone, _ = pieces.encode_batch(vocabulary, column, 5, rate)
        monkeypatch.undo()
        assert beside.tolist() == alone.tolist()


@needs_model
def test_every_occurrence_of_a_word_is_cut_by_itself(spark):
    texts_of = pieces.Vocabulary.read(MODEL).texts
    word = "internationalisation"
    rows = [(0, f"{word} " * 300, None), (1, word, None), (1, word, None)]
    rows += [(i, word, None) for i in range(2, 300)] + [(i, f"{word} of {word} {i}", None) for i in range(300, 600)]
    got = collections.defaultdict(list)
    for r in pieces.encode(edge_table(spark, rows), MODEL, seed=1, dropout=0.3).collect():
        words = []
        for piece in r.pieces:
            words.append([]) if texts_of[piece].startswith(b" ") or not words else None
            words[-1].append(piece)
        got[r.doc_id].append(tuple(map(tuple, words)))
    assert len(set(got[0][0])) > 20  # within a text
    assert len({got[i][0] for i in range(1, 300)}) > 20  # over texts of nothing else
    assert len({got[i][0][:3] for i in range(300, 600)}) > 100  # texts that agree in their first words
    assert got[1][0] == got[1][1]


# ---- token counts


def greedy(word, starts, continuations):
    n, i, known = 0, 0, starts
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in known), None)
        if j is None:
            return 0
        n, i, known = n + 1, j, continuations
    return n


def test_automaton_counts_like_greedy_matching():
    rng = random.Random(2)
    for _ in range(150):
        starts, rest = ({"".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))} for _ in "ab")
        automaton = tokencount.Automaton(sorted(starts), sorted(rest))
        for _ in range(60):
            word = "".join(rng.choices("abcd", weights=(5, 5, 5, 1), k=rng.randint(0, 9)))
            assert automaton.count(word) == greedy(word, starts, rest)


@needs_model
def test_token_counts(spark):
    starts, rest = tokencount.vocabulary(MODEL)
    got = tokencount.token_counts(edge_table(spark), starts, rest).collect()
    want = []
    for i, text, _ in texts():
        counts = [greedy(w, set(starts), set(rest)) if len(w) < 1000 else None
                  for w in words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
        automaton = tokencount.Automaton(starts, rest)
        counts = [automaton.count(words(text)[k]) if c is None else c for k, c in enumerate(counts)]
        want.append((i, len(counts), sum(max(1, c) for c in counts), counts.count(0)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert tokencount.token_counts(edge_table(spark, []), starts, rest).collect() == []


# ---- top-k


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 1, 6), 1)], 0) for i in range(300)]
    rows += [(300 + i, [1.0] * 6, 0) for i in range(200)]  # ties
    rows += [(1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1002, [float("nan")] * 6, 1),
             (1003, [float("inf")] * 6, 1), (1050, [0.5, 0.25], 1), (1051, [1.0, 1.0], 1), (1100, [], 1), (None, [1.0] * 6, 1),
             (1150, [1e6] * 6, 1), (0, rows[0][1], 0)]
    docs = spark.createDataFrame([(*r, 7, 8.0) for r in rows], "vec_id long, embedding array<float>, label int, rank int, score double")
    scaled = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q, v in scaled.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w)), i) for i, w in scaled.items() if i != q and len(w) == len(v)]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:5], 1)]
    got = [tuple(r) for r in topk.top_k(docs, block=64).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(docs.limit(0)).collect() == []


def test_candidate_blocks_are_dealt_over_all_copies(spark):
    held = spark.range(0, 64, 1, 64).selectExpr("id AS vec_id", "array(id, id + 1) AS v")  # a block in each partition
    dealt = collections.Counter(r.copy for r in topk._dealt(held, 64, 8).select("copy").collect())
    assert sum(dealt.values()) == 64 and set(dealt) == set(range(8)) and max(dealt.values()) < 24


# ---- shards


@pytest.mark.parametrize("shards", [1, 16])
def test_byte_shards(spark, shards):
    rng = random.Random(5)
    rows = texts() + [(100 + i, "y" * rng.randint(0, 400), None) for i in range(400)]
    rows += [(7000, "same", None)] * 30
    got = sharding.byte_shards(edge_table(spark, rows), shards).collect()
    want = sorted((((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)),
                  key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) <= set(range(shards)) and all(r.law == "bytes" and r.grown_shard is None for r in got)
    share, most = sum(r["size"] for r in got) / shards, max(r["size"] for r in got)
    order = []
    for shard in sorted(by):
        held = sorted(by[shard], key=lambda r: r.slot)
        assert [r.slot for r in held] == list(range(len(held)))
        assert abs(sum(r["size"] for r in held) - share) <= most
        order += [-1 if r.doc_id is None else r.doc_id for r in held]
    assert order == sorted(order)
    assert sharding.byte_shards(edge_table(spark, [])).collect() == []
