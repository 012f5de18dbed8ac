"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of three rows of one table, found by hashes of the word and of its first four and six
bytes, so that unseen inflections share what was learned. Filters of widths 1 to 3 run over the whole text, the
greatest answer of each filter goes through a logistic layer. Gradients reach only the windows that won the maximum.
Thresholds are calibrated on held-out rows for each language; which language a text is in is guessed from its words
by naive Bayes, so a score depends on the text alone. Scores are shifted so that 0.5 is the language's threshold.

Every labelled row has a part in it. A first group of rows, of both labels alike, trains a network; then all other rows,
in groups of about ``GROUP`` that tasks work on side by side, each train a copy of it, and what the copies learned is
averaged. Languages are counted over all rows, thresholds over every row that was held out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import WIDE_SLICE_BYTES, hash_words, sliced, written

PREFIXES = (4, 6)
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
#: Rows of each label in the first group, and of all labels in each later one, as far as hashes of the id deal them evenly.
FIRST, GROUP = 2048, 8192
#: Passes over the first group and over the later ones.
EPOCHS, LATER_EPOCHS, BATCH, RATE = 10, 2, 32, 0.1
#: Words that are trained on at a time, in one pass after the other, and in one step; a larger text is worked on alone.
BLOCK_WORDS, STEP_WORDS = 1 << 22, 1 << 17
#: What a row of a rare label counts at most; margins are told apart to this part of one.
MOST_WEIGHT, FINE = 16.0, 256
#: Buckets of the language guess.
GUESS = 1 << 13
#: Rows of each label that a language's threshold takes, and rows that a language takes to be guessed at all.
LEAST_CALIBRATED, LEAST_LANGUAGE = 8, 16
_GAP = max(WIDTHS)


def buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(3, words) rows of the embedding table for a batch of texts, and the bounds of each text."""
    hashes, bounds = hash_words(column, PREFIXES)
    return np.stack([(h >> np.uint64(48)).astype(np.int32) for h in hashes]), bounds


@dataclass
class Network:
    table: np.ndarray  # one more row, of zeros, stands for the gap between texts
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    languages: list[str] = field(default_factory=list)
    guess: np.ndarray | None = None
    thresholds: np.ndarray | None = None

    @staticmethod
    def start(seed: int) -> "Network":
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
        table[-1] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Network(table, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32),
                       rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)

    def parameters(self) -> np.ndarray:
        """All of them as rows of ``DIM``, the table's first."""
        rest = np.concatenate([*(w.ravel() for w in self.filters), self.bias, self.weights, [self.offset]])
        return np.concatenate([self.table, np.resize(np.append(rest, np.zeros(-len(rest) % DIM)), (-(-len(rest) // DIM), DIM))])

    def moved(self, by: np.ndarray) -> None:
        """Add to all parameters, given as ``parameters`` gives them."""
        self.table += by[:BUCKETS + 1].astype(np.float32)
        self.table[-1] = 0
        rest, at = by[BUCKETS + 1:].ravel(), 0
        for p in (*self.filters, self.bias, self.weights):
            p += rest[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        self.offset += float(rest[at])

    def spaced(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words with a gap after each text, and where texts begin."""
        texts = len(bounds) - 1
        out = np.full((3, words.shape[1] + _GAP * (texts + 1)), BUCKETS, dtype=np.int32)
        out[:, np.arange(words.shape[1]) + _GAP * np.repeat(np.arange(texts), np.diff(bounds))] = words
        return out, bounds[:-1] + _GAP * np.arange(texts)

    def answers(self, x: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Every filter at every place. ``ends``: behind each text's words; one window of nothing follows, and those
        that begin later in the gap, and would reach the next text, never win."""
        n = len(x) - _GAP + 1
        out = np.concatenate([sum(x[k:k + n] @ w[k] for k in range(len(w))) for w in self.filters], axis=1) + self.bias
        for late in range(1, _GAP):
            out[ends + late] = -np.inf
        return out

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[0]] + self.table[rows[1]] + self.table[rows[2]]

    def logits(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if len(bounds) < 2:
            return np.zeros(0)
        rows, starts = self.spaced(words, bounds)
        answers = self.answers(self.embed(rows), starts + np.diff(bounds))
        pooled = np.maximum.reduceat(answers, starts, axis=0)
        return np.maximum(pooled, 0) @ self.weights + self.offset

    def language(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Number of each text's likeliest language; texts without words get the first."""
        if self.guess is None or len(bounds) < 2:
            return np.zeros(max(0, len(bounds) - 1), dtype=np.int64)
        told = np.concatenate([self.guess[words[0] >> 3], np.zeros((1, len(self.languages)), np.float32)])
        sums = np.add.reduceat(told, bounds[:-1], axis=0)
        sums[np.diff(bounds) == 0] = 0
        return sums.argmax(axis=1)

    def scores(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        margin = self.logits(words, bounds)
        if self.thresholds is not None and len(margin):
            margin = margin - self.thresholds[self.language(words, bounds)]
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -500, 500)))


def _joined(samples: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([s.shape[1] for s in samples])])
    return np.concatenate([*samples, np.zeros((3, 0), np.int32)], axis=1), bounds


@dataclass
class Steps:
    """What Adagrad has seen of each parameter, and how often each row of the table was moved."""

    parts: list[np.ndarray]
    rows: np.ndarray
    offset: float
    touched: np.ndarray

    @staticmethod
    def start(net: Network) -> "Steps":
        return Steps([np.full(p.shape, 1e-3, np.float32) for p in (*net.filters, net.bias, net.weights)],
                     np.full(BUCKETS + 1, 1e-3, np.float32), 1e-3, np.zeros(BUCKETS + 1, np.int64))


def _batches(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most ``BATCH`` texts and ``STEP_WORDS`` words, or of one text."""
    at = 0
    while at < len(order):
        held = np.cumsum(sizes[order[at:at + BATCH]])
        stop = at + max(1, int(np.searchsorted(held, STEP_WORDS, side="right")))
        yield order[at:stop]
        at = stop


def _train(net: Network, samples: list[np.ndarray], labels: np.ndarray, seed: int, steps: Steps | None = None,
           epochs: int = EPOCHS, weights: tuple[float, float] = (1.0, 1.0)) -> Steps:
    """Adagrad over mini-batches; ``weights`` is what a row of label 0 and of label 1 counts."""
    rng = np.random.default_rng(seed)
    steps, total = steps or Steps.start(net), len(WIDTHS) * FILTERS
    counted, sizes = np.array(weights, np.float32), np.array([s.shape[1] for s in samples])

    def step(number: int, p: np.ndarray, gradient: np.ndarray) -> None:
        held = steps.parts[number]
        held += gradient**2
        p -= RATE * gradient / np.sqrt(held)

    for _ in range(epochs):
        for chosen in _batches(rng.permutation(len(samples)), sizes):
            words, bounds = _joined([samples[i] for i in chosen])
            rows, starts = net.spaced(words, bounds)
            x = net.embed(rows)
            answers = net.answers(x, starts + np.diff(bounds))
            best = np.maximum.reduceat(answers, starts, axis=0)
            pooled = np.maximum(best, 0)
            error = (1 / (1 + np.exp(-(pooled @ net.weights + net.offset))) - labels[chosen]) / len(chosen)
            error *= counted[labels[chosen].astype(int)]
            back = error[:, None] * net.weights * (best > 0)
            step(len(WIDTHS) + 1, net.weights, pooled.T @ error)
            steps.offset += error.sum()**2
            net.offset -= RATE * error.sum() / np.sqrt(steps.offset)
            step(len(WIDTHS), net.bias, back.sum(axis=0))
            text = np.repeat(np.arange(len(chosen)), np.diff(np.append(starts, len(answers))))
            where, which = np.nonzero(answers == best[text])
            _, first = np.unique(text[where] * total + which, return_index=True)
            where, which = where[first], which[first]
            told = back[text[where], which]
            felt_rows, felt = [], []
            for number, (width, w) in enumerate(zip(WIDTHS, net.filters)):
                mine = (which // FILTERS == number) & (told != 0)
                at_row, f, g = where[mine], which[mine] % FILTERS, told[mine]
                gradient = np.zeros_like(w)
                for k in range(width):
                    np.add.at(gradient[k].T, f, g[:, None] * x[at_row + k])
                    felt_rows.append(rows[:, at_row + k])
                    felt.append(g[:, None] * w[k][:, f].T)
                step(number, w, gradient)
            touched, place = np.unique(np.concatenate(felt_rows, axis=1), return_inverse=True)
            gradient = np.zeros((len(touched), DIM), np.float32)
            np.add.at(gradient, place.reshape(3, -1), np.concatenate(felt)[None])
            steps.rows[touched] += (gradient**2).mean(axis=1)
            steps.touched[touched] += 1
            net.table[touched] -= RATE * gradient / np.sqrt(steps.rows[touched])[:, None]
            net.table[-1] = 0
    return steps


def _threshold(margin: np.ndarray, labels: np.ndarray, weight: float, rows: np.ndarray | None = None) -> float:
    """The middle of the widest gap with the fewest errors; ``weight`` is what a clean row counts, ``rows`` how many
    rows each margin stands for."""
    order = np.argsort(margin, kind="stable")
    m, y = margin[order], labels[order]
    n = np.ones(len(m)) if rows is None else rows[order]
    toxic, clean = n * y, n * (y == 0)
    # Errors with the cut above the first k margins: toxic rows below and clean rows above it.
    errors = np.concatenate([[0], np.cumsum(toxic)]) + weight * (clean.sum() - np.concatenate([[0], np.cumsum(clean)]))
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    errors[edges[1:] == edges[:-1]] = np.inf  # no cut goes between equal margins
    least = np.flatnonzero(errors <= errors.min() + 1e-9)
    k = least[np.argmax((edges[1:] - edges[:-1])[least])]
    return float((edges[k] + edges[k + 1]) / 2)


def _calibrate(net: Network, margin: np.ndarray, labels: np.ndarray, guessed: np.ndarray, rows: np.ndarray,
               weight: float = 1.0) -> None:
    """Thresholds from held-out rows; ``rows`` is how many of them each margin, label and guess stands for."""
    if not len(labels) or labels.min() == labels.max():
        return
    net.thresholds = np.full(max(1, len(net.languages)), _threshold(margin, labels, weight, rows))
    for number in range(len(net.languages)):
        mine = guessed == number
        if min(rows[mine & (labels == 1)].sum(), rows[mine & (labels == 0)].sum()) >= LEAST_CALIBRATED:
            net.thresholds[number] = _threshold(margin[mine], labels[mine], weight, rows[mine])


def _learn_languages(net: Network, counts: dict[str, np.ndarray]) -> None:
    """From how often each language has a word in each bucket of the guess."""
    names = sorted(counts)
    if len(names) < 2:
        return
    told = np.stack([counts[name] for name in names], axis=1) + 0.05
    log = np.log(told / told.sum(axis=0))
    net.languages, net.guess = names, (log - log.mean(axis=1, keepdims=True)).astype(np.float32)


def _constant(toxic: bool) -> Network:
    """Without two labels: near 0 or near 1 for every text."""
    net = Network.start(7)
    net.weights[:] = 0
    net.offset = 4.0 if toxic else -4.0
    return net


def train(samples: list[np.ndarray], labels: list[int], langs: list[str | None], weight: float = 1.0,
          seed: int = 7) -> Network:
    """From (3, words) bucket arrays in memory. A missing class gives its opposite's score: near 0 or near 1 for every text."""
    net, y = Network.start(seed), np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        return _constant(bool(len(y) and y[0]))
    held = np.arange(len(y)) % 5 == 0
    counts: dict[str, np.ndarray] = {}
    for words, name in zip(samples, langs):
        if name:
            counts[name] = counts.get(name, 0) + np.bincount(words[0] >> 3, minlength=GUESS)
    _learn_languages(net, counts)
    _train(net, [s for s, h in zip(samples, held) if not h], y[~held], seed)
    words, bounds = _joined([s for s, h in zip(samples, held) if h])
    _calibrate(net, net.logits(words, bounds), y[held], net.language(words, bounds), np.ones(int(held.sum())), weight)
    return net


# ---- training on all labelled rows ---------------------------------------------------------------


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(group, samples, labels) of at most ``BLOCK_WORDS`` words, from rows in order of group and id.

    Labels stand before the texts of their id; texts without one are passed over.
    """
    group, known, label, samples, labels, held = None, None, 0, [], [], 0
    for batch in sliced(batches, 3, WIDE_SLICE_BYTES):
        words, bounds = buckets(batch.column(3))
        of, ids, toxic = (batch.column(i).to_pylist() for i in range(3))
        for i in range(batch.num_rows):
            if toxic[i] is not None:
                known, label = (of[i], ids[i]), toxic[i]
            elif known == (of[i], ids[i]):
                if samples and (group != of[i] or held >= BLOCK_WORDS):
                    yield group, samples, np.array(labels, np.float32)
                    samples, labels, held = [], [], 0
                group, part = of[i], words[:, bounds[i]:bounds[i + 1]].copy()
                samples.append(part)
                labels.append(label)
                held += part.shape[1]
    if samples:
        yield group, samples, np.array(labels, np.float32)


def _groups(docs: DataFrame, rows: DataFrame, group: Column, groups: int) -> DataFrame:
    """Labels, and texts behind them, in order of group and id. Each text moves once, next to its label."""
    held = rows.select(group.alias("_group"), "_id", "_toxic", F.lit(None).cast("binary").alias("_text")).unionByName(
        docs.withColumn("_toxic", F.lit(None).cast("int")).select(group.alias("_group"), "_id", "_toxic", "_text"))
    return held.repartitionById(groups, F.col("_group").cast("int")).sortWithinPartitions(
        "_group", "_id", F.col("_toxic").isNull(), F.xxhash64("_text"), "_text")


def _first(docs: DataFrame, rows: DataFrame, weights: tuple[float, float]) -> tuple[Network, Steps]:
    """``rows``: about ``FIRST`` of each label, the bound of their broadcast."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, steps = Network.start(7), None
        for number, (_, samples, labels) in enumerate(_blocks(batches)):
            steps = _train(net, samples, labels, 7 + number, steps, weights=weights)
        if steps:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net, steps))], pa.binary())], ["net"])

    docs = docs.join(F.broadcast(rows.select("_id")), "_id")
    got = _groups(docs, rows, F.lit(0), 1).mapInArrow(run, "net binary").collect()  # one network
    net = Network.start(7)
    return pickle.loads(got[0]["net"]) if got else (net, Steps.start(net))


def _averaged(docs: DataFrame, rows: DataFrame, group: Column, groups: int, net: Network, steps: Steps,
              weights: tuple[float, float]) -> None:
    """Every group trains a copy of ``net``; a row of the table moves by the mean over the copies that moved it, by how
    often they did, everything else by the mean over all copies, by their texts. Sums are of integers, in any order."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((net, steps)))  # one network
    unit = float(1 << 24)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> pa.RecordBatch:
            by = mine.parameters().astype(np.float64) - before
            n = np.full(len(by), texts)
            n[:BUCKETS + 1] = seen.touched
            moved = np.flatnonzero(n)
            sums = np.rint(by[moved] * n[moved, None] * unit).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(moved, pa.int64()), pa.array(n[moved], pa.int64()), *map(pa.array, sums.T)],
                                              ["row", "n", *names])

        at, texts = None, 0
        for number, (this, samples, labels) in enumerate(_blocks(batches)):
            if this != at:
                if at is not None:
                    yield told()
                mine, seen = pickle.loads(shared.value)
                at, texts, before = this, 0, mine.parameters().astype(np.float64)
                seen.touched[:] = 0
            _train(mine, samples, labels, this + 7, seen, LATER_EPOCHS, weights)
            texts += len(samples)
        if at is not None:
            yield told()

    names = [f"v{i}" for i in range(DIM)]
    learned = (_groups(docs, rows, group, groups).mapInArrow(run, ", ".join(f"{c} long" for c in ["row", "n", *names]))
               .groupBy("row").agg(F.sum("n").cast("double").alias("n"), *[F.sum(c).cast("double").alias(c) for c in names]).toPandas())
    by = np.zeros(net.parameters().shape)
    by[learned["row"].to_numpy(np.int64)] = learned[names].to_numpy() / learned[["n"]].to_numpy() / unit
    net.moved(by)


def _languages(docs: DataFrame) -> dict[str, np.ndarray]:
    """How often the texts of each language have a word in each bucket of the guess."""
    known = docs.where(F.length("_lang") > 0)
    names = sorted(r["_lang"] for r in known.groupBy("_lang").count().where(F.col("count") >= LEAST_LANGUAGE).collect())
    if len(names) < 2:
        return {}
    number = {name: i for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(number) * GUESS, dtype=np.int64)
        for batch in sliced(batches, 1, WIDE_SLICE_BYTES):
            (hashes,), bounds = hash_words(batch.column(1))
            lang = np.array([number.get(name, -1) for name in batch.column(0).to_pylist()], dtype=np.int64)
            of = np.repeat(lang, np.diff(bounds))
            at, n = np.unique((of * GUESS + (hashes >> np.uint64(64 - 13)).astype(np.int64))[of >= 0], return_counts=True)
            counts[at] += n
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["at", "n"])

    told = known.select("_lang", "_text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(names) * GUESS)
    counts[told["at"].to_numpy(np.int64)] = told["n"].to_numpy()
    return dict(zip(names, counts.reshape(len(names), GUESS)))


def _margins(docs: DataFrame, rows: DataFrame, net: Network) -> tuple[np.ndarray, ...]:
    """Margins in steps of ``1 / FINE``, labels and guessed languages of held-out rows, and how many rows have them."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pickle.loads(shared.value)
        for batch in sliced(batches, 1, WIDE_SLICE_BYTES):
            words, bounds = buckets(batch.column(1))
            margin = np.clip(np.rint(held.logits(words, bounds) * FINE), -1 << 14, 1 << 14).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin), pa.array(held.language(words, bounds))],
                                             ["_id", "margin", "guessed"])

    kind = docs.schema["_id"].dataType.simpleString()
    told = docs.select("_id", "_text").mapInArrow(run, f"_id {kind}, margin long, guessed long")
    n = told.join(rows.select("_id", "_toxic"), "_id").groupBy("margin", "guessed", "_toxic").count().toPandas()
    return n["margin"].to_numpy() / FINE, n["_toxic"].to_numpy(), n["guessed"].to_numpy(), n["count"].to_numpy()


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic") -> Network:
    """Train on every labelled row that is ``usable`` (a condition on the id), with its whole text.

    About every fifth row, by a hash of the id, is held out for the thresholds. The driver gets counts and networks only.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    held = docs.where(F.col(id_col).isNotNull())
    if usable is not None:
        rows, held = rows.where(usable), held.where(usable)
    held = held.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"),
                       F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.groupBy(F.col(id_col).cast(held.schema["_id"].dataType).alias("_id")).agg(F.max(label_col).cast("int").alias("_toxic"))
    rows = written(rows.join(held.select("_id"), "_id", "left_semi"), "labels")  # ids and labels, read by each step
    counts = dict(rows.groupBy("_toxic").count().collect())
    if len(counts) < 2:
        return _constant(1 in counts)
    held_out = F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(5)) == 0
    mine, texts = rows.where(~held_out), held.where(~held_out)
    # How many parts of about FIRST rows each label has; a label of one part takes part in the later groups, too.
    parts = {label: max(1, round(n * 4 / 5 / FIRST)) for label, n in counts.items()}
    part = F.pmod(F.xxhash64("_id", F.lit(7)), F.when(F.col("_toxic") == 1, parts[1]).otherwise(parts[0]))
    net, steps = _first(texts, mine.where(part == 0), _weights({label: n / parts[label] for label, n in counts.items()}))
    if max(parts.values()) > 1:
        later = {label: n * (parts[label] - 1) / parts[label] if parts[label] > 1 else n for label, n in counts.items()}
        groups = max(1, round(sum(later.values()) * 4 / 5 / GROUP))
        alone = F.when(F.col("_toxic") == 1, parts[1] == 1).otherwise(parts[0] == 1)
        _averaged(texts, mine.where((part != 0) | alone), F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(groups)), groups, net,
                  steps, _weights(later))
    _learn_languages(net, _languages(held))
    _calibrate(net, *_margins(held.where(held_out), rows.where(held_out), net))
    return net


def _weights(counts: dict[int, float]) -> tuple[float, float]:
    """What makes both labels count alike, as far as ``MOST_WEIGHT``."""
    return tuple(min(MOST_WEIGHT, sum(counts.values()) / (2 * counts[label])) for label in (0, 1))


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, guessed_lang`` for every row, from the whole text alone.

    Null, empty and blank texts get the score of a text without words. Repeated rows are scored alike; a null id
    stays null. An empty table gives no rows; other columns are not read.
    """
    names = net.languages or [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1, WIDE_SLICE_BYTES):
            words, bounds = buckets(batch.column(1))
            guessed = [names[i] for i in net.language(words, bounds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(net.scores(words, bounds), pa.float64()), pa.array(guessed, pa.string())],
                ["doc_id", "score", "guessed_lang"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, guessed_lang string").select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "guessed_lang")


def clean(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all their columns.

    Null, empty and blank texts have no words and get the score of no words, as ``score`` gives it. Repeated rows go or stay
    together. An empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at, WIDE_SLICE_BYTES):
            words, bounds = buckets(batch.column(at))
            yield batch.filter(pa.array(net.scores(words, bounds) < 0.5))

    return docs.mapInArrow(run, docs.schema)
