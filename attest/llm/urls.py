"""URL filter: allow and block rules, and gradient-boosted trees on lexical features for what no rule covers.

Host, path, rules and lexical features are DataFrame expressions. The trees are trained on the driver from a bounded
sample of labelled URLs (logistic loss, histogram splits in numpy) and score batches of URLs inside tasks. Where rules
made the labels, trees train on one half of the rules with the suffix statistics of the other half and the other way
round, and the threshold comes from rules that the scoring trees had not seen: they have to judge hosts that no rule covers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Labelled URLs that the trees are trained on.
SAMPLE = 20_000
TREES, DEPTH, RATE, CUTS, SMOOTH = 60, 3, 0.2, 32, 8.0
#: Parts of the groups that are held out in turn for the threshold.
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null if none does.

    A rule ``host/path`` fits its host and subdomains when the path starts with ``/path``. Of two rules of equal
    length the one that sorts first wins.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _entropy(text: Column) -> Column:
    """Bits of a character of the text; 0 for an empty one."""
    n = F.length(text)
    letters = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(1))))
    def times(letter: Column) -> Column:
        return (n - F.length(F.replace(text, letter, F.lit("")))).cast("double")
    return F.when(n > 0, F.log2(n) - F.aggregate(letters, F.lit(0.0), lambda sum_, x: sum_ + times(x) * F.log2(times(x))) / n).otherwise(0.0)


LEXICAL = ["length", "host_length", "path_length", "depth", "digit_ratio", "host_digits", "entropy", "host_entropy", "parameters",
           "labels", "longest_label", "hyphens", "path_dots", "fragment"]


def lexical(url: Column, host: Column, path: Column) -> Column:
    """Length, depth, digit ratio, entropy and counts, as an array in the order of ``LEXICAL``."""
    def count(text: Column, kept: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{kept}]", ""))
    def parts(text: Column, by: str) -> Column:
        return F.size(F.filter(F.split(text, by), lambda x: x != ""))
    labels = F.split(host, r"\.")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    values = [F.length(url), F.length(host), F.length(path), parts(path, "/"), count(url, "0-9") / F.greatest(F.lit(1), F.length(url)),
              count(host, "0-9"), _entropy(url), _entropy(host), parts(query, "&"), F.size(labels),
              F.array_max(F.transform(labels, F.length)), count(host, "-"), count(path, "."), F.instr(url, "#") > 0]
    return F.array(*[v.cast("double") for v in values])


def suffixes(host: Column) -> Column:
    """What block rates are kept for: the host's last one, two and three labels."""
    return F.array(*[F.concat(F.lit(f"{k}:"), F.substring_index(host, ".", -k)) for k in (1, 2, 3)])


FEATURES = len(LEXICAL) + 3


@dataclass
class Trees:
    """Boosted trees over lexical features and suffix statistics; ``prior`` alone without two classes to learn from."""

    prior: float = -1.0
    rates: dict[str, tuple[int, int]] = field(default_factory=dict)
    base: float = 0.0
    trees: list[list[tuple[int, float, float]]] = field(default_factory=list)  # heap order: (feature or -1, cut, value)

    def features(self, words: np.ndarray, keys: list[Sequence[str]]) -> np.ndarray:
        """Lexical features with the block rate of each suffix; a suffix that was not seen has the base rate."""
        out = np.empty((len(keys), FEATURES))
        out[:, :len(LEXICAL)] = words
        for i, own in enumerate(keys):
            for j, key in enumerate(own):
                hits, n = self.rates.get(key, (0, 0))
                out[i, len(LEXICAL) + j] = (hits + SMOOTH * self.base) / (n + SMOOTH)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        for tree in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            features, cuts, values = (np.array(part) for part in zip(*tree))
            for _ in range(DEPTH):
                inner = features[at] >= 0
                right = x[np.arange(len(x)), np.maximum(features[at], 0)] > cuts[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += RATE * values[at]
        return total

    def scores(self, words: np.ndarray, keys: list[Sequence[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(self.features(words, keys)))) if len(keys) else np.zeros(0)


@dataclass
class Filter:
    """Two sets of trees, each trained on one half of the groups with the suffix statistics of the other."""

    halves: list[Trees]
    threshold: float = 0.5

    def scores(self, words: np.ndarray, keys: list[Sequence[str]]) -> np.ndarray:
        told = [half for half in self.halves if half.trees] or self.halves
        return np.mean([half.scores(words, keys) for half in told], axis=0)


def _counted(keys: list[Sequence[str]], blocked: np.ndarray) -> dict[str, tuple[int, int]]:
    out: dict[str, tuple[int, int]] = {}
    for own, label in zip(keys, blocked.tolist()):
        for key in own:
            hits, n = out.get(key, (0, 0))
            out[key] = hits + label, n + 1
    return out


def _tree(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray):
    """One tree on gradients, as nodes in heap order."""
    nodes = [(-1, 0.0, 0.0)] * (2 ** (DEPTH + 1) - 1)

    def split(node: int, rows: np.ndarray, depth: int) -> None:
        gs, hs = g[rows].sum(), h[rows].sum()
        best, found = 1e-6, None
        if depth < DEPTH:
            for f, edges in enumerate(cuts):
                if len(edges):
                    gl = np.cumsum(np.bincount(binned[rows, f], g[rows], len(edges) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, f], h[rows], len(edges) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl)**2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < 1) | (hs - hl < 1)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, found = gain[k], (f, edges[k])
        if found is None:
            nodes[node] = (-1, 0.0, -gs / (hs + 1))
            return
        nodes[node] = (found[0], float(found[1]), 0.0)
        right = x[rows, found[0]] > found[1]
        split(2 * node + 1, rows[~right], depth + 1)
        split(2 * node + 2, rows[right], depth + 1)

    split(0, np.arange(len(x)), 0)
    return nodes


def _boosted(words: np.ndarray, keys: list[Sequence[str]], y: np.ndarray, rates: dict[str, tuple[int, int]], base: float) -> Trees:
    model = Trees(rates=rates, base=base)
    if not len(y):
        return model
    share = float(y.mean())
    if share in (0.0, 1.0):
        model.prior = 8.0 if share else -8.0
        return model
    model.prior = math.log(share / (1 - share))
    x = model.features(words, keys)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    margin = np.full(len(x), model.prior)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree = _tree(x, binned, cuts, p - y, p * (1 - p))
        model.trees.append(tree)
        margin = margin + Trees(0.0, trees=[tree]).margin(x)
    return model


def _both_halves(words: np.ndarray, keys: list[Sequence[str]], y: np.ndarray, groups: np.ndarray) -> Filter:
    """Rows that are trained on see the statistics of the other half of the groups, all of them the same ones: what a
    row's features hold of labels never comes from its own group, and does not tell which group it is of."""
    order = {g: i for i, g in enumerate(np.unique(groups).tolist())}
    half = np.array([order[g] % 2 for g in groups.tolist()], dtype=np.int64)
    out = []
    for own in (0, 1):
        mine, other = np.flatnonzero(half == own), np.flatnonzero(half != own)
        rates = _counted([keys[i] for i in other], y[other])
        out.append(_boosted(words[mine], [keys[i] for i in mine], y[mine], rates, float(y[other].mean()) if len(other) else 0.0))
    return Filter([part for part, own in zip(out, (0, 1)) if (half == own).any()] or out[:1])


def _best_cut(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest mean of both classes' shares that fall right; 0.5 if there is one class only."""
    if not len(y) or y.all() or not y.any():
        return 0.5
    order = np.argsort(scores, kind="stable")
    s, label = scores[order], y[order]
    right = (np.append(0, np.cumsum(label == 0)) / (y == 0).sum() + np.append(label.sum(), label.sum() - np.cumsum(label)) / y.sum()) / 2
    edges = np.concatenate([[s[0] - 1e-9], (s[1:] + s[:-1]) / 2, [s[-1] + 1e-9]])
    right[1:-1][s[1:] == s[:-1]] = -1  # equal scores are not parted
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best] - 0.5))]])


def train(words: np.ndarray, keys: list[Sequence[str]], blocked: Sequence[int], groups: Sequence[object] | None = None) -> Filter:
    """Fit to lexical features, suffixes and 0/1 labels; with fewer than two classes the verdict is the class there is.

    ``groups`` says which rows share what made their label (a rule); without it each row is a group. The threshold is
    the best cut of scores from trees that had never seen the row's group, over ``FOLDS`` parts of the groups.
    """
    y = np.array(blocked, dtype=np.int64)
    words = np.asarray(words, dtype=np.float64).reshape(len(y), len(LEXICAL))
    names = {g: i for i, g in enumerate(sorted(set(map(str, groups))))} if groups is not None else {}
    group = np.array([names[str(g)] for g in groups], dtype=np.int64) if groups is not None else np.arange(len(y))
    model = _both_halves(words, keys, y, group)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for fold in range(FOLDS):
        out = group % FOLDS == fold
        if out.any() and 0 < y[~out].sum() < (~out).sum():
            other = _both_halves(words[~out], [k for k, o in zip(keys, out) if not o], y[~out], group[~out])
            held.append((other.scores(words[out], [k for k, o in zip(keys, out) if o]), y[out]))
    if held:
        model.threshold = _best_cut(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
    return model


def _described(urls: DataFrame, url_col: str, *kept: Column) -> DataFrame:
    url = F.col(url_col).cast("string")
    return urls.select(*kept, F.coalesce(url, F.lit("")).alias("url"), F.coalesce(host_of(url), F.lit("")).alias("host"),
                       F.coalesce(path_of(url), F.lit("")).alias("path"))


def fit(urls: DataFrame, labels: Column, groups: Column | None = None, id_col: str = "page_id", url_col: str = "url",
        sample: int = SAMPLE) -> Filter:
    """Train on ``sample`` rows whose ``labels`` (1: block) isn't null, the first in order of a hash of the id."""
    rows = (_described(urls, url_col, labels.cast("int").alias("label"), (F.lit(None) if groups is None else groups).cast("string").alias("grp"),
                       F.xxhash64(id_col, url_col).alias("turn"))
            .where("label is not null").orderBy("turn", "url").limit(sample)
            .select("label", "grp", lexical(F.col("url"), F.col("host"), F.col("path")).alias("words"), suffixes(F.col("host")).alias("keys"))
            .collect())
    return train(np.array([r["words"] for r in rows]), [r["keys"] for r in rows], [r["label"] for r in rows],
                 None if groups is None else [r["grp"] for r in rows])


def judge(urls: DataFrame, rules: Sequence[tuple[str, str]], model: Filter, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every row; the rule's verdict, else the trees'.

    Only rows without a rule are scored; the others' score is null. A null URL or one without ``://`` has an empty host and
    path, fits no rule, and gets the trees' verdict for an empty URL. Repeated rows are judged alike. An empty table gives
    no rows; other columns are not read.
    """
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    rows = _described(urls, url_col, F.col(id_col).alias("page_id")).withColumn("_rule", rule_for(rules, host, path))
    rows = rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"),
                       F.when(F.col("_rule").isNull(), lexical(url, host, path)).alias("words"),
                       F.when(F.col("_rule").isNull(), suffixes(host)).alias("keys"))
    shared = urls.sparkSession.sparkContext.broadcast(model)  # trees, and the suffixes of the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = pa.compute.is_valid(batch.column("words"))
            words, keys = batch.column("words").filter(asked), batch.column("keys").filter(asked)
            found = shared.value.scores(words.flatten().to_numpy(zero_copy_only=False).reshape(len(words), len(LEXICAL)), keys.to_pylist())
            scores = np.full(batch.num_rows, np.nan)
            scores[asked.to_numpy(zero_copy_only=False)] = found
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in ("page_id", "host", "path", "rule", "ruled")),
                 pa.array(scores, mask=~asked.to_numpy(zero_copy_only=False))], ["page_id", "host", "path", "rule", "ruled", "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"page_id {kind}, host string, path string, rule string, ruled string, score double")
    learned = F.when(F.col("score") >= model.threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
