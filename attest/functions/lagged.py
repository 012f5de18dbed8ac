"""Lagged correlation of one pair of series and of its rotated surrogates, in numpy."""

from __future__ import annotations

import numpy as np


_FLAT = 1e-12
#: Scores that are nearer than this differ by rounding only and count as equal.
_SAME = 1e-9
#: Values of the shifted series that are laid out at a time.
_CELLS = 1 << 18


def centred(x: np.ndarray) -> np.ndarray:
    """Less its mean; exactly zero if what is left is only rounding."""
    x = np.asarray(x, float)
    out = x - x.mean()
    return out if np.abs(out).max(initial=0.0) > _FLAT * np.abs(x).max(initial=0.0) else np.zeros_like(x)


def _best(a: np.ndarray, b: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """For each lag limit 1..max_lag: the best |corr(a[t], b[t + lag])| up to it and its lag.

    ``a`` may be a matrix with one series per row; ties go to the smaller lag. Lags are worked on in blocks, each of which
    meets all rows in one product.
    """
    rows = np.atleast_2d(a)
    n = rows.shape[1]
    # A stretch is flat when it varies by next to nothing of what the whole series does, whatever the unit.
    least = _FLAT * np.sqrt((rows * rows).mean(axis=1) * (b * b).mean())[:, None]
    sums, squares = np.cumsum(rows, axis=1), np.cumsum(rows * rows, axis=1)
    scores = np.zeros((len(rows), max_lag))
    last, block = min(max_lag, n - 2), max(1, _CELLS // max(1, n))
    for first in range(1, last + 1, block):
        lags = np.arange(first, min(first + block - 1, last) + 1)
        m = n - lags
        at = np.arange(n)[:, None] + lags
        inside = at < n
        tail = np.where(inside, b[np.minimum(at, n - 1)], 0.0)
        level = np.where(inside, tail - tail.sum(axis=0) / m, 0.0)
        var_a = squares[:, m - 1] / m - (sums[:, m - 1] / m) ** 2
        var_b = np.einsum("ij,ij->j", level, level) / m
        scale = np.sqrt(np.clip(var_a, 0, None) * var_b)
        with np.errstate(invalid="ignore", divide="ignore"):
            scores[:, lags - 1] = np.where(scale > least, np.abs(rows @ level / m) / scale, 0.0)
    top = np.maximum.accumulate(scores, axis=1)
    fresh = np.concatenate([np.ones((len(rows), 1), bool), scores[:, 1:] > top[:, :-1]], axis=1)
    lags = np.maximum.accumulate(np.where(fresh, np.arange(1, max_lag + 1), 0), axis=1)
    return top, lags


def _reverse(target: np.ndarray, rotated: np.ndarray, max_lag: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``target`` leading each row of ``rotated``: correlation of time-reversed series."""
    return _best(rotated[:, ::-1], target[::-1], max_lag)


def pair_scores(source: np.ndarray, target: np.ndarray, shifts: np.ndarray, max_lag: int):
    """Best scores per lag limit, observed and for each rotation of the source, in both directions.

    Row 0 of each result is the observed pair, the others its surrogates.
    """
    n = min(len(source), len(target))
    source, target = centred(source[:n]), centred(target[:n])
    starts = np.concatenate([[0], np.asarray(shifts, dtype=np.int64) % n])
    rotated = np.concatenate([source, source])[starts[:, None] + np.arange(n)]
    return _best(rotated, target, max_lag), _reverse(target, rotated, max_lag)


def judge(source: np.ndarray, target: np.ndarray, shifts: np.ndarray, limits: list[int]) -> list[dict]:
    """One test per lag limit: score, lag, p and max-statistic adjusted p for both directions.

    All limits share the rotations, so arms of a study cost one pass. A surrogate that falls short by rounding only
    counts as one that reaches the score, so p does not depend on how a machine adds up.
    """
    (fwd, fwd_lag), (rev, rev_lag) = pair_scores(source, target, shifts, max(limits))
    n = len(shifts)
    out = []
    for limit in limits:
        f, r = fwd[:, limit - 1], rev[:, limit - 1]
        top = np.maximum(f[1:], r[1:])
        out.append({
            "fwd_score": float(f[0]), "fwd_lag": int(fwd_lag[0, limit - 1]),
            "fwd_p": float((1 + np.sum(f[1:] >= f[0] - _SAME)) / (n + 1)),
            "fwd_adj_p": float((1 + np.sum(top >= f[0] - _SAME)) / (n + 1)),
            "rev_score": float(r[0]), "rev_lag": int(rev_lag[0, limit - 1]),
            "rev_p": float((1 + np.sum(r[1:] >= r[0] - _SAME)) / (n + 1)),
            "rev_adj_p": float((1 + np.sum(top >= r[0] - _SAME)) / (n + 1))})
    return out
