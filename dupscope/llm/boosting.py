"""Gradient-boosted trees for two classes, trained here on a bounded sample: logistic loss, quantile bins.

A tree is nested tuples (feature, cut, left, right), left where value <= cut, or a leaf's number.
"""

from __future__ import annotations

import numpy as np

Tree = tuple | float


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, least: float = 1.0, patience: int = 0, weight: np.ndarray | None = None) -> tuple[float, list[Tree]]:
    """(base score, trees) of log odds of y = 1.

    patience: rows 3, 7, ... are kept from the trees, and only as many trees stay as lower the loss on them,
    which may be none; the search ends after so many rounds without.
    """
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    w = np.ones(len(y)) if weight is None else weight
    mean = min(max(float((w * y).sum() / w.sum()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return base, []
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    cuts = [c[c < v.max()] for c, v in zip(cuts, x.T)]
    coded = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    score, trees = np.full(len(y), base), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best, at = 1e-6, None
        for f in range(x.shape[1]) if left else ():
            if not len(cuts[f]):
                continue
            n = len(cuts[f]) + 1
            gs = np.cumsum(np.bincount(coded[rows, f], g[rows], n))[:-1]
            hs = np.cumsum(np.bincount(coded[rows, f], h[rows], n))[:-1]
            gain = gs**2 / (hs + least) + (total_g - gs) ** 2 / (total_h - hs + least) - total_g**2 / (total_h + least)
            gain[(hs < 1e-3) | (total_h - hs < 1e-3)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, at = gain[k], (f, k)
        if at is None:
            value = float(rate * total_g / (total_h + least))
            score[rows] += value
            return value
        below = coded[rows, at[0]] <= at[1]
        return (at[0], float(cuts[at[0]][at[1]]), grow(rows[below], g, h, left - 1), grow(rows[~below], g, h, left - 1))

    held = np.zeros(len(y), bool)
    if patience:  # every fourth row only watches
        held[3::4] = True
    learn = np.flatnonzero(~held)
    watched, best, keep = np.full(int(held.sum()), base), np.inf, 0
    for k in range(rounds):
        if patience:
            loss = float(np.mean(np.logaddexp(0, watched) - y[held] * watched)) if len(watched) else 0.0
            if loss < best - 1e-4:
                best, keep = loss, k
            elif k - keep >= patience:
                break
        p = 1 / (1 + np.exp(-score))
        trees.append(grow(learn, w * (y - p), w * p * (1 - p), depth))
        watched += log_odds((0.0, trees[-1:]), x[held])
    return base, trees[:keep] if patience else trees


def log_odds(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    base, trees = model
    out = np.full(len(x), base)

    def walk(t: Tree, rows: np.ndarray) -> None:
        if not isinstance(t, tuple):
            out[rows] += t
        elif len(rows):
            below = x[rows, t[0]] <= t[1]
            walk(t[2], rows[below])
            walk(t[3], rows[~below])

    for t in trees:
        walk(t, np.arange(len(x)))
    return out


def sql(model: tuple[float, list[Tree]], names: list[str]) -> str:
    """The same as a SQL expression over columns."""

    def of(t: Tree) -> str:
        return f"(CASE WHEN {names[t[0]]} <= {t[1]!r}D THEN {of(t[2])} ELSE {of(t[3])} END)" if isinstance(t, tuple) else f"{t!r}D"

    return " + ".join([f"{model[0]!r}D", *map(of, model[1])])
