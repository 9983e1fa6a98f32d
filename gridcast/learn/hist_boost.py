"""Histogram gradient boosting of a binary classifier on one group's rows, in numpy.

The reference's HistGradientBoostingClassifier with its settings: median imputation, at most 255
bins a feature, balanced class weights, log loss, trees grown best split first to 31 leaves of at
least 20 rows. Above 10,000 rows a tenth of them, drawn by the seed, ends the boosting when its
loss has not fallen for 10 trees; up to there nothing is drawn, so the seed has no effect.
"""

from __future__ import annotations

import heapq

import numpy as np

ITERATIONS = 300
RATE = 0.03
L2 = 0.05
LEAVES = 31
LEAF_ROWS = 20
LEAF_HESSIAN = 1e-3
BINS = 255
STOP_ROWS = 10_000        # early stopping above this
STOP_SHARE, STOP_TREES, STOP_TOL = 0.1, 10, 1e-7


def _edges(col: np.ndarray) -> np.ndarray:
    values = np.unique(col)
    if len(values) <= BINS:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.percentile(col, np.linspace(0, 100, BINS + 1)[1:-1], method="midpoint"))


def _split(code, g, h, rows, n_feat):
    """Best split of a node: (gain, feature, bin), or None."""
    c = code[rows].ravel()
    size = n_feat * (BINS + 1)
    hist = [np.bincount(c, w, size).reshape(n_feat, -1).cumsum(1)
            for w in (np.repeat(g[rows], n_feat), np.repeat(h[rows], n_feat), None)]
    gl, hl, nl = hist
    gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
    gr, hr, nr = gt - gl, ht - hl, nt - nl
    ok = (nl >= LEAF_ROWS) & (nr >= LEAF_ROWS) & (hl >= LEAF_HESSIAN) & (hr >= LEAF_HESSIAN)
    if not ok.any():
        return None
    gain = np.where(ok, gl * gl / (hl + L2) + gr * gr / (np.where(ok, hr, 1) + L2) - gt * gt / (ht + L2), 0)
    best = int(gain.argmax())
    if gain.flat[best] <= 1e-12:
        return None
    return float(gain.flat[best]), best // (BINS + 1), best % (BINS + 1)


def _tree(code, bins, g, h, all_bins, out):
    """Grows a tree on the rows of ``code`` and adds its leaves' steps to ``out``, the raw values
    of the rows of ``all_bins``."""
    n_feat = bins.shape[1]
    todo, leaves, serial = [], [], 0

    def add(rows, everywhere):
        nonlocal serial
        s = _split(code, g, h, rows, n_feat) if len(rows) >= 2 * LEAF_ROWS else None
        if s is None:
            leaves.append((rows, everywhere))
        else:
            heapq.heappush(todo, (-s[0], serial, s[1], s[2], rows, everywhere))
            serial += 1

    add(np.arange(len(code)), np.arange(len(all_bins)))
    while todo and len(todo) + len(leaves) < LEAVES:
        _, _, f, b, rows, everywhere = heapq.heappop(todo)
        left, there = bins[rows, f] <= b, all_bins[everywhere, f] <= b
        add(rows[left], everywhere[there])
        add(rows[~left], everywhere[~there])
    for rows, everywhere in leaves + [t[4:] for t in todo]:
        out[everywhere] -= RATE * g[rows].sum() / (h[rows].sum() + L2)


def fit_predict(x: np.ndarray, y: np.ndarray, new: np.ndarray, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """Probability of class 1 for the rows ``new`` from a model of ``x`` and ``y`` (0 and 1, both
    there). Missing values are nan; columns without any value in ``x`` are left out."""
    some = ~np.isnan(x).all(0)
    x, new = x[:, some], new[:, some]
    if not x.shape[1]:
        x, new = np.zeros((len(x), 1)), np.zeros((len(new), 1))
    median = np.nanmedian(x, axis=0)
    x, new = np.where(np.isnan(x), median, x), np.where(np.isnan(new), median, new)
    w = np.where(y == 1, len(y) / (2.0 * (y == 1).sum()), len(y) / (2.0 * (y == 0).sum()))
    held = np.zeros(len(y), bool)
    if len(y) > STOP_ROWS:
        rng = np.random.default_rng(seed)
        for c in (0, 1):
            at = np.flatnonzero(y == c)
            held[rng.permutation(at)[:round(STOP_SHARE * len(at))]] = True
    fit = np.flatnonzero(~held)
    edges = [_edges(x[fit, j]) for j in range(x.shape[1])]
    every = np.stack([np.searchsorted(e, np.concatenate([x[:, j], new[:, j]])) for j, e in enumerate(edges)], 1)
    bins = every[fit]
    code = bins + np.arange(bins.shape[1]) * (BINS + 1)
    yf, wf = y[fit], w[fit]
    share = (wf * yf).sum() / wf.sum()
    raw = np.full(len(every), np.log(share / (1 - share)))
    losses: list[float] = []
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-raw[fit]))
        _tree(code, bins, wf * (p - yf), wf * p * (1 - p), every, raw)
        if held.any():
            z = raw[:len(y)][held]
            losses.append(float((w[held] * (np.logaddexp(0, z) - y[held] * z)).sum() / w[held].sum()))
            if len(losses) > STOP_TREES and min(losses[-STOP_TREES:]) > losses[-STOP_TREES - 1] - STOP_TOL:
                break
    return 1 / (1 + np.exp(-raw[len(y):]))
