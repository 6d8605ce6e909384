"""Gradient-boosted trees with logistic loss on binned features.

Trees are grown from sums over all rows (histograms of gradients by node, feature and bin), so the rows may lie in any
number of blocks, here or in tasks of Spark. Gradients are summed as multiples of 2^-20, so the sums do not hang on the order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np

BINS = 24
#: Trees after which the margins of rows that lie elsewhere are kept, so that they are not found again from the first tree on.
KEEP = 5
_UNIT = float(1 << 20)
#: Margins are told apart by this much where thresholds are found, and up to this size.
_STEP, _FAR = 1 / 256, 24


class Trees(NamedTuple):
    """feature, edge, value: (trees, nodes) of complete binary trees; values are at the leaves. cut: the calibrated threshold."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray
    slope: float
    shift: float
    cut: float


class Rows:
    """Binned rows with the weights of those trees are fitted to and of those that calibrate: all and positive ones of each."""

    def __init__(self, binned: np.ndarray, weights: np.ndarray, margin: np.ndarray | None = None, trees: int = 0):
        self.binned, self.weights = binned, weights
        self.margin, self.trees = margin, trees  # what is known of the trees so far


def _margin(model: Trees, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.base)
    rows = np.arange(len(x))
    inner = model.feature.shape[1]
    for f, e, v in zip(model.feature, model.edge, model.value):
        node = np.zeros(len(x), np.int64)
        while node.size and node[0] < inner:
            node = 2 * node + 1 + (x[rows, f[node]] > e[node])
        out += v[node - inner]
    return out


def predict(model: Trees, x: np.ndarray) -> np.ndarray:
    """Calibrated probabilities."""
    if not len(x):
        return np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(model.slope * _margin(model, x) + model.shift, -30, 30)))


def edges_of(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Edges between bins: all values but the greatest, or the quantiles if there are more values than bins."""
    values, at = np.unique(values, return_inverse=True)
    if len(values) <= BINS:
        return values[:-1].astype(float)
    upto = np.cumsum(np.bincount(at, weights))
    return np.unique(values[np.searchsorted(upto, np.linspace(0, 1, BINS + 1)[1:-1] * upto[-1])]).astype(float)


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)


class Grown(NamedTuple):
    """The trees of a kind so far, over bins. both: so few rows that all are fitted to and calibrate."""

    base: float
    both: bool
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


def _sums(rows: Rows) -> np.ndarray:
    return rows.weights.sum(axis=0)


def _margins(rows: Rows, g: Grown, trees: int) -> np.ndarray:
    if rows.margin is None:
        rows.margin = np.full(len(rows.binned), g.base)
    for t in range(rows.trees, trees):
        rows.margin += g.value[t][_nodes(rows, g, t, g.feature.shape[1]) - g.feature.shape[1]]
    rows.trees = trees
    return rows.margin


def _nodes(rows: Rows, g: Grown, t: int, upto: int) -> np.ndarray:
    node, every = np.zeros(len(rows.binned), np.int64), np.arange(len(rows.binned))
    while node.size and node[0] < upto:
        node = 2 * node + 1 + (rows.binned[every, g.feature[t, node]] > g.bin[t, node])
    return node


def _histogram(rows: Rows, g: Grown, t: int, level: int) -> np.ndarray:
    """Sums of gradients and curvatures by node of the level, feature and bin."""
    p = 1 / (1 + np.exp(-_margins(rows, g, t)))
    w, y = (rows.weights[:, 0] + rows.weights[:, 2], rows.weights[:, 1] + rows.weights[:, 3]) if g.both else (rows.weights[:, 0], rows.weights[:, 1])
    both = np.rint((w * p - y) * _UNIT), np.rint(w * (p * (1 - p) + 1e-9) * _UNIT)
    first, n, width = (1 << level) - 1, 1 << level, BINS + 1
    node = (_nodes(rows, g, t, first) - first) * width
    out = np.empty((n, rows.binned.shape[1], width, 2))
    for j in range(rows.binned.shape[1]):
        at = node + rows.binned[:, j]
        for k in (0, 1):
            out[:, j, :, k] = np.bincount(at, both[k], n * width).reshape(n, width)
    return out


def _places(rows: Rows, g: Grown, trees: int) -> np.ndarray:
    """Rows that calibrate, all and positive ones, by margin."""
    w = rows.weights[:, 2:] + rows.weights[:, :2] * g.both
    at = np.rint(np.clip(_margins(rows, g, trees), -_FAR, _FAR) / _STEP).astype(np.int64) + int(_FAR / _STEP)
    return np.stack([np.bincount(at, w[:, k], 2 * int(_FAR / _STEP) + 1) for k in (0, 1)])


def grow(edges: dict[str, list[np.ndarray]], total: Callable, trees: int = 50, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, keep: Callable | None = None) -> dict[str, Trees | None]:
    """The trees of every kind, None where all rows are alike. total(f): the sums over all blocks of f(kind, rows), by kind. keep(f): rows from now on have the margins f(kind, rows) and the number of trees these are of."""
    inner = (1 << depth) - 1
    state: dict[str, Grown] = {}
    for kind, (n, y, n2, y2) in total(lambda kind, rows: _sums(rows)).items():
        if 0 < y + y2 < n + n2:
            both = n + n2 < 50 or not n or not n2
            n, y = (n + n2, y + y2) if both else (n, y)
            state[kind] = Grown(float(np.log((y + 1) / (n - y + 1))), bool(both), np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, inner + 1)))
    for t in range(trees) if state else ():
        for level in range(depth):
            known, first = dict(state), (1 << level) - 1
            for kind, h in total(lambda kind, rows: _histogram(rows, known[kind], t, level) if kind in known else None).items():  # noqa: B023
                g = state[kind]
                left = np.cumsum(h / _UNIT, axis=2)
                every = left[:, :1, -1:]
                right = every - left
                gain = left[..., 0] ** 2 / (left[..., 1] + ridge) + right[..., 0] ** 2 / (right[..., 1] + ridge) - every[..., 0] ** 2 / (every[..., 1] + ridge)
                for j, e in enumerate(edges[kind]):
                    gain[:, j, len(e) :] = -np.inf
                for k in range(1 << level):
                    j, i = divmod(int(gain[k].argmax()), BINS + 1)
                    split = gain[k, j, i] > 1e-6
                    if split:
                        g.feature[t, first + k], g.bin[t, first + k] = j, i
                    if level == depth - 1:
                        for side, (a, b) in enumerate((left[k, j, i], right[k, j, i]) if split else (every[k, 0, 0], np.zeros(2))):
                            g.value[t, 2 * k + side] = -rate * a / (b + ridge) if b > 0 else 0.0
        if keep and t % KEEP == KEEP - 1:
            keep(lambda kind, rows: _margins(rows, known[kind], t + 1) if kind in known else None)  # noqa: B023
    if not state:
        return dict.fromkeys(edges)
    out: dict[str, Trees | None] = dict.fromkeys(edges)
    for kind, (n, y) in total(lambda kind, rows: _places(rows, state[kind], trees) if kind in state else None).items():
        g = state[kind]
        edge = np.array([[edges[kind][j][b] if b < 255 else np.inf for j, b in zip(*x)] for x in zip(g.feature, g.bin)])
        out[kind] = _calibrated(Trees(g.base, g.feature, edge, g.value, 1.0, 0.0, 0.5), n, y)
    return out


def _calibrated(model: Trees, n: np.ndarray, y: np.ndarray) -> Trees:
    """Slope and shift (logistic) and the threshold of the best F1, from all and positive rows by margin."""
    m = np.arange(len(n)) * _STEP - _FAR
    slope, shift = 1.0, 0.0
    loss = lambda a, b: float((n * np.logaddexp(0, a * m + b) - y * (a * m + b)).sum() + ((a - 1) ** 2 + b * b) / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * m + shift, -500, 500)))
        w = n * (p * (1 - p) + 1e-6)
        a = np.array([[(w * m * m).sum() + 1, (w * m).sum()], [(w * m).sum(), w.sum() + 1]])
        b = np.array([((y - n * p) * m).sum() - (slope - 1), (y - n * p).sum() - shift])
        d, step, now = np.linalg.solve(a, b), 1.0, loss(slope, shift)
        while step > 1e-4 and loss(max(0.05, slope + step * d[0]), shift + step * d[1]) > now:
            step /= 2
        slope, shift = max(0.05, slope + step * d[0]), shift + step * d[1]
        if step <= 1e-4:
            break
    q = 1 / (1 + np.exp(-np.clip(slope * m + shift, -30, 30)))
    cuts = np.linspace(0.2, 0.8, 25)
    score = [2 * y[q >= c].sum() / max(1, n[q >= c].sum() + y.sum()) for c in cuts]
    top = np.flatnonzero(np.array(score) >= max(score) - 1e-9)
    # of thresholds that do equally well, the one nearest one half
    return model._replace(slope=float(slope), shift=float(shift), cut=float(cuts[top[np.abs(cuts[top] - 0.5).argmin()]]))


def summed(blocks: list[dict[str, Rows]], f: Callable) -> dict:
    """The sums of f(kind, rows) over blocks, by kind; kinds without any are left out."""
    out: dict = {}
    for block in blocks:
        for kind, rows in block.items():
            x = f(kind, rows)
            if x is not None:
                out[kind] = out[kind] + x if kind in out else x
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.25, ridge: float = 1.0, seed: int = 7) -> Trees | None:
    """Trees fitted to four fifths of the rows; the rest calibrates the probabilities (logistic) and finds the threshold of the best F1."""
    hold = np.random.default_rng(seed).permutation(len(y)) < len(y) // 5
    edges = [edges_of(x[~hold, j], np.ones((~hold).sum())) for j in range(x.shape[1])]
    rows = Rows(bins_of(x, edges), np.stack([~hold, ~hold * y, hold, hold * y], axis=1).astype(float))
    return grow({"": edges}, lambda f: summed([{"": rows}], f), trees, depth, rate, ridge)[""]
