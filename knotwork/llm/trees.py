"""Small tree models on the driver, fitted on bounded samples: histogram trees, boosting, forests, isotonic and lasso fits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Quantile cuts of a feature that splits are sought at.
BINS = 64
#: A node is (feature, threshold, below-or-equal, above) or a leaf's value.
Node = tuple | float


def binned(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bin numbers and, for each feature, the cuts: a row is in bin k if exactly k cuts are below it."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.int16), cuts


def grow(b: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, ridge: float = 1.0, rng: np.random.Generator | None = None, some: int = 0) -> Node:
    """A tree for gradients g and weights h: leaves are -sum(g) / (sum(h) + ridge). some: features drawn for each split (0: all)."""
    gs, hs = g.sum(), h.sum()
    leaf = float(-gs / (hs + ridge))
    if depth == 0 or hs < 2 * least:
        return leaf
    best = (1e-9, None, None)
    every = range(b.shape[1]) if not some else sorted(rng.choice(b.shape[1], min(some, b.shape[1]), replace=False))
    for j in every:
        if not len(cuts[j]):
            continue
        gl = np.bincount(b[:, j], g, len(cuts[j]) + 1).cumsum()[:-1]
        hl = np.bincount(b[:, j], h, len(cuts[j]) + 1).cumsum()[:-1]
        gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
        gain[(hl < least) | (hs - hl < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, k)
    _, j, k = best
    if j is None:
        return leaf
    low = b[:, j] <= k
    sub = [grow(b[m], cuts, g[m], h[m], depth - 1, least, ridge, rng, some) for m in (low, ~low)]
    return (int(j), float(cuts[j][k]), *sub)


def value(node: Node, x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x))
    todo = [(node, np.arange(len(x)))]
    while todo:
        n, rows = todo.pop()
        if not isinstance(n, tuple):
            out[rows] = n
            continue
        low = x[rows, n[0]] <= n[1]
        todo += [(n[2], rows[low]), (n[3], rows[~low])]
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, least: float = 3.0) -> tuple[float, list[Node]]:
    """Logistic gradient boosting: start and trees, whose values are to be multiplied by the rate."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(p / (1 - p)))
    z, trees = np.full(len(y), start), []
    b, cuts = binned(x)
    for _ in range(rounds):
        p = sigmoid(z)
        trees.append(grow(b, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, least * p.mean() * (1 - p.mean())))
        z += rate * value(trees[-1], x)
    return start, trees


def forest(x: np.ndarray, y: np.ndarray, count: int, depth: int, seed: int = 7, least: float = 2.0) -> list[Node]:
    """Random forest: bootstrap rows, a square root of the features at each split, leaves are shares of label 1."""
    rng, trees = np.random.default_rng(seed), []
    b, cuts = binned(x)
    for _ in range(count):
        m = rng.integers(0, len(y), len(y))
        trees.append(grow(b[m], cuts, -y[m].astype(float), np.ones(len(m)), depth, least, 1e-3, rng, max(1, round(x.shape[1] ** 0.5))))
    return trees


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, share of label 1), to be joined by straight lines. Blocks are smoothed by half a row of either label."""
    order = np.argsort(score, kind="stable")
    at: list[list[float]] = []
    for s, v in zip(score[order], y[order], strict=True):
        if at and at[-1][3] == s:
            at[-1][0] += v
            at[-1][1] += 1
        else:
            at.append([float(v), 1.0, s, s])
        while len(at) > 1 and at[-2][0] * at[-1][1] >= at[-1][0] * at[-2][1]:
            a, b = at[-2:]
            at[-2:] = [[a[0] + b[0], a[1] + b[1], a[2], b[3]]]
    knots = [(s, (v + 0.5) / (n + 1)) for v, n, lo, hi in at for s in ((lo, hi) if hi > lo else (lo,))]
    xs, ys = np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])
    return xs, ys


def paths(node: Node, held: tuple = ()) -> Iterator[tuple]:
    """Every inner and leaf path but the root's as a conjunction of (feature, threshold, above)."""
    if held:
        yield held
    if isinstance(node, tuple):
        j, t, low, high = node
        yield from paths(low, (*held, (j, t, False)))
        yield from paths(high, (*held, (j, t, True)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights that minimise mean log loss + penalty * |weights|, by accelerated proximal steps."""
    n, k = x.shape
    top = float(np.linalg.norm(np.c_[np.ones(n), x], 2) ** 2 / (4 * n)) or 1.0
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    full = np.c_[np.ones(n), x]
    for _ in range(steps):
        new = v - full.T @ (sigmoid(full @ v) - y) / n / top
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - penalty / top, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


def holds(rule: Sequence[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, t, above in rule:
        out &= (x[:, j] > t) == above
    return out
