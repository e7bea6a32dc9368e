"""Numeric kernels of self-organizing maps and their clusters (numpy; sizes bounded by the map)."""

from __future__ import annotations

import numpy as np


def distances(x: np.ndarray, w: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Rows of x against neurons w; an unknown metric is Euclidean. Done in slices of bounded memory."""
    if metric == "manhattan":
        f = lambda a: np.abs(a[:, None] - w[None]).sum(-1)
    elif metric == "canberra":
        f = lambda a: (np.abs(a[:, None] - w[None]) / (np.abs(a[:, None]) + np.abs(w[None]) + 1e-15)).sum(-1)
    else:
        f = lambda a: np.sqrt(((a[:, None] - w[None]) ** 2).sum(-1))
    step = max(1, 4_000_000 // max(1, w.size))
    return np.concatenate([f(x[s : s + step]) for s in range(0, len(x), step)]) if len(x) else np.empty((0, len(w)))


def grid(rows: int, cols: int) -> np.ndarray:
    """x, y of a hexagonal grid, odd columns half a step lower."""
    r, c = np.divmod(np.arange(rows * cols), cols)
    return np.stack([1.5 * c, np.sqrt(3) * r + np.where(c % 2 == 1, np.sqrt(3) / 2, 0.0)], 1)


def kernel(pos: np.ndarray, sigma: float) -> np.ndarray:
    d2 = ((pos[:, None] - pos[None]) ** 2).sum(-1)
    return np.exp(-d2 / (2 * sigma * sigma))


def batch_update(w: np.ndarray, sums: np.ndarray, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """New weights from the sums and counts per best-matching neuron; a neuron that nothing reaches keeps its own."""
    total = h @ counts
    return np.where(total[:, None] > 0, (h @ sums) / np.maximum(total, 1e-300)[:, None], w)


def linear_init(mean: np.ndarray, cov: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Plane of the two main components through the mean. Signs: the largest coordinate of a component is positive.
    With two features or fewer only the first component is used."""
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:2]
    axes, values = axes[:, order].T, np.maximum(values[order], 0)
    axes = np.array([a * np.sign(a[np.abs(a).argmax()] or 1) for a in axes])
    r, c = np.divmod(np.arange(rows * cols), cols)
    nx = 2 * c / max(1, cols - 1) - 1 if cols > 1 else np.zeros(len(c))
    ny = 2 * r / max(1, rows - 1) - 1 if rows > 1 else np.zeros(len(r))
    w = mean + np.outer(nx, axes[0] * np.sqrt(values[0]))
    return w + np.outer(ny, axes[1] * np.sqrt(values[1])) if len(mean) > 2 else w


def zscore(x: np.ndarray) -> np.ndarray:
    s = x.std(0)
    return (x - x.mean(0)) / np.where(s == 0, 1, s)


def dbscan(x: np.ndarray, eps: float = 0.5, least: int = 3) -> np.ndarray:
    """Cluster of each row, -1 noise; numbered by first member; a border row goes to its first core neighbour's cluster."""
    d = distances(x, x) <= eps
    core = d.sum(1) >= least
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], k
        while stack:
            j = stack.pop()
            for m in np.flatnonzero(d[j] & (label < 0)):
                label[m] = k
                if core[m]:
                    stack.append(m)
        k += 1
    return label


def ward(x: np.ndarray, k: int) -> np.ndarray:
    """k clusters by Ward's criterion, merging the nearest pair until k are left; numbered by first member."""
    n = len(x)
    size, centre, alive = np.ones(n), x.astype(float).copy(), np.ones(n, bool)
    d = 0.5 * ((x[:, None] - x[None]) ** 2).sum(-1)
    d[np.tril_indices(n)] = np.inf
    root = np.arange(n)
    for _ in range(n - max(1, min(k, n))):
        i, j = np.unravel_index(d.argmin(), d.shape)
        centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / (size[i] + size[j])
        size[i] += size[j]
        alive[j] = False
        root[root == j] = i
        d[j, :] = d[:, j] = np.inf
        m = np.flatnonzero(alive & (np.arange(n) != i))
        cost = size[i] * size[m] / (size[i] + size[m]) * ((centre[i] - centre[m]) ** 2).sum(1)
        d[np.minimum(i, m), np.maximum(i, m)] = cost
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(r), len(first)) for r in root])


def cluster_scores(x: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Silhouette, Davies-Bouldin, Calinski-Harabasz; nan where fewer than two clusters or all rows alone."""
    ids = np.unique(label)
    n, k = len(x), len(ids)
    if k < 2 or k >= n:
        return float("nan"), float("nan"), float("nan")
    d = distances(x, x)
    member = label[:, None] == ids[None]
    size = member.sum(0)
    mean = d @ member / np.maximum(size, 1)
    own = np.searchsorted(ids, label)
    a = (d @ member)[np.arange(n), own] / np.maximum(size[own] - 1, 1)
    b = np.where(member, np.inf, mean).min(1)
    s = np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    centre = np.stack([x[label == c].mean(0) for c in ids])
    within = np.array([np.sqrt(((x[label == c] - centre[i]) ** 2).sum(1)).mean() for i, c in enumerate(ids)])
    gap = distances(centre, centre)
    np.fill_diagonal(gap, np.inf)
    db = ((within[:, None] + within[None]) / gap).max(1).mean()
    between = (size * ((centre - x.mean(0)) ** 2).sum(1)).sum()
    inner = sum(((x[label == c] - centre[i]) ** 2).sum() for i, c in enumerate(ids))
    return float(s.mean()), float(db), float(between / (k - 1) / max(inner / (n - k), 1e-300))


def suggest_size(n: int, ratio: float) -> tuple[int, int]:
    """rows, cols: 10 n neurons up to 1000 rows of data, else 5 sqrt(n), in the given ratio of sides (held to 1/3..3)."""
    ratio = min(3.0, max(1 / 3, ratio))
    neurons = max(1.0, 10.0 * n if n <= 1000 else 5.0 * np.sqrt(n))
    cols = max(1, int(round(np.sqrt(neurons / ratio))))
    return max(1, int(round(neurons / cols))), cols
