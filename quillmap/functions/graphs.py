"""Communities and layout of a bounded graph (after the cut to the most frequent terms).

Both run in one task on at most MOST_NODES nodes; a larger graph is refused, since these read-outs
are for maps people look at. Seeded; the same input gives the same result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import global_rank, with_total

MOST_NODES = 10_000


def louvain(a: np.ndarray, resolution: float = 1.0, seed: int = 42) -> np.ndarray:
    """Community of each node of a symmetric weight matrix: local moves by modularity gain, then the
    communities become nodes, until nothing moves. Numbered from 0 by their first node."""
    rng = np.random.default_rng(seed)
    label, w = np.arange(len(a)), a.astype(float).copy()
    while True:
        n, k = len(w), w.sum(1)
        total = k.sum()
        if not total:
            break
        own, inside, moved = np.arange(n), k.copy(), False
        for _ in range(50):
            changed = 0
            for i in rng.permutation(n):
                inside[own[i]] -= k[i]
                ties = np.bincount(own, w[i], n)
                ties[own[i]] -= w[i, i]
                gain = ties - resolution * k[i] * inside / total
                gain[(ties <= 0) & (np.arange(n) != own[i])] = -np.inf
                best = int(gain.argmax())
                if gain[best] <= gain[own[i]] + 1e-12:
                    best = own[i]
                changed += best != own[i]
                own[i] = best
                inside[best] += k[i]
            moved |= changed > 0
            if not changed:
                break
        ids, own = np.unique(own, return_inverse=True)
        label = own[label]
        if not moved or len(ids) == n:
            break
        fold = np.zeros((len(ids), n))
        fold[own, np.arange(n)] = 1
        w = fold @ w @ fold.T
    first: dict[int, int] = {}
    return np.array([first.setdefault(int(c), len(first)) for c in label])


def spring(a: np.ndarray, steps: int = 80, scale: float = 500.0, seed: int = 42) -> np.ndarray:
    """x, y of each node by springs and repulsion with a cooling step, centred and scaled."""
    n = len(a)
    if n == 1:
        return np.zeros((1, 2))
    rng = np.random.default_rng(seed)
    pos, k, heat = rng.uniform(-1, 1, (n, 2)), 2.5 / np.sqrt(n), 0.2
    for _ in range(steps):
        diff = pos[:, None] - pos[None]
        dist = np.maximum(np.sqrt((diff**2).sum(-1)), 0.01)
        move = (diff * (k * k / dist**2 - a * dist / k)[..., None]).sum(1)
        size = np.maximum(np.sqrt((move**2).sum(1, keepdims=True)), 0.01)
        pos += move / size * heat
        heat -= 0.2 / (steps + 1)
    pos -= pos.mean(0)
    return pos / max(np.abs(pos).max(), 1e-9) * scale


def _matrix(nodes: pd.DataFrame, edges: list) -> np.ndarray:
    at = {t: i for i, t in enumerate(nodes["term"])}
    a = np.zeros((len(at), len(at)))
    for s, d, w in edges:
        if s in at and d in at:
            a[at[s], at[d]] += w
            a[at[d], at[s]] += w
    return a


def map_read_out(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """term, cluster (from 1), x, y of a bounded network, made in one task."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["dst"].isna()].rename(columns={"src": "term"}).sort_values("term").reset_index(drop=True)
        if len(own) > MOST_NODES:
            raise ValueError(f"more than {MOST_NODES} nodes; cut to the most frequent terms first")
        a = _matrix(own, pdf[pdf["dst"].notna()][["src", "dst", "weight"]].values.tolist())
        pos = spring(np.minimum(a, 1.0))
        return pd.DataFrame({"term": own["term"], "cluster": louvain(a, resolution) + 1, "x": pos[:, 0], "y": pos[:, 1]})

    rows = nodes.select(F.col("term").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("weight"))
    rows = rows.unionByName(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    return rows.groupBy().applyInPandas(lambda pdf: work(pdf), "term string, cluster int, x double, y double")


def circular(nodes: DataFrame, scale: float = 500.0) -> DataFrame:
    """term, x, y on a circle in the order of the terms: the layout that needs no springs."""
    n = with_total(global_rank(nodes.select("term"), "term", name="k").withColumn("k", F.col("k") - 1), n=F.count(F.lit(1)))
    angle = 2 * F.pi() * F.col("k") / F.col("n")
    return n.select("term", F.round(scale * F.cos(angle), 6).alias("x"), F.round(scale * F.sin(angle), 6).alias("y"))
