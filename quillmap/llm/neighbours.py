"""Most similar vectors for every vector: learned partitions, then exact reranking.

Fit, on a bounded sample: the sample's neighbour graph is cut into balanced parts (capacity-bound
label propagation from spread-out seeds), and a small softmax classifier learns the part of a
vector. Every row is then indexed under its most probable part, and every row, as a query, is
routed to the `probes` most probable parts, where distances are exact. A second pass over the parts
that may still hold a nearer row makes the result exact (`operators.vector_index`, which takes this
module's router in place of its own). The number of parts grows with the square root of the rows.

Usable vectors: not null, of the table's length, no null or NaN inside. Others give no rows.
Ties go to the smaller id; a table of one usable vector or none gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vector_index
from ..operators.vector_index import spread_seeds, squares

#: Neighbours in the sample's graph, and the least number of parts. The sample's bounds stand in vector_index.
GRAPH_K, LEAST_PARTS = 8, 24


def usable(df: DataFrame, id_col: str, vec_col: str, dim: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, id, vec of the usable rows: float where the column is, which holds the same numbers in half the bytes, else double."""
    kind = "float" if df.schema[vec_col].dataType.simpleString() == "array<float>" else "double"
    v = F.col(vec_col).cast(f"array<{kind}>")
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.where(ok).select(*by, F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0).cast(kind)).alias("vec"))


def balanced_parts(x: np.ndarray, parts: int, k: int = GRAPH_K, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Part of each sample row: propagation over the neighbour graph, at most 1.3 x the mean size each."""
    rng = np.random.default_rng(seed)
    n = len(x)
    k = min(k, n - 1)
    near = np.empty((n, k), np.int64)
    for s in range(0, n, 1024):
        d = squares(x[s : s + 1024], x)
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        near[s : s + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
    seeds = spread_seeds(x, parts, rng)
    to_seed = squares(x, x[seeds])
    cap = int(np.ceil(1.3 * n / len(seeds)))

    def fill(score: np.ndarray) -> np.ndarray:
        """Best scores first; a full part passes its rows on to their next choice."""
        order = np.argsort(-score, axis=1)
        out, room = np.full(n, -1), np.full(score.shape[1], cap)
        first = np.take_along_axis(score, order[:, :1], 1)[:, 0]
        for i in np.argsort(-first, kind="stable"):
            for p in order[i]:
                if room[p]:
                    out[i], room[p] = p, room[p] - 1
                    break
        return out

    part = fill(-to_seed)
    for _ in range(rounds):
        votes = np.zeros((n, len(seeds)))
        np.add.at(votes, (np.repeat(np.arange(n), k), part[near].ravel()), 1.0)
        np.add.at(votes, (near.ravel(), np.repeat(part, k)), 1.0)
        new = fill(votes + 0.5 * (np.arange(len(seeds))[None, :] == part[:, None]) - 1e-6 * to_seed / max(to_seed.max(), 1e-12))
        if (new == part).mean() > 0.999:
            break
        part = new
    return part


class Router:
    """Softmax classifier over [scaled vector, squares to part means]: small, and a few numpy lines."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 30, seed: int = 7):
        self.mean, self.scale = x.mean(0), x.std() + 1e-12
        z = (x - self.mean) / self.scale
        self.parts = parts
        own = [z[part == p] for p in range(parts)]
        centre = np.stack([o.mean(0) if len(o) else np.full(z.shape[1], 1e6) for o in own])
        # a linear layer that starts as "nearest part mean" and is then trained
        self.w, self.b = 2 * centre.T, -(centre**2).sum(1)
        rng, step = np.random.default_rng(seed), 0.05
        gw, gb = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for s in range(0, len(z), 512):
                i = order[s : s + 512]
                g = self._soft(z[i])
                g[np.arange(len(i)), part[i]] -= 1
                dw, db = z[i].T @ g / len(i), g.mean(0)
                gw, gb = 0.9 * gw + dw, 0.9 * gb + db
                self.w -= step * gw
                self.b -= step * gb

    def _soft(self, z: np.ndarray) -> np.ndarray:
        s = z @ self.w + self.b
        s -= s.max(1, keepdims=True)
        e = np.exp(s)
        return e / e.sum(1, keepdims=True)

    def ranked(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each row, best first."""
        s = ((x - self.mean) / self.scale) @ self.w + self.b
        m = min(m, self.parts)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)


def learned(x: np.ndarray, parts: int) -> Router:
    """The router of a sample: a classifier of the balanced parts of its neighbour graph."""
    part = balanced_parts(x, parts) if parts > 1 else np.zeros(len(x), np.int64)
    return Router(x, part, int(part.max()) + 1)


def nearest(rows: DataFrame, k: int, parts: int | None = None, certify: bool = True) -> DataFrame:
    """q, near (list of (squared distance, id)): the k nearest other rows of each row of `rows` (id, vec; vectors distinct)."""
    return vector_index.nearest(rows, k, fit=learned, parts=parts or max(LEAST_PARTS, vector_index.parts_for(rows.count())), certify=certify)


def nearest_ids(df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, **how) -> DataFrame:
    """vec_id, near_id, distance: the k nearest other usable rows of each usable row, copies included
    (a copy is at distance 0); ties to the smaller id."""
    near = vector_index.neighbour_lists(usable(df, id_col, vec_col, dim), k, nearest, **how)
    return near.select(F.col("id").alias("vec_id"), F.explode("near").alias("n")).select("vec_id", F.col("n.id").alias("near_id"), F.sqrt("n.d").alias("distance"))
