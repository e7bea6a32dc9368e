"""Average linkage on a sparse graph by reciprocal nearest neighbours.

Each round every cluster names its most similar neighbour; all pairs that name each other merge at
once; edges between the merged clusters are added up. Similarity of two clusters is the mean over
the edges between them (`missing="skip"`), or over all pairs with absent edges as 0
(`missing="zero"`). It ends when no pair reaches the threshold. A cluster without an edge that reaches
it never will have one (what merging makes of edges below it is a mean of such), so its edges go.

The rounds run as DataFrame joins while the graph is large; once it has at most LOCAL_EDGES edges
(a bounded 32 bytes each) the same rounds finish inside one task. Every round merges at least the
best pair of all, so the joins go on for as long as the graph is larger than that. Both ways give the
same clusters, ties included: similarities are whole numbers of UNIT, whose sums are exact in any
order, and equal ones go by one hash of the two ids, then by the ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize

#: Edges of the last task, parts of a similarity of 1, and a prime below 2^31.
LOCAL_EDGES, UNIT, PRIME = 1_500_000, 1 << 30, 2_147_483_647


def tie(low, high):
    """A hash of an ordered pair of ids, without overflow, the same for columns and arrays."""
    mod = (lambda x: F.pmod(x, F.lit(PRIME))) if isinstance(low, Column) else (lambda x: np.mod(x, PRIME))
    h = mod(mod(low) * 48_271 + 11)
    h = mod(mod(high) * 69_621 + h)
    return mod(h * h + mod(low) * 16_807)


def _sums(at: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, at, v)
    return out


def link_local(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: np.ndarray, size: dict[int, int], threshold: float, zero: bool) -> dict[int, int]:
    """Cluster of every id in the edges (a, b, sum of similarities w in UNIT, number of edges n)."""
    least = threshold * UNIT
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = codes[: len(a)], codes[len(a) :]
    label = np.arange(len(ids))
    sizes = np.array([size.get(int(i), 1) for i in ids], np.float64) if size else np.ones(len(ids))
    while len(a):
        mean = w / (sizes[a] * sizes[b] if zero else n)
        ok = mean >= least
        if not ok.any():
            break
        x, y, m = np.r_[a[ok], b[ok]], np.r_[b[ok], a[ok]], np.r_[mean[ok], mean[ok]]
        low, high = ids[np.minimum(x, y)], ids[np.maximum(x, y)]
        order = np.lexsort((low, high, tie(low, high), -m, x))
        first = order[np.r_[True, x[order][1:] != x[order][:-1]]]
        best = np.full(len(ids), -1)
        best[x[first]] = y[first]
        me = np.flatnonzero(best >= 0)
        pair = me[(best[best[me]] == me) & (me < best[me])]
        to = np.arange(len(ids))
        to[best[pair]] = pair
        sizes[pair] += sizes[best[pair]]
        label = to[label]
        a, b = to[a], to[b]
        keep = a != b
        a, b, w, n = np.minimum(a, b)[keep], np.maximum(a, b)[keep], w[keep], n[keep]
        key, at = np.unique(a.astype(np.int64) * len(ids) + b, return_inverse=True)
        w, n = (_sums(at, v, len(key)) for v in (w, n))
        a, b = key // len(ids), key % len(ids)
    return {int(i): int(ids[k]) for i, k in zip(ids, label)}


def average_linkage(edges: DataFrame, threshold: float, missing: str = "skip", local_edges: int = LOCAL_EDGES) -> DataFrame:
    """id, cluster for every id in edges (a < b, sim from 0 to 1). cluster is the smallest of its ids."""
    zero = missing == "zero"
    least = threshold * UNIT
    state = materialize(edges.groupBy("a", "b").agg(F.round(F.max("sim") * UNIT).cast("long").alias("w")).withColumn("n", F.lit(1).cast("long")), "edges")
    labels = state.select(F.col("a").alias("id")).union(state.select("b")).distinct().withColumn("cluster", F.col("id"))
    sizes = None
    while state.limit(local_edges + 1).count() > local_edges:
        if sizes is None:
            sizes = labels.select("id", F.lit(1).cast("long").alias("size"))
            labels = materialize(labels, "labels")
        if zero:
            mean = state.join(sizes.withColumnsRenamed({"id": "a", "size": "sa"}), "a").join(sizes.withColumnsRenamed({"id": "b", "size": "sb"}), "b").withColumn("mean", F.col("w") / (F.col("sa") * F.col("sb")))
        else:
            mean = state.withColumn("mean", F.col("w") / F.col("n"))
        good = mean.where(F.col("mean") >= least)
        both = good.select(F.col("a").alias("x"), F.col("b").alias("y"), "mean").union(good.select("b", "a", "mean"))
        low, high = F.least("x", "y"), F.greatest("x", "y")
        # of equal means the least hash, then the least ids, as in link_local
        best = materialize(both.groupBy("x").agg(F.min_by("y", F.struct(-F.col("mean"), tie(low, high), high, low)).alias("y")), "best")
        pairs = materialize(best.join(best.select(F.col("x").alias("y"), F.col("y").alias("back")), "y").where((F.col("back") == F.col("x")) & (F.col("x") < F.col("y"))).select(F.col("y").alias("old"), F.col("x").alias("new")), "pairs")
        if pairs.isEmpty():
            return labels

        def to(df: DataFrame, col: str, pairs: DataFrame = pairs) -> DataFrame:
            return df.join(pairs, F.col(col) == F.col("old"), "left").withColumn(col, F.coalesce("new", col)).drop("old", "new")

        done = [labels, state, best, pairs]
        labels = materialize(to(labels, "cluster"), "labels")
        if zero:
            sizes = materialize(to(sizes, "id").groupBy("id").agg(F.sum("size").alias("size")), "sizes")
        live = best.select("x")
        kept = state.join(live.withColumnRenamed("x", "a"), "a", "left_semi").join(live.withColumnRenamed("x", "b"), "b", "left_semi")
        moved = to(to(kept, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w", "n")
        state = materialize(moved.groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("n").alias("n")), "edges")
        discard(*done)  # else every round's tables stay to the end

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)] for b in batches if b.num_rows]
        if not parts:
            return
        a, b, w, n, *more = (np.concatenate(p) for p in zip(*parts))
        size = dict(zip(a.tolist(), more[0].tolist())) | dict(zip(b.tolist(), more[1].tolist())) if more else {}
        got = link_local(a, b, w, n, size, threshold, zero)
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.int64())], ["old", "new"])

    rest = state.select("a", "b", "w", "n")
    if zero and sizes is not None:
        rest = state.join(sizes.withColumnsRenamed({"id": "a", "size": "sa"}), "a").join(sizes.withColumnsRenamed({"id": "b", "size": "sb"}), "b").select("a", "b", "w", "n", "sa", "sb")
    moves = rest.repartition(1).mapInArrow(finish, "old long, new long")
    return labels.join(moves, F.col("cluster") == F.col("old"), "left").select("id", F.coalesce("new", "cluster").alias("cluster"))
