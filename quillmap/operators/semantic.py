"""Neighbours, intrinsic dimension, reduction and grouping of embedded records.

Rows: id, vec (array of double), usable ones only (see som.clean). Exact neighbours come from the
partition index (`vector_index`); the tree of density clusters is built in tiles of row blocks by row
blocks, each of bounded size. What is sequential by nature runs in one task on a row or an edge of a few
numbers each: the walk down that tree. The moves of the manifold layout are one task up to TASK_LAYOUT
rows, beyond it a job a step over blocks of rows; all positions are sent, so more than MOST_LAYOUT rows
are an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import som_math
from ..runtime import materialize, rows_bounded
from . import som, vector_index

#: Rows of a tile, the most rows of one-task operators, of a layout in one task and of any layout, and the tiles whose edges are merged at a time.
TILE, MOST_LOCAL, TASK_LAYOUT, MOST_LAYOUT, MERGED = 4_096, 20_000, 250_000, 16_000_000, 8


def neighbours(data: DataFrame, k: int) -> DataFrame:
    """id, near (list of (d, id) ascending; ties by id): the k nearest others of each row, by the partition index."""
    rows = data.select(F.col("id").cast("long").alias("id"), F.transform(F.col("vec").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    return vector_index.neighbour_lists(rows, k).select("id", F.transform("near", lambda x: F.struct(F.sqrt(x["d"]).alias("d"), x["id"].alias("id"))).alias("near"))


def embed_texts(df: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """id, vec: hashed words and word pairs weighted by rarity, of length 1; the stand-in where no text model is at hand.
    Null and empty texts give vectors of zeros."""
    from pyspark.ml.feature import IDF, HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    rows = df.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.concat("w", pairs).alias("w"))
    tf = HashingTF(numFeatures=dim, inputCol="w", outputCol="tf").transform(rows)
    weighed = IDF(inputCol="tf", outputCol="f").fit(tf).transform(tf)
    return Normalizer(inputCol="f", outputCol="u").transform(weighed).select("id", vector_to_array("u").alias("vec"))


def _d(near: Column) -> Column:
    return F.transform(near, lambda x: x["d"])


def local_mle(near: DataFrame, k: int = 20) -> DataFrame:
    """id, dim: 1 / mean ln(T_k / T_j) over the k - 1 nearer neighbours; zero distances don't count."""
    t = F.filter(_d(F.slice("near", 1, k)), lambda d: d > 0)
    last = F.element_at("t", -1)
    logs = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda d: F.log(last / d))
    mean = F.aggregate(logs, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(logs), F.lit(0))
    return near.select("id", t.alias("t")).where(F.size("t") > 1).select("id", (1.0 / F.nullif(mean, F.lit(0.0))).alias("dim")).where("dim is not null")


def percentiles(local: DataFrame) -> DataFrame:
    """mean, p50, p90, p95, high of local dimensions (exact, linear interpolation, round 4)."""
    p = F.expr("percentile(dim, array(0.5, 0.9, 0.95))")
    return local.agg(F.avg("dim").alias("mean"), p.alias("p"), F.max("dim").alias("high")).select(F.round("mean", 4).alias("mean"), *(F.round(F.col("p")[i], 4).alias(n) for i, n in enumerate(("p50", "p90", "p95"))), F.round("high", 4).alias("high"))


def dimensions(near: DataFrame, k: int = 20) -> DataFrame:
    """estimator, dim of the estimators that are aggregates of neighbour distances (round 4)."""
    d = near.select("id", _d(F.slice("near", 1, k)).alias("t")).where(F.size("t") == k)
    half = k // 2
    two = d.where("t[0] > 0").select(F.log(F.col("t")[1] / F.col("t")[0]).alias("v")).agg((F.count("v") / F.nullif(F.sum("v"), F.lit(0.0))).alias("dim")).select(F.lit("TwoNN").alias("estimator"), "dim")
    mada = d.where(F.col("t")[half - 1] > 0).select((F.log(F.lit(2.0)) / F.nullif(F.log(F.col("t")[k - 1] / F.col("t")[half - 1]), F.lit(0.0))).alias("v")).agg(F.avg("v").alias("dim")).select(F.lit("MADA"), "dim")
    mean = F.aggregate("t", F.lit(0.0), lambda s, v: s + v) / k
    mom = d.select(F.try_divide(mean, F.nullif(F.col("t")[k - 1] - mean, F.lit(0.0))).alias("v")).agg(F.avg("v").alias("dim")).select(F.lit("MOM"), "dim")
    mle = local_mle(near, k).agg(F.avg("dim").alias("dim")).select(F.lit("MLE"), "dim")
    lengths = d.select(F.posexplode("t").alias("p", "v")).groupBy("p").agg(F.log(F.avg("v")).alias("y")).select(F.log(F.col("p") + 1).alias("x"), "y")
    knn = lengths.agg((1 / F.nullif(F.regr_slope("y", "x"), F.lit(0.0))).alias("dim")).select(F.lit("KNN"), "dim")
    r = d.agg(F.expr(f"percentile(t[{half - 1}], 0.5)").alias("r1"), F.expr(f"percentile(t[{k - 1}], 0.5)").alias("r2"))
    counts = d.crossJoin(F.broadcast(r)).select("r1", "r2", F.size(F.filter("t", lambda v: v < F.col("r1"))).alias("c1"), F.size(F.filter("t", lambda v: v < F.col("r2"))).alias("c2"))
    corr = counts.groupBy("r1", "r2").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2")).select(F.lit("CorrInt"), (F.log(F.col("c2") / F.col("c1")) / F.log(F.col("r2") / F.col("r1"))).alias("dim"))
    out = two.union(mada).union(mom).union(mle).union(knn).union(corr)
    return out.select("estimator", F.round("dim", 4).alias("dim"))


def pca_dimension(data: DataFrame, least: float = 0.05) -> int:
    """Global principal components whose variance is at least `least` of the greatest."""
    n, s, g, _ = som.moments(data)
    values = np.linalg.eigvalsh(g / n - np.outer(s / n, s / n))
    return int((values >= least * values.max()).sum())


def global_pca(data: DataFrame) -> DataFrame:
    """estimator, dim of pca_dimension, as a row beside those of dimensions; null without rows."""
    dim = None if data.isEmpty() else float(pca_dimension(data))
    return data.sparkSession.createDataFrame([("PCA", dim)], "estimator string, dim double")


def target_dimension(full: int, estimate: float | None, manual: int | None = None, override: int | None = None) -> int:
    """manual (at least 2) before override before the rounded estimate before 10; held to 2..full - 1."""
    d = max(2, manual) if manual else override or (int(round(estimate)) if estimate else 10)
    return max(2, min(d, full - 1))


def reduce_linear(data: DataFrame, d: int) -> DataFrame:
    """id, coords: the first d principal components; signs as in som_math.linear_init."""
    n, s, g, _ = som.moments(data)
    mean = s / n
    values, axes = np.linalg.eigh(g / n - np.outer(mean, mean))
    top = axes[:, np.argsort(-values)[:d]]
    top = top * np.sign(top[np.abs(top).argmax(0), np.arange(top.shape[1])])
    sent = data.sparkSession.sparkContext.broadcast((mean, top))
    kind = data.schema["id"].dataType.simpleString()

    def work(batches):
        mean, top = sent.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(np.round((x - mean) @ top, 6)))], ["id", "coords"])

    return data.select("id", "vec").mapInArrow(work, f"id {kind}, coords array<double>")


def manifold(data: DataFrame, near: DataFrame, k: int = 15, least: float = 0.1, epochs: int = 200, seed: int = 42) -> DataFrame:
    """id, x, y: fuzzy neighbour graph laid out by attraction and sampled repulsion, from the linear projection.
    The moves of at most TASK_LAYOUT rows are made in one task, others by `_layout_steps`; more than MOST_LAYOUT rows are an error."""
    if not rows_bounded(data, MOST_LAYOUT):
        raise ValueError(f"more than {MOST_LAYOUT} rows to lay out")
    rows = reduce_linear(data, 2).join(near, "id").select(F.col("id").cast("long").alias("id"), "coords", F.slice(_d("near"), 1, k).alias("d"), F.slice(F.transform("near", lambda x: x["id"]), 1, k).alias("n"))

    def weigh(batches):
        for big in batches:
            for b in (big.slice(s, 4096) for s in range(0, big.num_rows, 4096)):
                size = np.array([len(d) for d in b.column(2).to_pylist()], int)
                held = np.arange(max(size.max(), 1))[None] < size[:, None]
                d = np.full(held.shape, np.inf)
                d[held] = b.column(2).flatten().to_numpy(zero_copy_only=False)
                rho = np.where(d > 0, d, np.inf).min(1, keepdims=True)
                rho[~np.isfinite(rho)] = 0.0
                over, want = np.maximum(d - rho, 0), np.log2(np.maximum(2, size))
                lo, hi = np.full(len(d), 1e-6), np.full(len(d), 1e4)
                for _ in range(40):
                    mid = (lo + hi) / 2
                    less = np.exp(-over / mid[:, None]).sum(1) < want
                    lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
                w = np.exp(-over / hi[:, None])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array([v[h] for v, h in zip(w, held)], pa.list_(pa.float64()))], ["id", "coords", "n", "w"])

    def work(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        ids, (n, w) = t.column("id").to_numpy(), (t.column(c).combine_chunks() for c in ("n", "w"))
        a = np.repeat(np.arange(len(ids)), n.value_lengths().to_numpy())
        b, w = np.searchsorted(ids, n.flatten().to_numpy()), w.flatten().to_numpy()
        rng = np.random.default_rng(seed)
        pos = t.column("coords").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        pos = pos / max(np.abs(pos).max(), 1e-9) * 10
        for step in range(epochs):
            rate, use = 1.0 - step / epochs, rng.random(len(w)) < w
            i, j = a[use], b[use]
            diff = pos[i] - pos[j]
            d2 = (diff**2).sum(1, keepdims=True)
            pull = np.clip(-2 * diff / (1 + d2 + least), -4, 4) * rate
            np.add.at(pos, i, pull)
            np.add.at(pos, j, -pull)
            for _ in range(5):
                o = rng.integers(0, len(pos), len(i))
                diff = pos[i] - pos[o]
                d2 = (diff**2).sum(1, keepdims=True)
                np.add.at(pos, i, np.clip(2 * diff / ((0.001 + d2) * (1 + d2)), -4, 4) * rate * 0.2)
        return pa.table({"id": ids, "x": pos[:, 0].round(6), "y": pos[:, 1].round(6)})

    weighed = rows.mapInArrow(weigh, "id long, coords array<double>, n array<long>, w array<double>")
    if not rows_bounded(data, TASK_LAYOUT):
        return _layout_steps(materialize(weighed, "weighed"), least, epochs, seed)
    return weighed.groupBy().applyInArrow(work, "id long, x double, y double")


def _layout_steps(weighed: DataFrame, least: float, epochs: int, seed: int) -> DataFrame:
    """id, x, y: the moves of `manifold` with a job for each step. A block of TILE rows has the edges from and to its rows and moves
    only these; the places of the other rows are those of the step before. An edge is drawn for each of its ends."""
    sc = weighed.sparkSession.sparkContext
    start = weighed.select("id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y")).toArrow().sort_by("id")
    ids, pos = start.column("id").to_numpy(), np.stack([start.column(c).to_numpy() for c in "xy"], 1)
    del start
    pos = pos / max(np.abs(pos).max(), 1e-9) * 10
    sent_ids, size = sc.broadcast(ids), TILE

    def ends(batches):
        ids = sent_ids.value
        for b in batches:
            if b.num_rows:
                me, held = np.searchsorted(ids, b.column(0).to_numpy()), np.diff(b.column(1).offsets.to_numpy())
                me, other, w = np.repeat(me, held), np.searchsorted(ids, b.column(1).flatten().to_numpy()), b.column(2).flatten().to_numpy(zero_copy_only=False)
                # the edge at its first end, and below 0 at its second
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[me << 32 | other, other << 32 | me]), pa.array(np.r_[w, -w].astype(np.float32))], ["e", "w"])

    def pack(t: pa.Table) -> pa.Table:
        e, w = t.column("e").to_numpy(), t.column("w").to_numpy()
        order = np.lexsort((w, e))
        e, w = e[order], w[order]
        one = lambda v, kind: pa.array([v.astype(kind).tobytes()], pa.binary())
        return pa.table({"block": pa.array([int(e[0] >> 32) // size]), "me": one(e >> 32, np.int32), "other": one(e & 0xFFFFFFFF, np.int32), "w": one(w, np.float32)})

    edges = weighed.select("id", "n", "w").mapInArrow(ends, "e long, w float").groupBy(F.floor(F.shiftright("e", 32) / size).alias("b")).applyInArrow(pack, "block long, me binary, other binary, w binary")
    edges = materialize(edges, "edges")
    for step in range(epochs):
        sent, rate = sc.broadcast(pos), 1.0 - step / epochs

        def move(batches, sent=sent, rate=rate, step=step):
            pos = sent.value
            for b in batches:
                for block, *packed in zip(*(c.to_pylist() for c in b.columns)):
                    me, other, w = (np.frombuffer(v, kind) for v, kind in zip(packed, (np.int32, np.int32, np.float32)))
                    rng, low = np.random.default_rng([seed, step, block]), block * size
                    own = pos[low : low + size].copy()
                    add = lambda i, by: np.stack([np.bincount(i, by[:, c], len(own)) for c in range(2)], 1)
                    use = rng.random(len(w)) < np.abs(w)
                    first, i, j = w[use] >= 0, me[use] - low, other[use]
                    diff = own[i] - pos[j]
                    own += add(i, np.clip(-2 * diff / (1 + (diff**2).sum(1, keepdims=True) + least), -4, 4) * rate)
                    i = i[first]
                    for _ in range(5):
                        diff = own[i] - pos[rng.integers(0, len(pos), len(i))]
                        d2 = (diff**2).sum(1, keepdims=True)
                        own += add(i, np.clip(2 * diff / ((0.001 + d2) * (1 + d2)), -4, 4) * rate * 0.2)
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([own.tobytes()], pa.binary())], ["block", "own"])

        moved = pos.copy()
        for r in edges.mapInArrow(move, "block long, own binary").collect():
            moved[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["own"]).reshape(-1, 2)
        pos = moved
        sent.destroy()
    sent = sc.broadcast(pos.round(6))

    def place(batches):
        for b in batches:
            at = np.searchsorted(sent_ids.value, b.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(sent.value[at, c]) for c in range(2))], ["id", "x", "y"])

    return weighed.select("id").mapInArrow(place, "id long, x double, y double")


def density_clusters(data: DataFrame, least: int, seed: int = 42) -> DataFrame:
    """id, cluster: single linkage over mutual reachability, cut where most rows are in stable groups of `least` or
    more; -1 noise; k-means where that leaves two labels or fewer. In one task on at most MOST_LOCAL rows; beyond, the
    tree comes from tiles and only its n - 1 edges are in one task."""
    if not rows_bounded(data, MOST_LOCAL):
        n = data.count()
        size = max(5, min(least, n // 10))

        def label_tree(t: pa.Table) -> pa.Table:
            d, a, b = (t.column(c).to_numpy() for c in ("d", "a", "b"))
            ids = np.unique(np.concatenate([a, b]))
            tree = zip(d.tolist(), np.searchsorted(ids, a).tolist(), np.searchsorted(ids, b).tolist())
            return pa.table({"id": ids, "cluster": condensed(len(ids), sorted(tree), size).astype(np.int32)})

        found = materialize(reach_tree(data, size).groupBy().applyInArrow(label_tree, "id long, cluster int"), "density")
        return found if found.select("cluster").distinct().count() > 2 else kmeans(data, min(5, max(2, n // 20)), seed)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.array(pdf["vec"].tolist(), float)
        label = hdbscan(x, max(5, min(least, len(x) // 10)))
        if len(np.unique(label)) <= 2:
            label = lloyd(x, min(5, max(2, len(x) // 20)), seed)
        return pd.DataFrame({"id": pdf["id"], "cluster": label.astype(np.int32)})

    return data.groupBy().applyInPandas(work, "id long, cluster int")


def core_rank(least: int) -> int:
    """Which neighbour's distance is a row's core distance, for groups of `least` rows or more."""
    return max(2, least // 3)


def reach_tree(data: DataFrame, least: int) -> DataFrame:
    """g, d, a, b: the least spanning tree of all rows by mutual reachability. An edge of it is in the tree of every pair of
    blocks that holds both ends, so the trees of all pairs of blocks hold it; they are merged MERGED at a time."""
    core = neighbours(data, core_rank(least)).select("id", F.element_at("near", -1)["d"].alias("core"))
    blocks = max(2, -(-data.count() // TILE))
    rows = materialize(data.select(F.col("id").cast("long").alias("id"), "vec").join(core, "id").withColumn("i", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), "reach")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda j: j != F.col("i")))
    pairs = rows.withColumn("j", other).select((F.least("i", "j") * F.lit(blocks) + F.greatest("i", "j")).alias("g"), "id", "vec", "core")
    schema = "g long, d double, a long, b long"

    def tile(t: pa.Table) -> pa.Table:
        ids, core = t.column("id").to_numpy(), t.column("core").to_numpy()
        d, a, b = _prim(t.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1).astype(float), core)
        return pa.table({"g": np.full(len(d), t.column("g")[0].as_py(), np.int64), "d": d, "a": ids[a], "b": ids[b]})

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
        ids = np.unique(np.concatenate([t.column(c).to_numpy() for c in "ab"]))
        parent, kept = list(range(len(ids))), []
        for k, (a, b) in enumerate(zip(*(np.searchsorted(ids, t.column(c).to_numpy()).tolist() for c in "ab"))):
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a != b:
                parent[b] = a
                kept.append(k)
        return t.take(pa.array(kept, pa.int64()))

    # groups of few and many edges are dealt out by number, so that each merge takes at most MERGED trees
    edges, trees = pairs.withColumn("g", F.col("g").cast("long")).groupBy("g").applyInArrow(tile, schema), blocks * blocks
    while trees > 1:
        trees = -(-trees // MERGED)
        edges = edges.withColumn("g", F.floor(F.col("g") / MERGED)).groupBy("g").applyInArrow(merge, schema)
    return edges


def _prim(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and ends of the least spanning tree by mutual reachability, one row of distances at a time. The rows still
    outside are kept together at the front."""
    n = len(x)
    x, core, at = x.copy(), core.copy(), np.arange(n)
    best, link = np.full(n, np.inf), np.zeros(n, np.int64)
    d, a, b = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0), np.int64), np.empty(max(n - 1, 0), np.int64)
    i, left = 0, n
    for k in range(n - 1):
        own, own_core, own_at = x[i].copy(), core[i], at[i]
        left -= 1
        for v in (x, core, at, best, link):
            v[i] = v[left]
        gap = x[:left] - own
        far = np.maximum(np.maximum(np.sqrt(np.einsum("ij,ij->i", gap, gap)), own_core), core[:left])
        better = far < best[:left]
        best[:left][better], link[:left][better] = far[better], own_at
        i = int(best[:left].argmin())
        d[k], a[k], b[k] = best[i], link[i], at[i]
    return d, a, b


def hdbscan(x: np.ndarray, least: int) -> np.ndarray:
    """Condensed single-linkage tree of mutual reachability distances, clusters of greatest stability."""
    n = len(x)
    if n < 2 * least:
        return np.full(n, -1)
    core, rank = np.empty(n), core_rank(least)
    for s in range(0, n, 1024):
        core[s : s + 1024] = np.partition(som_math.distances(x[s : s + 1024], x), rank, axis=1)[:, rank]  # the row itself stands at 0
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    edges, i = [], 0
    for _ in range(n - 1):  # Prim's tree, one row of distances at a time
        inside[i] = True
        d = np.maximum(np.maximum(np.sqrt(((x - x[i]) ** 2).sum(1)), core[i]), core)
        better = ~inside & (d < best)
        best[better], link[better] = d[better], i
        i = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[i], link[i], i))
    edges.sort()
    return condensed(n, edges, least)


def condensed(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """Clusters of greatest stability in the tree of n rows whose edges are given, shortest first."""
    parent, node, size, children, height = list(range(n)), list(range(n)), [1] * n, {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    top = n
    for d, a, b in edges:
        a, b = find(a), find(b)
        children[top], height[top] = (node[a], node[b]), d
        parent[b] = a
        size.append(size[node[a]] + size[node[b]])
        node[a] = top
        top += 1
    lam = lambda d: 1.0 / max(d, 1e-12)

    def leaves(t: int) -> list[int]:
        out, stack = [], [t]
        while stack:
            u = stack.pop()
            (out.append(u) if u < n else stack.extend(children[u]))
        return out

    # walk down; a split into two parts of `least` or more starts two clusters
    clusters: list[dict] = []
    stack = [(top - 1, 0.0, -1)]
    while stack:
        t, birth, up = stack.pop()
        own = {"t": t, "up": up, "kids": [], "s": 0.0}
        me = len(clusters)
        clusters.append(own)
        if up >= 0:
            clusters[up]["kids"].append(me)
        u = t
        while u >= n:
            l, r = children[u]
            h = lam(height[u])
            if size[l] >= least and size[r] >= least:
                own["s"] += size[u] * (h - birth)
                stack += [(l, h, me), (r, h, me)]
                break
            small, big = (l, r) if size[l] < size[r] else (r, l)
            if size[big] < least:
                own["s"] += size[u] * (h - birth)
                break
            own["s"] += size[small] * (h - birth)
            u = big
    chosen = [False] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        kids = sum(clusters[k]["s"] for k in clusters[c]["kids"])
        if clusters[c]["up"] >= 0 and clusters[c]["s"] >= kids:
            chosen[c] = True
            todo = list(clusters[c]["kids"])
            while todo:
                k = todo.pop()
                chosen[k] = False
                todo += clusters[k]["kids"]
        else:
            clusters[c]["s"] = max(kids, clusters[c]["s"] if clusters[c]["up"] >= 0 else kids)
    label = np.full(n, -1)
    for k, c in enumerate(c for c in range(len(clusters)) if chosen[c]):
        label[leaves(clusters[c]["t"])] = k
    return label


def lloyd(x: np.ndarray, k: int, seed: int = 42, rounds: int = 50, times: np.ndarray | None = None) -> np.ndarray:
    """times: how often each row counts, once if not given."""
    rng = np.random.default_rng(seed)
    c = x[[int(rng.integers(len(x))) if times is None else int(rng.choice(len(x), p=times / times.sum()))]]
    while len(c) < min(k, len(x)):
        d = (som_math.distances(x, c) ** 2).min(1) * (1 if times is None else times)
        c = np.vstack([c, x[int(rng.choice(len(x), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(x)))]])
    for _ in range(rounds):
        a = som_math.distances(x, c).argmin(1)
        new = np.stack([np.average(x[a == j], axis=0, weights=None if times is None else times[a == j]) if (a == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return a


def kmeans(data: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """id, cluster by distributed k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = data.select("id", array_to_vector("vec").alias("features"))
    return KMeans(k=k, seed=seed, featuresCol="features").fit(v).transform(v).select("id", F.col("prediction").alias("cluster"))


def sub_clusters(points: DataFrame, group: str, least: int = 10, seed: int = 42) -> DataFrame:
    """group, id, sub: k-means of each group's 2-D points with k = min(4, n / least). A group of at most MOST_LOCAL points is one
    task; the larger ones are clustered all at once by jobs over their distinct points."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        k = min(4, len(pdf) // max(1, least))
        sub = lloyd(pdf[["x", "y"]].to_numpy(float), k, seed) if k >= 2 else np.zeros(len(pdf), int)
        return pd.DataFrame({group: pdf[group], "id": pdf["id"], "sub": sub.astype(np.int32)})

    points, schema = points.where(F.col(group).isNotNull()), f"{group} int, id long, sub int"
    sizes = points.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_LOCAL).collect()
    if not sizes:
        return points.groupBy(group).applyInPandas(work, schema)
    big = {r[group]: min(4, r["n"] // max(1, least)) for r in sizes}
    is_big = F.col(group).isin(list(big))
    small = points.where(~is_big).groupBy(group).applyInPandas(work, schema)
    return small.unionByName(_points_kmeans(points.where(is_big), group, big, seed))


def _points_kmeans(points: DataFrame, group: str, k_of: dict[int, int], seed: int, rounds: int = 50) -> DataFrame:
    """group, id, sub as by `lloyd` over each group's distinct points and their numbers: one task where these are at most
    MOST_LOCAL, else seeds drawn by squared distance and rounds of means as jobs over all such groups; the driver holds at most
    four centres a group."""
    spark = points.sparkSession
    held = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")  # those without a place get a null sub
    kinds = materialize(held.groupBy(group, "x", "y").agg(F.count(F.lit(1)).cast("double").alias("n")), "points")
    few = [r[group] for r in kinds.groupBy(group).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") <= MOST_LOCAL).collect()]

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["x", "y"])
        pdf["sub"] = lloyd(pdf[["x", "y"]].to_numpy(float), k_of[int(pdf[group].iloc[0])], seed, rounds, pdf["n"].to_numpy(float))
        return pdf.assign(x=pdf["x"] * pdf["n"], y=pdf["y"] * pdf["n"]).groupby([group, "sub"], as_index=False)[["x", "y", "n"]].sum()

    done: dict[int, list] = {}
    for r in kinds.where(F.col(group).isin(few)).groupBy(group).applyInPandas(means, f"{group} int, sub int, x double, y double, n double").orderBy(group, "sub").collect() if few else []:
        done.setdefault(r[group], []).append((r["x"] / r["n"], r["y"] / r["n"]))
    kinds = kinds.where(~F.col(group).isin(few))
    place = "struct<x:double,y:double>"
    gaps = F.transform("c", lambda c: (F.col("x") - c["x"]) * (F.col("x") - c["x"]) + (F.col("y") - c["y"]) * (F.col("y") - c["y"]))

    def near(rows: DataFrame, centres: dict) -> DataFrame:
        held = spark.createDataFrame([(g, [tuple(map(float, v)) for v in c]) for g, c in centres.items()], f"{group} int, c array<{place}>")
        rows = rows.join(F.broadcast(held), group).withColumn("ds", gaps)
        return rows.withColumn("d", F.array_min("ds")).withColumn("sub", (F.array_position("ds", F.col("d")) - 1).cast("int"))

    # the least of exponential times of rate weight is drawn in proportion to the weight
    draw = lambda weight, at: -F.log((F.pmod(F.xxhash64(group, "x", "y", F.lit(seed), F.lit(at)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))) / weight
    first = kinds.groupBy(group).agg(F.min_by(F.struct("x", "y"), draw(F.col("n"), 0)).alias("p")).collect() if len(few) < len(k_of) else []
    centres = {r[group]: [tuple(r["p"])] for r in first}
    for at in range(1, max((k_of[g] for g in centres), default=1)):
        drawn = near(kinds, {g: c for g, c in centres.items() if k_of[g] > at}).where("d > 0")
        for r in drawn.groupBy(group).agg(F.min_by(F.struct("x", "y"), draw(F.col("n") * F.col("d"), at)).alias("p")).collect():
            centres[r[group]].append(tuple(r["p"]))
    moving = {g: np.array(c, float) for g, c in centres.items()}
    centres = done | moving
    for _ in range(rounds if moving else 0):
        found = near(kinds, moving).groupBy(group, "sub").agg(*((F.sum(F.col(v) * F.col("n")) / F.sum("n")).alias(v) for v in "xy")).collect()
        new = {g: c.copy() for g, c in moving.items()}
        for r in found:
            new[r[group]][r["sub"]] = r["x"], r["y"]
        centres |= {g: c for g, c in new.items() if not np.allclose(c, moving[g])}
        moving = {g: c for g, c in new.items() if not np.allclose(c, moving[g])}
        if not moving:
            break
    return near(points, centres).select(F.col(group).cast("int").alias(group), F.col("id").cast("long").alias("id"), "sub")


def medians(points: DataFrame, group: str) -> DataFrame:
    """group, x, y: exact medians."""
    return points.where(F.col(group).isNotNull()).groupBy(group).agg(*(F.round(F.expr(f"percentile({c}, 0.5D)"), 6).alias(c) for c in ("x", "y")))


def nearest_titles(rows: DataFrame, group: str, top: int = 10) -> DataFrame:
    """group, id, cosine, rank: rows (id, group, vec) closest to their group's mean vector by cosine; ties by id."""
    mean = rows.select(group, F.posexplode("vec").alias("pos", "v")).groupBy(group, "pos").agg(F.avg("v").alias("m"))
    mean = mean.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    cos = dot("vec", "c") / F.nullif(F.sqrt(dot("vec", "vec")) * F.sqrt(dot("c", "c")), F.lit(0.0))
    c = rows.join(mean, group).select(group, "id", F.round(F.coalesce(cos, F.lit(0.0)), 6).alias("cosine"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("cosine"), "id"))).where(F.col("rank") <= top)
