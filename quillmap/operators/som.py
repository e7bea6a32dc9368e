"""Self-organizing maps: training, assignment and the maps read off them.

Data: id, vec (array of double). Neurons: idx, x, y, w and more; a map is bounded (MOST_NEURONS), so
its weights are sent to the tasks. Rows whose vector is null, of another length or holds null or NaN
are left out of training and assignment. Ties between neurons go to the smaller index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import som_math as m
from ..runtime import spread

MOST_NEURONS = 10_000


def clean(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    ok = F.col(vec_col).isNotNull() & (F.size(vec_col) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return df.where(ok).select(F.col(id_col).alias("id"), v.alias("vec"))


def _stack(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(float)


def hex_grid(spark: SparkSession, rows: int, cols: int) -> DataFrame:
    """idx, row, col, x, y."""
    i = F.col("id").cast("int")
    g = spark.range(rows * cols).select(i.alias("idx"), F.floor(i / cols).cast("int").alias("row"), (i % cols).alias("col"))
    y = F.sqrt(F.lit(3.0)) * F.col("row") + F.when(F.col("col") % 2 == 1, F.sqrt(F.lit(3.0)) / 2).otherwise(0.0)
    return g.select("*", F.round(1.5 * F.col("col"), 6).alias("x"), F.round(y, 6).alias("y"))


def moments(data: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """n, sums, products (X'X) and (min, max) of the vectors, from one partial row per task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g, lo, hi = 0, None, None, None, None
        for b in batches:
            if b.num_rows:
                x = _stack(b.column(0))
                s, g = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), g + x.T @ x)
                lo, hi = (x.min(0), x.max(0)) if lo is None else (np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), *(pa.array([v.ravel().tolist()]) for v in (s, g, lo, hi))], ["n", "s", "g", "lo", "hi"])

    parts = data.select("vec").mapInArrow(part, "n long, s array<double>, g array<double>, lo array<double>, hi array<double>").collect()
    if not parts:
        raise ValueError("no usable rows")
    d = len(parts[0]["s"])
    total = lambda k: np.sum([p[k] for p in parts], axis=0)
    return int(sum(p["n"] for p in parts)), total("s"), total("g").reshape(d, d), np.stack([np.min([p["lo"] for p in parts], 0), np.max([p["hi"] for p in parts], 0)])


def init_weights(data: DataFrame, rows: int, cols: int, how: str = "pca", seed: int = 42) -> np.ndarray:
    """pca and linear: the plane of the main components; else uniform between each feature's bounds."""
    n, s, g, bounds = moments(data)
    if how in ("pca", "linear"):
        mean = s / n
        return m.linear_init(mean, g / max(1, n - 1) - np.outer(mean, mean) * n / max(1, n - 1), rows, cols)
    return np.random.default_rng(seed).uniform(bounds[0], bounds[1], (rows * cols, len(s)))


def assign(data: DataFrame, weights: np.ndarray, metric: str = "euclidean") -> DataFrame:
    """id, bmu, distance: the nearest neuron of each row."""
    if len(weights) > MOST_NEURONS:
        raise ValueError(f"more than {MOST_NEURONS} neurons")
    sent = data.sparkSession.sparkContext.broadcast(np.asarray(weights, float))
    kind = data.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = m.distances(_stack(b.column(1)), sent.value, metric)
                k = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k.astype(np.int32)), pa.array(d[np.arange(len(d)), k])], ["id", "bmu", "distance"])

    return spread(data.select("id", "vec")).mapInArrow(work, f"id {kind}, bmu int, distance double")


def epoch_sums(data: DataFrame, weights: np.ndarray, metric: str = "euclidean") -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of rows, counts and summed distance by best-matching neuron: one partial row per task reaches the driver."""
    sent = data.sparkSession.sparkContext.broadcast(np.asarray(weights, float))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        s, c, e = np.zeros_like(w), np.zeros(len(w)), 0.0
        for b in batches:
            if b.num_rows:
                x = _stack(b.column(0))
                d = m.distances(x, w, metric)
                k = d.argmin(1)
                np.add.at(s, k, x)
                c += np.bincount(k, minlength=len(w))
                e += float(d[np.arange(len(d)), k].sum())
        yield pa.RecordBatch.from_arrays([pa.array([s.ravel().tolist()]), pa.array([c.tolist()]), pa.array([e])], ["s", "c", "e"])

    parts = data.select("vec").mapInArrow(part, "s array<double>, c array<double>, e double").collect()
    w = np.asarray(weights)
    return np.sum([p["s"] for p in parts], 0).reshape(w.shape), np.sum([p["c"] for p in parts], 0), float(sum(p["e"] for p in parts))


def train_batch(data: DataFrame, rows: int, cols: int, epochs: int, init: str = "pca", metric: str = "euclidean", seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """Weights and the mean quantization error before each epoch. The neighbourhood shrinks from half the longer side
    exponentially to 0.1. Exact: the kernel depends on the best-matching neuron only, so sums per neuron suffice."""
    data = data.cache()
    w, pos = init_weights(data, rows, cols, init, seed), m.grid(rows, cols)
    start, errors = max(rows, cols) / 2, []
    for t in range(epochs):
        s, c, e = epoch_sums(data, w, metric)
        errors.append(e / max(1.0, c.sum()))
        w = m.batch_update(w, s, c, m.kernel(pos, max(0.1, start * np.exp(-t / max(1, epochs)))))
    return w, errors


def train_online(data: DataFrame, rows: int, cols: int, epochs: int, rate: float = 0.5, seed: int = 42, most_rows: int = 200_000) -> DataFrame:
    """idx, w: one row at a time, in a seeded order. Sequential by nature, so in one task and on at most most_rows rows; use train_batch beyond."""
    if data.limit(most_rows + 1).count() > most_rows:
        raise ValueError(f"online training takes at most {most_rows} rows; use train_batch")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("id")["vec"].tolist(), float)
        rng, pos = np.random.default_rng(seed), m.grid(rows, cols)
        w, start, steps, k = rng.uniform(x.min(0), x.max(0), (rows * cols, x.shape[1])), max(rows, cols) / 2, epochs * len(x), 0
        for t in range(epochs):
            h = m.kernel(pos, max(start * np.exp(-t / max(1, epochs)), 1e-3))
            for i in rng.permutation(len(x)):
                w += rate * (1 - k / steps) * h[((w - x[i]) ** 2).sum(1).argmin()][:, None] * (x[i] - w)
                k += 1
        return pd.DataFrame({"idx": np.arange(len(w), dtype=np.int32), "w": list(w)})

    return data.groupBy().applyInPandas(work, "idx int, w array<double>")


def neurons_frame(spark: SparkSession, weights: np.ndarray, rows: int, cols: int) -> DataFrame:
    pos = m.grid(rows, cols)
    return spark.createDataFrame([(int(i), float(pos[i, 0]), float(pos[i, 1]), [float(v) for v in weights[i]]) for i in range(len(weights))], "idx int, x double, y double, w array<double>")


def _l2(a: str, b: str):
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def hits(assigned: DataFrame, neurons: DataFrame) -> DataFrame:
    """idx, frequency, error: rows per neuron and their mean distance, each by its maximum; neurons without rows at 0."""
    g = assigned.groupBy(F.col("bmu").alias("idx")).agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("e"))
    all_ = neurons.select("idx").join(g, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("e", F.lit(0.0)).alias("e"))
    w = Window.partitionBy()
    part = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.nullif(F.max(c).over(w), F.lit(0))), F.lit(0.0)), 6)
    return all_.select("idx", part("n").alias("frequency"), part("e").alias("error"))


def _neighbours(neurons: DataFrame, run: str, reach: float = 1.85) -> DataFrame:
    """run, idx, w, nidx, nw: neurons of one run at a grid distance above 0 and under reach. An equi-join on square
    cells of that size and the eight around each, so a map of many neurons isn't paired with itself."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("int")
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    a = neurons.select("*", cell("x").alias("_cx"), F.explode(around).alias("_dx")).select("*", (F.col("_cx") + F.col("_dx")).alias("_x"), cell("y").alias("_cy"), F.explode(around).alias("_dy")).withColumn("_y", F.col("_cy") + F.col("_dy"))
    other = neurons.select(F.col(run), cell("x").alias("_x"), cell("y").alias("_y"), F.col("idx").alias("nidx"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("w").alias("nw"))
    d = F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2)
    return a.join(other, [run, "_x", "_y"]).where((d > 0) & (d < reach))


def umatrix(neurons: DataFrame, run: str) -> DataFrame:
    """run, idx, u: mean weight distance to the grid neighbours; 0 for a neuron without any."""
    g = _neighbours(neurons.select(run, "idx", "x", "y", "w"), run).groupBy(run, "idx").agg(F.avg(_l2("w", "nw")).alias("u"))
    return neurons.select(run, "idx").join(g, [run, "idx"], "left").select(run, "idx", F.round(F.coalesce("u", F.lit(0.0)), 6).alias("u"))


def borders(neurons: DataFrame, run: str, rows_per_col: str = "row", col: str = "col") -> DataFrame:
    """run, idx, side, outside: sides of a cell where the neighbour has another cluster or there is none.
    Sides 0..5 by offsets that depend on the parity of the column."""
    spark = neurons.sparkSession
    even = [(0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 0), (4, 0, -1), (5, -1, -1)]
    odd = [(0, -1, 0), (1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, -1), (5, 0, -1)]
    offsets = spark.createDataFrame([(p, *o) for p, s in ((0, even), (1, odd)) for o in s], "parity int, side int, dr int, dc int")
    a = neurons.select(run, "idx", rows_per_col, col, "cluster").withColumn("parity", F.col(col) % 2)
    wanted = a.join(F.broadcast(offsets), "parity").select(run, "idx", "cluster", "side", (F.col(rows_per_col) + F.col("dr")).alias("r"), (F.col(col) + F.col("dc")).alias("c"))
    b = neurons.select(F.col(run), F.col(rows_per_col).alias("r"), F.col(col).alias("c"), F.col("cluster").alias("other"), F.lit(True).alias("there"))
    joined = wanted.join(b, [run, "r", "c"], "left")
    return joined.where(F.col("there").isNull() | ~F.col("cluster").eqNullSafe(F.col("other"))).select(run, "idx", "side", F.col("there").isNull().alias("outside"))


def centroids(neurons: DataFrame, *keys: str) -> DataFrame:
    """keys, cluster, pos, mean: mean weight of the cluster's neurons by dimension (round 6)."""
    return neurons.where("cluster is not null").select(*keys, "cluster", F.posexplode("w").alias("pos", "v")).groupBy(*keys, "cluster", "pos").agg(F.round(F.avg("v"), 6).alias("mean"))


def centroid_vectors(neurons: DataFrame, *keys: str) -> DataFrame:
    return centroids(neurons, *keys).groupBy(*keys, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("centre"))


def nearest_entities(neurons: DataFrame, labels: str, top: int, *keys: str) -> DataFrame:
    """keys, cluster, label, distance, rank: labels of the cluster's neurons, nearest to its centroid first."""
    rows = neurons.where("cluster is not null").select(*keys, "cluster", "w", F.explode(labels).alias("label"))
    d = rows.join(centroid_vectors(neurons, *keys), [*keys, "cluster"]).select(*keys, "cluster", "label", F.round(_l2("w", "centre"), 6).alias("distance"))
    d = d.groupBy(*keys, "cluster", "label").agg(F.min("distance").alias("distance"))
    r = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy("distance", "label"))
    return d.withColumn("rank", r).where(F.col("rank") <= top)


def summary(neurons: DataFrame, dims: int, *keys: str) -> DataFrame:
    """keys, cluster, pos, mean, rank: the `dims` dimensions with the greatest means of each cluster."""
    r = F.row_number().over(Window.partitionBy(*keys, "cluster").orderBy(F.desc("mean"), "pos"))
    return centroids(neurons, *keys).withColumn("rank", r).where(F.col("rank") <= dims)


def visual_centre(neurons: DataFrame, *keys: str) -> DataFrame:
    """keys, cluster, idx: the member neuron nearest to the mean position (ties: the smaller index)."""
    rows = neurons.where("cluster is not null")
    w = Window.partitionBy(*keys, "cluster")
    d2 = (F.col("x") - F.avg("x").over(w)) ** 2 + (F.col("y") - F.avg("y").over(w)) ** 2
    return rows.select(*keys, "cluster", "idx", F.round(d2, 6).alias("d2")).groupBy(*keys, "cluster").agg(F.min(F.struct("d2", "idx")).alias("m")).select(*keys, "cluster", F.col("m.idx").alias("idx"))


def component_stats(neurons: DataFrame, *keys: str) -> DataFrame:
    """keys, pos, low, high, mean of each weight dimension."""
    return neurons.select(*keys, F.posexplode("w").alias("pos", "v")).groupBy(*keys, "pos").agg(F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"), F.round(F.avg("v"), 6).alias("mean"))


def neuron_labels(assigned: DataFrame, labels: DataFrame) -> DataFrame:
    """bmu, labels: the sorted labels (id, label) of a neuron's rows."""
    return assigned.join(labels, "id").groupBy("bmu").agg(F.array_sort(F.collect_list("label")).alias("labels"))


def row_clusters(assigned: DataFrame, neurons: DataFrame) -> DataFrame:
    """id, bmu, cluster: each row with the cluster of its neuron."""
    return assigned.join(F.broadcast(neurons.select(F.col("idx").alias("bmu"), "cluster")), "bmu", "left").select("id", "bmu", "cluster")


def move_label(neurons: DataFrame, labels: str, label: str, source: int, target: int) -> DataFrame:
    """The label taken from one neuron's list and put at the end of another's."""
    has = F.coalesce(F.array_contains(F.col(labels), label), F.lit(False))
    out = F.when((F.col("idx") == source) & has, F.array_remove(labels, label)).when((F.col("idx") == target) & ~has, F.array_append(F.coalesce(labels, F.array().cast("array<string>")), F.lit(label))).otherwise(F.col(labels))
    return neurons.withColumn(labels, out)


def cluster_runs(neurons: DataFrame, run: str, how: str = "ward", k: int = 4, eps: float = 0.5, least: int = 3) -> DataFrame:
    """run, idx, cluster: the neurons of each run clustered in one task per run (a map is bounded)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MOST_NEURONS:
            raise ValueError(f"more than {MOST_NEURONS} neurons")
        pdf = pdf.sort_values("idx")
        x = np.array(pdf["w"].tolist(), float)
        label = m.dbscan(m.zscore(x), eps, least) if how == "dbscan" else m.ward(x, k)
        return pd.DataFrame({run: pdf[run], "idx": pdf["idx"], "cluster": label.astype(np.int32)})

    return neurons.select(run, "idx", "w").groupBy(run).applyInPandas(work, f"{run} string, idx int, cluster int")


def evaluate(neurons: DataFrame, run: str, most_k: int = 15) -> DataFrame:
    """run, k, silhouette, davies_bouldin, calinski_harabasz of Ward clusters for k from 2."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf.sort_values("idx")["w"].tolist(), float)
        rows = [(k, *m.cluster_scores(x, m.ward(x, k))) for k in range(2, min(most_k, len(x) - 1) + 1)]
        out = pd.DataFrame(rows, columns=["k", "silhouette", "davies_bouldin", "calinski_harabasz"]).round(6)
        out.insert(0, run, pdf[run].iloc[0])
        return out

    return neurons.select(run, "idx", "w").groupBy(run).applyInPandas(work, f"{run} string, k int, silhouette double, davies_bouldin double, calinski_harabasz double")


def scores_of(neurons: DataFrame, *keys: str) -> DataFrame:
    """keys, clusters, calinski_harabasz, davies... of given clusters as plain aggregations: within and between squares."""
    rows = neurons.where("cluster is not null").select(*keys, "cluster", "idx", F.posexplode("w").alias("pos", "v"))
    c = rows.groupBy(*keys, "cluster", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    total = c.groupBy(*keys, "pos").agg(F.sum("n").alias("total_n"), F.sum("s").alias("total_s"))
    parts = c.join(total, [*keys, "pos"])
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("total_s") / F.col("total_n")) ** 2)
    g = parts.groupBy(*keys).agg(within.alias("w"), between.alias("b"), F.max("total_n").alias("rows"), F.countDistinct("cluster").alias("k"))
    ch = F.try_divide(F.col("b") / F.nullif(F.col("k") - 1, F.lit(0)), F.col("w") / F.nullif(F.col("rows") - F.col("k"), F.lit(0)))
    return g.select(*keys, "k", F.round(ch, 3).alias("calinski_harabasz"))


def map_size(data: DataFrame) -> tuple[int, int]:
    """Suggested rows and columns from the number of rows and the two main singular values of the (uncentred) data."""
    n, _, g, _ = moments(data)
    values = np.sqrt(np.maximum(np.sort(np.linalg.eigvalsh(g))[::-1], 0))
    ratio = values[0] / values[1] if len(values) > 1 and values[1] > 0 else 1.0
    return m.suggest_size(n, float(ratio))
