"""Exact nearest rows through a partition index.

A router, fitted on a bounded sample, sends every row to its own part, and as a query to the `probes`
most probable parts, where distances are exact. Each part keeps a number of balls, and the rows of a
ball lie in rings around its centre (least and greatest distance, over all rows). By the triangle
inequality a ring farther from the query than its k-th distance holds no nearer row; where some ring
may, its part is searched in a second pass, the inner rings and the scattered rows beyond them by
themselves. So the result is exact whatever the router is, and the second pass is short where the
parts follow the data's groups. The number of parts grows with the square root of the rows.

Rows of a part are split into tiles of bounded size (row blocks by query blocks), so a part that
holds a third of all rows is many tasks, not one. Equal vectors are searched once. Tables of many rows
are searched by some of the queries at a time, and what a step has written for itself is removed.

Results: the k nearest others by (distance, id): of rows at the same distance the smaller id, however
many they are and however the tiles fall. Copies are at distance 0. A table of one row or none has no
neighbours. Distances are summed from differences, so that vectors far from the origin keep theirs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import discard, materialize, spread

#: Least and most rows of the sample, sample rows a part, balls of all parts and of one, rings of a ball, parts probed, rows of a tile.
SAMPLE, MOST_SAMPLE, PER_PART, BALLS, PART_BALLS, RINGS, PROBES, TILE = 6_000, 24_000, 12, 3_072, 64, 8, 3, 4_096
#: Pairs whose distances are summed at a time, and queries that are searched at a time, in at most so many turns.
PAIRS, TURN, MOST_TURNS = 200_000, 250_000, 8
NEAR = "array<struct<d:double,id:long>>"


def matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * a @ b.T, 0.0)


def spread_seeds(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds by distance-squared sampling, so that separate groups get seeds of their own."""
    seeds = [int(rng.integers(len(x)))]
    d = squares(x, x[seeds])[:, 0]
    while len(seeds) < n and d.max() > 0:
        seeds.append(int(rng.choice(len(x), p=d / d.sum())))
        d = np.minimum(d, squares(x, x[seeds[-1:]])[:, 0])
    return np.array(seeds)


class Centres:
    """The plain router: parts by their nearest centre, spread-out seeds moved by a few rounds of means."""

    def __init__(self, x: np.ndarray, parts: int, seed: int = 7):
        c = x[spread_seeds(x, parts, np.random.default_rng(seed))]
        for _ in range(5):
            a = squares(x, c).argmin(1)
            n = np.bincount(a, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, a, x)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.c, self.parts = c, len(c)

    def ranked(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable parts of each row, best first."""
        d, m = squares(x, self.c), min(m, self.parts)
        top = np.argpartition(d, m - 1, axis=1)[:, :m]
        return np.take_along_axis(top, np.argsort(np.take_along_axis(d, top, 1), axis=1, kind="stable"), 1)


#: From the centred sample and a number of parts to a router (parts, ranked).
Fit = Callable[[np.ndarray, int], object]


@dataclass
class Index:
    """What is sent to the tasks: of a fixed number of balls, whatever the rows."""

    mean: np.ndarray
    router: object
    centres: np.ndarray
    of: np.ndarray
    inner: np.ndarray

    def ring(self, far: np.ndarray, ball: np.ndarray) -> np.ndarray:
        """0 within the inner radius, then one ring for each doubling."""
        inner = self.inner[ball]
        return np.where(far <= inner, 0, 1 + np.clip(np.log2(np.maximum(far, 1e-300) / inner), 0, RINGS - 2).astype(np.int64)).astype(np.int32)


def parts_for(n: int) -> int:
    """One part, and so no index, for what is a few tiles."""
    return min(MOST_SAMPLE // PER_PART, int(n**0.5 / 2)) if n > 3 * TILE else 1


def fit_index(rows: DataFrame, fit: Fit, parts: int) -> Index:
    """Router, ball centres, the part of each ball and its inner radius, from a sample of rows chosen by hash."""
    most = min(MOST_SAMPLE, max(SAMPLE, PER_PART * parts))
    x = np.array(rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(most).toPandas()["vec"].tolist(), np.float64)
    mean = x.mean(0)
    x = x - mean
    router = fit(x, max(1, min(parts, len(x) // 8)))
    part = router.ranked(x, 1)[:, 0]
    balls = max(4, min(PART_BALLS, BALLS // router.parts))
    rng, centres, of, wide = np.random.default_rng(11), [], [], []
    for p in range(router.parts):
        own = x[part == p]
        if not len(own):
            own = x[:1]
        c = own[spread_seeds(own, balls, rng)]
        for _ in range(4):
            a = squares(own, c).argmin(1)
            c = np.stack([own[a == j].mean(0) if (a == j).any() else c[j] for j in range(len(c))])
        centres.append(c)
        of += [p] * len(c)
        d = squares(own, c)
        far, a = np.sqrt(d.min(1)), d.argmin(1)
        wide += [float(np.quantile(far[a == j], 0.9)) if (a == j).any() else 0.0 for j in range(len(c))]
    typical = float(np.median([w for w in wide if w > 0] or [1.0]))
    return Index(mean, router, np.concatenate(centres), np.array(of), 3 * np.maximum(wide, typical))


def k_best(q: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, squared distance, id) of the k nearest others of each query, nearest first. The cut is made on the
    quick form of the square, with room for its rounding, and every row at or below it is summed exactly."""
    mean = x.mean(0)
    xc, yc, take = x - mean, y - mean, min(k, len(ids))
    xx, yy = (xc * xc).sum(1), (yc * yc).sum(1)
    room = 1e-12 * (yy + xx.max())
    step, found = max(1, 2_000_000 // len(ids)), ([], [], [])
    for s in range(0, len(q), step):
        d = yy[s : s + step, None] + xx[None] - 2.0 * yc[s : s + step] @ xc.T
        d[q[s : s + step, None] == ids[None]] = np.inf
        cut = np.partition(d, take - 1, axis=1)[:, take - 1] + room[s : s + step]
        i, j = np.nonzero((d <= cut[:, None]) & np.isfinite(d))
        exact = np.concatenate([((y[s + i[a : a + PAIRS]] - x[j[a : a + PAIRS]]) ** 2).sum(-1) for a in range(0, len(i), PAIRS)] or [np.empty(0)])
        order = np.lexsort((ids[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(min(step, len(q) - s)))
        keep = np.arange(len(i)) - first[i] < k
        for out, v in zip(found, (s + i[keep], exact[keep], ids[j[keep]])):
            out.append(v)
    return tuple(np.concatenate(v) for v in found)


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """rows (part, id, vec), queries (part, q, vec) -> q, near: list of (squared distance, id), the k nearest in the queried
    parts. Tiles are keyed by (part, row block, query block), each of bounded size."""
    rb = rows.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("rb"))
    qb = queries.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("qb"))
    sizes = rb.join(qb, "part")
    left = rows.join(sizes, "part").withColumn("r", F.pmod(F.xxhash64("id"), F.col("rb")).cast("int")).select(F.col("part").alias("part"), "r", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("s"), F.col("id").alias("id"), F.col("vec").alias("x"))
    right = queries.join(sizes, "part").withColumn("s", F.pmod(F.xxhash64("q"), F.col("qb")).cast("int")).select(F.col("part").alias("part"), F.explode(F.sequence(F.lit(0), F.col("rb") - 1)).alias("r"), "s", F.col("q").alias("q"), F.col("vec").alias("y"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"q": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())])))})
        q = b.column("q").to_numpy()
        at, d, i = k_best(q, matrix(b.column("y")), a.column("id").to_numpy(), matrix(a.column("x")), k)
        flat = pa.StructArray.from_arrays([pa.array(d), pa.array(i)], ["d", "id"])
        offs = np.r_[0, np.bincount(at, minlength=len(q)).cumsum()].astype(np.int32)
        return pa.table({"q": pa.array(q), "near": pa.ListArray.from_arrays(pa.array(offs), flat)})

    return left.groupBy("part", "r", "s").cogroup(right.groupBy("part", "r", "s")).applyInArrow(tile, f"q long, near {NEAR}")


def merge(found: DataFrame, k: int) -> DataFrame:
    """q, near: the k nearest over all tiles of a query, by (distance, id)."""
    return found.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))


def nearest(rows: DataFrame, k: int, fit: Fit = Centres, parts: int | None = None, probes: int = PROBES, certify: bool = True) -> DataFrame:
    """q, near (list of (squared distance, id)): the k nearest other rows of each row of `rows` (id, vec; vectors distinct).
    certify: search also the parts that may hold a nearer row; without it the parts probed are all that is searched."""
    spark = rows.sparkSession
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], f"q long, near {NEAR}")
    parts = parts or parts_for(n)
    if parts == 1:
        whole = rows.select(F.lit(0).alias("part"), "id", "vec")
        return merge(search(whole, whole.withColumnRenamed("id", "q"), k), k)
    kind = rows.schema["vec"].dataType.simpleString()
    index = fit_index(rows, fit, parts)
    sent = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1)) - index.mean
            probed = index.router.ranked(x, probes)
            ball, far = np.empty(len(x), np.int32), np.empty(len(x))
            for p in np.unique(probed[:, 0]):
                m, own = probed[:, 0] == p, np.flatnonzero(index.of == p)
                d = squares(x[m], index.centres[own])
                ball[m], far[m] = own[d.argmin(1)], np.sqrt(d.min(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(probed[:, 0].astype(np.int32)), pa.array(list(probed.astype(np.int32))), pa.array(ball), pa.array(index.ring(far, ball)), pa.array(far)], ["id", "vec", "own", "probed", "ball", "ring", "far"])

    indexed = materialize(spread(rows.select("id", "vec")).mapInArrow(place, f"id long, vec {kind}, own int, probed array<int>, ball int, ring int, far double"), "indexed")
    # at most balls x rings rows, whatever the table's size
    rings = indexed.groupBy("ball", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    # inner rows are searched by part, the scattered rows by themselves, in so many groups that each is a few tiles
    groups = int(max(1, min(index.router.parts, -(-sum(r["n"] for r in rings if r["ring"]) // (4 * TILE)))))
    table = indexed.select(F.when(F.col("ring") > 0, -1 - F.col("own") % groups).otherwise(F.col("own")).alias("part"), "id", "vec")
    queries = indexed.select(F.explode("probed").alias("part"), F.col("id").alias("q"), "vec")
    turns = max(1, min(MOST_TURNS, n // TURN))

    def in_turns(queries: DataFrame, name: str, known: DataFrame | None = None) -> list[DataFrame]:
        """The merged lists, the queries taken in turns, so that the files of one turn are gone before the next."""
        out = []
        for t in range(turns):
            mine = lambda df: df.where(F.pmod(F.xxhash64("q", F.lit(5)), F.lit(turns)) == t) if turns > 1 else df  # noqa: B023, E731
            got = search(table, mine(queries), k)
            out.append(materialize(merge(got if known is None else mine(known).unionByName(got), k), name))
        return out

    firsts = in_turns(queries, "near")
    first = reduce(DataFrame.unionByName, firsts)
    if not certify:
        return first
    ring_of = spark.sparkContext.broadcast(tuple(np.array([r[c] for r in rings]) for c in ("ball", "ring", "low", "high")))

    def open_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (ball, ring, low, high) = sent.value, ring_of.value
        unit = np.where(ring > 0, -1 - index.of[ball] % groups, index.of[ball])
        order = np.argsort(unit, kind="stable")
        starts = np.flatnonzero(np.r_[True, unit[order][1:] != unit[order][:-1]])
        names, ball, low, high = unit[order][starts], ball[order], low[order], high[order]
        reach = np.sqrt((index.centres**2).sum(1).max())
        step = max(64, 3_000_000 // len(ball))
        for big in batches:
            for at in range(0, big.num_rows, step):
                b = big.slice(at, step)
                x, limit = matrix(b.column(1)) - index.mean, b.column(3).to_numpy(zero_copy_only=False)
                d = np.sqrt(squares(x, index.centres))[:, ball]
                least = np.minimum.reduceat(np.maximum(d - high[None], low[None] - d), starts, axis=1)
                # room for the rounding of distances to centres
                hit = least <= (limit * (1 + 1e-9) + 1e-6 * (np.sqrt((x * x).sum(1)) + reach))[:, None]
                done = matrix(b.column(2)).astype(np.int64)
                p = np.minimum(np.searchsorted(names, done), len(names) - 1)
                u, v = np.nonzero(names[p] == done)
                hit[u, p[u, v]] = False
                i, u = np.nonzero(hit)
                yield pa.RecordBatch.from_arrays([pa.array(names[u].astype(np.int32)), b.column(0).take(pa.array(i)), b.column(1).take(pa.array(i))], ["part", "q", "vec"])

    limit = F.when(F.size("near") >= k, F.sqrt(F.get("near", F.lit(k - 1))["d"])).otherwise(F.lit(float("inf")))
    waiting = indexed.join(first.select(F.col("q").alias("id"), limit.alias("limit")), "id", "left").select("id", "vec", "probed", F.coalesce("limit", F.lit(float("inf"))).alias("limit"))
    again = materialize(waiting.mapInArrow(open_units, f"part int, q long, vec {kind}"), "again")
    found = in_turns(again, "found", first)
    discard(indexed, *firsts, again)
    return reduce(DataFrame.unionByName, found)


def nearest_within(rows: DataFrame, by: str, k: int) -> DataFrame:
    """q, near: the k nearest others within each value of `by` (rows: by, id, vec), in tiles of bounded size."""
    own = rows.select(F.coalesce(F.col(by).cast("string"), F.lit("")).alias("part"), "id", "vec")
    return merge(search(own, own.withColumnRenamed("id", "q"), k), k)


def distinct_vectors(rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, id (smallest), vec, ids (the k + 1 smallest ids): one row per distinct vector (of each value of by). The rank filter
    cuts each task's rows before the shuffle, so a vector with many copies is no large group."""
    rank = F.row_number().over(Window.partitionBy(*by, "vec").orderBy("id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).groupBy(*by, "vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(*by, F.col("ids")[0].alias("id"), "vec", "ids")


def neighbour_lists(rows: DataFrame, k: int, search_distinct: Callable[..., DataFrame] = nearest, **how) -> DataFrame:
    """id, near (list of (squared distance, id)): the k nearest others of each row of `rows` (id long, vec), copies included."""
    kinds = materialize(distinct_vectors(rows, k), "kinds")
    found = search_distinct(kinds, k, **how)
    # a neighbour stands for its copies: at most k ids of it can be among the k nearest
    near = found.select("q", F.explode("near").alias("n")).join(kinds.select(F.col("id").alias("nid"), F.col("ids").alias("nids")), F.col("n.id") == F.col("nid"))
    lists = near.groupBy("q").agg(F.flatten(F.collect_list(F.transform("nids", lambda i: F.struct(F.col("n.d").alias("d"), i.alias("id"))))).alias("others"))
    own = kinds.select("id", "vec", "ids").join(lists, F.col("id") == F.col("q"), "left")
    copies = own.where(F.size("ids") > 1).select("vec", "ids", "others").join(rows.select(F.col("id").alias("me"), "vec"), "vec")
    many = own.where(F.size("ids") == 1).select(F.col("id").alias("me"), "ids", "others").unionByName(copies.select("me", "ids", "others"))
    pool = F.concat(F.transform("ids", lambda i: F.struct(F.lit(0.0).alias("d"), i.alias("id"))), F.coalesce("others", F.array().cast(NEAR)))
    return many.select(F.col("me").alias("id"), F.slice(F.array_sort(F.filter(pool, lambda n: n["id"] != F.col("me"))), 1, k).alias("near"))
