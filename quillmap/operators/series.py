"""Time series per entity: smoothing, windows, trajectories.

A series is gathered as one ordered array per (entity, indicator): a series has one value per
period, so its array is short. Null values count as 0; equal times are ordered by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gather(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, ts, vs: ordered arrays."""
    pts = F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))))
    return df.where(F.col(t).isNotNull()).groupBy(*keys).agg(pts.alias("p")).select(*keys, F.transform("p", lambda x: x["t"]).alias("ts"), F.transform("p", lambda x: x["v"]).alias("vs"))


def ewm(values: Column, span: int) -> Column:
    """e0 = x0, e_t = a x_t + (1 - a) e_(t-1), a = 2 / (span + 1)."""
    a = 2.0 / (span + 1)
    empty = F.array().cast("array<double>")
    return F.aggregate(values, empty, lambda s, x: F.array_append(s, F.when(F.size(s) == 0, x).otherwise(a * x + (1 - a) * F.element_at(s, -1))))


def centred_mean(values: Column, window: int) -> Column:
    """Mean over a centred window that shrinks on both sides alike at the ends."""
    n = F.size(values)
    return F.transform(values, lambda _, i: _mean(F.slice(values, i - _half(i, n, window) + 1, 2 * _half(i, n, window) + 1)))


def _half(i: Column, n: Column, window: int) -> Column:
    return F.least(F.lit(window // 2), i, n - 1 - i)


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def smoothed(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """keys, t, raw, ecma3, ecma5 (round 6)."""
    g = gather(df, keys, t, value)
    rows = g.select(*keys, F.explode(F.arrays_zip("ts", "vs", ewm(F.col("vs"), 3).alias("e3"), ewm(F.col("vs"), 5).alias("e5"))).alias("z"))
    return rows.select(*keys, F.col("z.ts").alias(t), F.round("z.vs", 6).alias("raw"), F.round("z.e3", 6).alias("ecma3"), F.round("z.e5", 6).alias("ecma5"))


def moving(df: DataFrame, keys: list[str], t: str, value: str, window: int) -> DataFrame:
    """keys, t, raw, mean (round 6)."""
    g = gather(df, keys, t, value)
    rows = g.select(*keys, F.explode(F.arrays_zip("ts", "vs", centred_mean(F.col("vs"), window).alias("m"))).alias("z"))
    return rows.select(*keys, F.col("z.ts").alias(t), F.round("z.vs", 6).alias("raw"), F.round("z.m", 6).alias("mean"))


def paths(df: DataFrame, entity: str, t: str, node: str) -> DataFrame:
    """entity, path: the nodes of an entity in the order of t."""
    return df.where(F.col(t).isNotNull()).groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(t, node))), lambda x: x[node]).alias("path"))
