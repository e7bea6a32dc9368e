"""Indicators: derived ratios, baselines, profiles, rollups, growth, rankings.

Tables are long or have one row per (entity, year). Nulls count as 0 where a profile or ratio is
made; a division by zero or null gives 0; rows whose entity is null or blank drop out after a cut;
entities containing "baseline" (in any case) are reference rows. Ties are broken by entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import global_rank, with_group, with_total


def is_baseline(entity: Column) -> Column:
    return F.coalesce(F.contains(F.lower(entity), F.lit("baseline")), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null or a is null."""
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def derive(df: DataFrame, docs: str, cited: str, patents: str, baseline: DataFrame, by: str) -> DataFrame:
    """Adds share (percent of the baseline's documents of the same `by`), impact and patents_per_paper. baseline: by, docs."""
    base = baseline.select(by, F.col(docs).alias("base"))
    out = df.join(base, by, "left")
    share = ratio(F.col(docs), F.col("base")) * 100
    return out.withColumn("share", F.round(share, 6)).withColumn("impact", F.round(ratio(F.col(cited), F.col(docs)), 6)).withColumn("patents_per_paper", F.round(ratio(F.col(patents), F.col(docs)), 6)).drop("base")


def profile(df: DataFrame, entity: str, sort: str, values: list[str], top: int = 1500) -> DataFrame:
    """The `top` entities by `sort`, nulls as 0; blank entities drop out after the cut."""
    filled = df.select(entity, *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))
    return filled.orderBy(F.desc(sort), entity).limit(top).where(F.trim(entity) != "")


def quartile_profile(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """entity, Q1..Q4 from the columns whose names say so; entities with any above 0."""
    import re

    pick = lambda p: next((c for c in columns if re.search(p, c, re.I)), None)
    found = [pick(p) for p in (r"Q1|Top\s*25%", "Q2", "Q3", "Q4")]
    cols = [(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c else F.lit(0.0)).alias(f"Q{i}") for i, c in enumerate(found, 1)]
    return df.select(entity, *cols).where(F.greatest("Q1", "Q2", "Q3", "Q4") > 0)


def named_levels(df: DataFrame, code: str, macros: DataFrame | None = None, mesos: DataFrame | None = None) -> DataFrame:
    """Adds macro, meso, micro (codes), micro_name, macro_name and meso_name of the topic code in `code`. The names of the two
    upper levels are those of the tables macros and mesos (column code; of several the last by name), else 'Macro x' and
    'Meso x'. Rows whose code has fewer than three parts are left out."""
    out = df.withColumn("__t", T.topic_code(F.col(code))).where("__t is not null")
    out = out.select("*", "__t.macro", "__t.meso", "__t.micro", F.col("__t.short").alias("micro_name")).drop("__t")
    for level, names in (("macro", macros), ("meso", mesos)):
        other = F.concat(F.lit(f"{level.capitalize()} "), level)
        if names is None:
            out = out.withColumn(f"{level}_name", other)
            continue
        known = names.select(T.topic_code(F.col("code")).alias("__t")).where("__t is not null").groupBy(F.col(f"__t.{level}").alias("__k")).agg(F.max("__t.short").alias("__n"))
        out = out.join(known, F.col(level) == F.col("__k"), "left").withColumn(f"{level}_name", F.coalesce("__n", other)).drop("__k", "__n")
    return out


def rollup(df: DataFrame, levels: tuple[str, str, str], weight: str, values: list[str], least: float = 0) -> DataFrame:
    """level, macro, meso, micro, n, <v>_sum, <v>_mean: sums and document-weighted means (weight 0 or null counts as 1)
    of every node of a three-level hierarchy, in one pass of grouping sets. least above 0: only leaves of more weight count."""
    macro, meso, micro = levels
    df = df.where(F.coalesce(F.col(weight), F.lit(0)) > least) if least > 0 else df
    w = F.when(F.coalesce(F.col(weight), F.lit(0)) == 0, 1.0).otherwise(F.col(weight).cast("double"))
    rows = df.select(F.col(macro).alias("macro"), F.col(meso).alias("meso"), F.col(micro).alias("micro"), w.alias("w"), *(F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values))
    aggs = [x for v in values for x in (F.round(F.sum(v), 4).alias(f"{v}_sum"), F.round(F.sum(F.col(v) * F.col("w")) / F.sum("w"), 4).alias(f"{v}_mean"))]
    sets = [["macro", "meso", "micro"], ["macro", "meso"], ["macro"]]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], "macro", "meso", "micro")
    level = F.when(F.grouping("micro") == 0, 3).when(F.grouping("meso") == 0, 2).otherwise(1)
    return grouped.agg(level.alias("level"), F.count(F.lit(1)).alias("n"), *aggs).select("level", "macro", "meso", "micro", "n", *[f"{v}_{k}" for v in values for k in ("sum", "mean")])


def angles(df: DataFrame, parent: str, name: str, size: str) -> DataFrame:
    """Adds x0, x1: each child's arc of its parent's full circle, largest first (ties by name)."""
    own = Window.partitionBy(parent)
    run = own.orderBy(F.desc(size), name).rowsBetween(Window.unboundedPreceding, 0)
    total = F.nullif(F.sum(size).over(own), F.lit(0.0))
    return df.withColumn("x1", F.round(F.coalesce(2 * F.pi() * F.sum(size).over(run) / total, F.lit(0.0)), 6)).withColumn("x0", F.round(F.coalesce(2 * F.pi() * (F.sum(size).over(run) - F.col(size)) / total, F.lit(0.0)), 6))


def growth(df: DataFrame, entity: str, t: str, value: str) -> DataFrame:
    """entity, first, last, n, cagr: percent a step, a first value of 0 counts as 0.0001; 0 for one point."""
    g = df.groupBy(entity).agg(F.min_by(value, t).alias("first"), F.max_by(value, t).alias("last"), F.count(F.lit(1)).alias("n"))
    start = F.when(F.col("first") == 0, 0.0001).otherwise(F.col("first").cast("double"))
    rate = (F.pow(F.col("last") / start, 1.0 / F.nullif(F.col("n") - 1, F.lit(0))) - 1) * 100
    return g.withColumn("cagr", F.round(F.coalesce(rate, F.lit(0.0)), 6))


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """median: the value of rank floor(n / 2) from 0."""
    ranked = with_total(global_rank(df.select(F.col(value).alias("median")), "median", name="__k"), __n=F.count(F.lit(1)))
    return ranked.where(F.col("__k") - 1 == F.floor(F.col("__n") / 2)).select("median")


def stacked_share(df: DataFrame, t: str, value: str) -> DataFrame:
    """Adds percent: the row's part of its period's total; 0 where the total is 0."""
    out = with_group(df, [t], __total=F.sum(value))
    return out.withColumn("percent", F.round(ratio(F.col(value), F.col("__total")) * 100, 6)).drop("__total")


def top_entities(df: DataFrame, indicator: str, entity: str, t: str, value: str, n: int = 20) -> DataFrame:
    """indicator, entity, latest, rank: the n entities of each indicator with the highest latest value."""
    latest = df.groupBy(indicator, entity).agg(F.max_by(value, t).alias("latest"))
    ranked = latest.withColumn("rank", F.row_number().over(Window.partitionBy(indicator).orderBy(F.desc("latest"), entity)))
    return ranked.where(F.col("rank") <= n)


def non_zero(df: DataFrame, values: list[str]) -> DataFrame:
    """Rows where any of the values is set and not 0."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.col(v) != 0, F.lit(False)) for v in values]))


def prefer(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Adds place: preferred names first in their order, the others by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name)), F.lit(0)), F.lit(999))
    return global_rank(df, rank, name, name="place")


def fallback(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of first, and of second what first doesn't have by keys."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").select(first.columns))
