"""Matrix normalisations, scalings and box statistics on long tables (row, feature, value).

Nulls count as 0 (as an unreadable cell of a matrix does). A zero or missing divisor gives what each
function says. Statistics of a feature or row are aggregated on the map side and joined back, and
ranks come from a range sort, so no feature, key or table is ever one task; results are rounded to 6
digits where they are divided.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import global_rank, with_group, with_total


def _or_one(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(c)


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0.0))), F.lit(0.0))


def fill(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))


def div_max(df: DataFrame, *keys: str) -> DataFrame:
    """x / max of the column, a maximum of 0 counts as 1. p1: the maximum."""
    out = with_group(fill(df), [*keys, "feature"], p1=_or_one(F.max("value")))
    return out.withColumn("value", F.round(F.col("value") / F.col("p1"), 6))


def min_max(df: DataFrame, *keys: str) -> DataFrame:
    """(x - min) / range, a range of 0 counts as 1. p1: minimum, p2: range."""
    out = with_group(fill(df), [*keys, "feature"], p1=F.min("value"), p2=_or_one(F.max("value") - F.min("value")))
    return out.withColumn("value", F.round((F.col("value") - F.col("p1")) / F.col("p2"), 6))


def z_score(df: DataFrame, *keys: str) -> DataFrame:
    """(x - mean) / population deviation, a deviation of 0 counts as 1. p1: mean, p2: deviation."""
    out = with_group(fill(df), [*keys, "feature"], p1=F.avg("value"), p2=_or_one(F.round(F.stddev_pop("value"), 9)))
    return out.withColumn("value", F.round((F.col("value") - F.col("p1")) / F.col("p2"), 6)).withColumn("p1", F.round("p1", 6)).withColumn("p2", F.round("p2", 6))


def revert(df: DataFrame, how: str) -> DataFrame:
    """The values before div_max, min_max or z_score, from their parameters."""
    back = {"div_max": F.col("value") * F.col("p1"), "min_max": F.col("value") * F.col("p2") + F.col("p1"), "z_score": F.col("value") * F.col("p2") + F.col("p1")}.get(how, F.col("value"))
    return df.withColumn("value", F.round(back, 3)).drop("p1", "p2")


def _diagonal(df: DataFrame, keys: tuple[str, ...], f: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Cells c_ij with the diagonals c_ii, c_jj; a zero denominator gives 0, the diagonal 1."""
    cells = fill(df)
    diag = cells.where("row = feature").select(*keys, F.col("row").alias("k"), F.col("value").alias("d"))
    both = cells.join(diag.withColumnsRenamed({"k": "row", "d": "di"}), [*keys, "row"], "left").join(diag.withColumnsRenamed({"k": "feature", "d": "dj"}), [*keys, "feature"], "left")
    value = _safe(F.col("value"), f(F.col("value"), F.coalesce("di", F.lit(0.0)), F.coalesce("dj", F.lit(0.0))))
    return both.select(*keys, "row", "feature", F.round(F.when(F.col("row") == F.col("feature"), 1.0).otherwise(value), 6).alias("value"))


def cosine(df: DataFrame, *keys: str) -> DataFrame:
    return _diagonal(df, keys, lambda c, a, b: F.sqrt(a * b))


def association(df: DataFrame, *keys: str) -> DataFrame:
    return _diagonal(df, keys, lambda c, a, b: a * b)


def jaccard(df: DataFrame, *keys: str) -> DataFrame:
    return _diagonal(df, keys, lambda c, a, b: a + b - c)


def inclusion(df: DataFrame, *keys: str) -> DataFrame:
    return _diagonal(df, keys, lambda c, a, b: F.least(a, b))


def by_row(df: DataFrame, *keys: str) -> DataFrame:
    return with_group(fill(df), [*keys, "row"], s=_or_one(F.sum("value"))).withColumn("value", F.round(F.col("value") / F.col("s"), 6)).drop("s")


def by_column(df: DataFrame, *keys: str) -> DataFrame:
    return with_group(fill(df), [*keys, "feature"], s=_or_one(F.sum("value"))).withColumn("value", F.round(F.col("value") / F.col("s"), 6)).drop("s")


def symmetric(df: DataFrame, *keys: str) -> DataFrame:
    """x / sqrt(row sum x column sum), 0 where that is 0."""
    out = with_group(with_group(fill(df), [*keys, "row"], r=F.sum("value")), [*keys, "feature"], c=F.sum("value"))
    return out.withColumn("value", F.round(_safe(F.col("value"), F.sqrt(F.col("r") * F.col("c"))), 6)).drop("r", "c")


NORMALIZATIONS: dict[str, Callable[..., DataFrame]] = {
    "div_max": div_max, "min_max": min_max, "z_score": z_score, "cooc_cosine": cosine, "cooc_association": association, "cooc_jaccard": jaccard,
    "cooc_inclusion": inclusion, "bipartite_row": by_row, "bipartite_col": by_column, "bipartite_sym": symmetric,
}


def normalize(df: DataFrame, how: str, *keys: str) -> DataFrame:
    """By name; an unknown name leaves the matrix as it is. keys (a year, say) keep several matrices of one table
    apart, so that a stack of yearly matrices is normalised in one plan."""
    return NORMALIZATIONS[how](df, *keys) if how in NORMALIZATIONS else fill(df)


def radar(df: DataFrame) -> DataFrame:
    """0 to 100 by the column's maximum, half rounded up; 0 where the maximum isn't above 0."""
    out = with_group(fill(df), ["feature"], top=F.max("value"))
    return out.withColumn("value", F.when(F.col("top") > 0, F.floor(F.col("value") / F.col("top") * 100 + 0.5)).otherwise(F.lit(0)).cast("double")).drop("top")


def heat(df: DataFrame) -> DataFrame:
    """feature, low, high; equal bounds are one apart."""
    g = fill(df).groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return g.withColumn("high", F.when(F.col("high") == F.col("low"), F.col("low") + 1).otherwise(F.col("high")))


def bubble(df: DataFrame, value: str, low: float = 6.0, wide: float = 20.0) -> DataFrame:
    """Adds radius: low + sqrt of the part of the maximum x wide."""
    out = with_total(df, __top=F.nullif(F.max(value), F.lit(0.0)))
    return out.withColumn("radius", F.round(low + F.sqrt(F.greatest(F.coalesce(F.try_divide(F.col(value), F.col("__top")), F.lit(0.0)), F.lit(0.0))) * wide, 6)).drop("__top")


def box(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, low, q1, median, q3, high: the values of rank floor(n p) of each key. Ranks come from one range sort by key
    and value, so the rows of a key with a third of the table are sorted by many tasks; null keys and values don't count."""
    rows = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(value).alias("__v"))
    ranked = with_group(global_rank(rows, "__key", "__v", name="__r"), ["__key"], __first=F.min("__r"), __n=F.count(F.lit(1)))
    k = F.col("__r") - F.col("__first")
    at = lambda p: F.max(F.when(k == F.least(F.floor(F.col("__n") * p), F.col("__n") - 1), F.col("__v")))
    return ranked.groupBy(F.col("__key").alias(key)).agg(F.min("__v").alias("low"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("__v").alias("high"))


def clip_bounds(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """low, high: the values of rank floor(n p) of the finite values."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))).select(F.col(value).alias("v"))
    r = with_total(global_rank(finite, "v", name="k"), n=F.count(F.lit(1)))
    at = lambda p: F.max(F.when(F.col("k") - 1 == F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col("v")))
    return r.agg(at(low).alias("low"), at(high).alias("high"))


def tiers(df: DataFrame, name: str, size: str) -> DataFrame:
    """name, tier: 1 for the 16 largest, 2 to rank 46, 3 to rank 101, else 4; ties by name. Only 101 rows are ranked."""
    top = df.select(F.col(name).alias("__name"), F.col(size).alias("__size")).orderBy(F.desc("__size"), "__name").limit(101)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("__size")).alias("s"), "__name"))).alias("a")).select(F.posexplode("a").alias("k", "x")).select(F.col("x.__name").alias("__name"), F.when(F.col("k") < 16, 1).when(F.col("k") < 46, 2).otherwise(3).alias("__tier"))
    return df.join(F.broadcast(ranked), F.col(name) == F.col("__name"), "left").select(name, F.coalesce("__tier", F.lit(4)).alias("tier"))


def splat(points: DataFrame, x: str, y: str, value: str, width: int, height: int, sigma: float) -> DataFrame:
    """px, py, density, mean: every point is spread over the pixels within 3 sigma of it. Pixels are made per point
    and summed with map-side combination, so the work grows with the points, not with points times pixels."""
    r = int(3 * sigma) + 1
    low = lambda c, m: F.greatest(F.floor(F.col(c)).cast("int") - r, F.lit(0))
    high = lambda c, m: F.least(F.floor(F.col(c)).cast("int") + r, F.lit(m - 1))
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(value).isNotNull()).where((low(x, width) <= high(x, width)) & (low(y, height) <= high(y, height)))
    cells = p.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(value).alias("v"), F.explode(F.sequence(low(x, width), high(x, width))).alias("px")).select("*", F.explode(F.sequence(low("y", height), high("y", height))).alias("py"))
    d2 = (F.col("px") - F.col("x")) ** 2 + (F.col("py") - F.col("y")) ** 2
    w = cells.where(d2 <= 9 * sigma * sigma).withColumn("w", F.exp(-d2 / (2 * sigma * sigma)))
    return w.groupBy("px", "py").agg(F.round(F.sum("w"), 4).alias("density"), F.round(F.sum(F.col("w") * F.col("v")) / F.sum("w"), 4).alias("mean"))


def bounds(df: DataFrame, x: str, y: str, size: float = 1.0) -> DataFrame:
    """x, y moved and scaled to 0..size of the larger extent."""
    box_ = with_total(df, __lx=F.min(x), __ly=F.min(y), __span=_or_one(F.greatest(F.max(x) - F.min(x), F.max(y) - F.min(y))))
    moved = box_.withColumn("__x", F.round((F.col(x) - F.col("__lx")) / F.col("__span") * size, 6)).withColumn("__y", F.round((F.col(y) - F.col("__ly")) / F.col("__span") * size, 6))
    return moved.drop(x, y, "__lx", "__ly", "__span").withColumnsRenamed({"__x": x, "__y": y})


def drop_empty(df: DataFrame) -> DataFrame:
    """Columns and rows without any value go; one aggregate counts all columns."""
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if n[i]]
    return df.select(*[F.col(f"`{c}`") for c in kept]).na.drop("all") if kept else df.limit(0)


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns of which at least half of the set values are numbers (without , and %) become numbers."""
    num = lambda c: F.trim(F.regexp_replace(F.col(f"`{c}`").cast("string"), "[,%]", "")).try_cast("double")
    n = df.agg(*[x for i, c in enumerate(columns) for x in (F.count(F.col(f"`{c}`")).alias(f"a{i}"), F.count(num(c)).alias(f"b{i}"))]).first()
    good = {c for i, c in enumerate(columns) if n[f"b{i}"] >= 1 and 2 * n[f"b{i}"] >= n[f"a{i}"]}
    return df.select(*[num(c).alias(c) if c in good else F.col(f"`{c}`") for c in df.columns])
