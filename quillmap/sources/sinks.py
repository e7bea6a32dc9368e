"""Sinks: wide matrices, map and network files, network JSON, clustered data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import global_rank


def wide(cells: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """One row per `row`, one column per name in `columns` (given, so that no extra job looks for them), 0 where empty."""
    out = cells.groupBy(row).pivot(col, columns).agg(F.first(value))
    return out.na.fill(0.0, columns)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def map_lines(nodes: DataFrame, strength: DataFrame) -> DataFrame:
    """line: id, label, occurrences, links, total link strength, tab-separated; ids by count."""
    rows = global_rank(nodes, F.desc("count"), "term", name="id").join(strength, "term", "left")
    parts = (F.col("id").cast("string"), F.col("term"), F.col("count").cast("string"), F.coalesce("links", F.lit(0)).cast("string"), F.format_string("%.4f", F.coalesce("strength", F.lit(0.0))))
    return rows.select(F.concat_ws("\t", *parts).alias("line"))


def link_lines(edges: DataFrame) -> DataFrame:
    """line: source, target, strength, tab-separated."""
    return edges.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string"), F.format_string("%.4f", F.col("weight").cast("double"))).alias("line"))


def network_json(items: DataFrame, links: DataFrame) -> DataFrame:
    """json: one document of a bounded map; items (id, label, x, y, cluster, weights, scores), links (source_id, target_id, strength)."""
    a = items.agg(F.collect_list(F.struct("id", "label", "x", "y", "cluster", "weights", "scores")).alias("items"))
    b = links.agg(F.array_sort(F.collect_list(F.struct("source_id", "target_id", "strength"))).alias("links"))
    return a.crossJoin(b).select(F.to_json(F.struct(F.struct("items", "links").alias("network"))).alias("json"))


def joined_lines(df: DataFrame, array_col: str, sep: str = ";", digits: int = 6) -> DataFrame:
    """Adds line: the numbers of an array with `digits` decimals, joined."""
    return df.withColumn("line", F.array_join(F.transform(array_col, lambda x: F.format_string(f"%.{digits}f", x)), sep))


def result_json(df: DataFrame, name: str, **facts: str) -> DataFrame:
    """json: one document {success, facts, name: [rows]} of a bounded result, its rows in the order of their texts."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("r")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("r")), ","), F.lit("]")).alias("rows"))
    more = F.to_json(F.struct(F.lit(True).alias("success"), *[F.lit(v).alias(k) for k, v in facts.items()]))
    return rows.select(F.concat(F.substring(more, F.lit(1), F.length(more) - 1), F.lit(f',"{name}":'), "rows", F.lit("}")).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """Rows of any number as JSON lines, nulls kept, a file a task."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
