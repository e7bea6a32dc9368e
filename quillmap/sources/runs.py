"""Saved runs: one folder of Parquet tables per run, and a table of runs. Runs are never changed once written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_run(folder: str, run_id: str, tables: dict[str, DataFrame], config: dict | None = None) -> None:
    """Writes tables under folder/run_id and a row of folder/runs; an existing run is refused."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{folder}/{run_id}/{name}")
    row = spark.createDataFrame([(run_id, json.dumps(config or {}, sort_keys=True), sorted(tables))], "run_id string, config string, tables array<string>")
    row.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/runs")


def load_run(spark: SparkSession, folder: str, run_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{run_id}/{name}")


def list_runs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/runs")
