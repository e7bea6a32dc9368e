"""Format router: the first format whose signs the first lines show wins."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from . import tables, tagged, works


def sniff(lines: list[str]) -> str:
    """network, dimensions, lens, ris, scopus, two_letter or four_column."""
    text = "\n".join(lines).lstrip("﻿ \n")
    first = next((x for x in lines if x.strip()), "").lstrip("﻿")
    if text.startswith("{") and ('"network"' in text or '"items"' in text):
        return "network"
    if tables.is_dimensions(lines):
        return "dimensions"
    if tables.is_lens(lines):
        return "lens"
    if first.startswith("TY"):
        return "ris"
    if tables.is_scopus(lines):
        return "scopus"
    return "four_column" if first.startswith(("PMID", "OWN ")) else "two_letter"


def records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """value: the records of a file of tagged records. The scan itself is split at the record ends, so that a large file
    is many tasks; its line ends are taken from its first bytes."""
    eol = "\r\n" if tables.head_text(spark, path).count("\r\n") else "\n"
    end = {"ris": f"{eol}ER  -", "two_letter": f"{eol}ER{eol}", "four_column": eol + eol}[kind]
    return spark.read.option("lineSep", end).text(path)


def read(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(format, records) of a file or folder of one format."""
    kind = sniff(tables.head(spark, path, 50))
    one = lambda: records(spark, path, kind)
    df = {
        "network": lambda: works.network_items(spark.read.text(path, wholetext=True), "value"),
        "dimensions": lambda: tables.read_dimensions(spark, path),
        "lens": lambda: tables.read_lens(spark, path),
        "ris": lambda: tagged.parse_ris(one(), [], "value"),
        "scopus": lambda: tables.read_scopus(spark, path),
        "two_letter": lambda: tagged.parse_two_letter(one(), [], "value"),
        "four_column": lambda: tagged.parse_four_column(one(), [], "value"),
    }[kind]()
    return kind, df


def network_text(items: DataFrame, links: DataFrame) -> str:
    """The JSON text of a bounded network."""
    from .sinks import network_json

    return json.dumps(json.loads(network_json(items, links).first()["json"]))
