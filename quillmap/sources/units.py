"""Indicator files: names to (unit, period), workbooks, archives, inventory and lazy scans of one unit."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import own_dir
from . import tables

#: Names of standard units.
UNITS = ["WoS Categories", "Publication Sources", "Funding Agencies", "Organizations", "Locations", "Researchers", "Patentometrics"]
_AREA = r"(?i)^Research[\s_]*Areas"


def with_units(df: DataFrame, name: str) -> DataFrame:
    """Adds unit and period of a file name without its folder; nulls for other kinds of files. Trend goes before a
    range of years before one year; what is left is the unit. One step a column, so that no step is evaluated twice."""
    c = F.col
    one_year = r"(^|[^0-9A-Za-z_])(19|20)[0-9]{2}([^0-9A-Za-z_]|$)"
    out = df.withColumn("_b", F.regexp_replace(F.regexp_replace(name, r"[.][^.]*$", ""), "^up_[a-zA-Z0-9]+_", ""))
    out = out.withColumn("_k", F.when(c("_b").rlike("(?i)trend"), 1).when(c("_b").rlike("[0-9]{4} *- *[0-9]{4}"), 2).when(c("_b").rlike(one_year), 3).otherwise(0))
    out = out.withColumn("_p", F.element_at(F.array(*[F.lit(p) for p in (r"(?i)[\s_]*trend[\s_]*", r"[\s_]*[0-9]{4}\s*-\s*[0-9]{4}[\s_]*", r"[\s_]*\b(19|20)[0-9]{2}\b[\s_]*", "(?!)")]), F.when(c("_k") == 0, 4).otherwise(c("_k"))))
    out = out.withColumn("_r", F.regexp_replace(F.regexp_replace("_b", c("_p"), F.lit(" ")), r"(?i)^(incites|in_cites)[\s_]*", ""))
    out = out.withColumn("_r", F.regexp_replace(F.regexp_replace("_r", _AREA + r"[\s_]+(?=ESI|SDG|Macro|Meso|Micro|WoS)", ""), _AREA, "WoS Categories"))
    out = out.withColumn("_r", F.trim(F.regexp_replace("_r", r"\s+", " ")))
    folded = F.lower(F.regexp_replace("_r", r"[\s_]", ""))
    known = F.create_map(*[F.lit(x) for u in UNITS for x in (u.replace(" ", "").lower(), u)])
    out = out.withColumn("_u", F.coalesce(F.try_element_at(known, folded), F.when(c("_r") == "", F.lit("Dataset Unit")).otherwise(c("_r"))))
    ok = F.lower(name).rlike(r"[.](csv|xlsx|xls|xlsb)$")
    period = F.element_at(F.array(*[F.lit(p) for p in ("Whole", "Trend", "5Years", "5Years")]), c("_k") + 1)
    return out.withColumn("unit", F.when(ok, c("_u"))).withColumn("period", F.when(ok, period)).drop("_b", "_k", "_p", "_r", "_u")


def sheet_rows(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of an .xlsx workbook, by the standard library alone."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        texts = []
        if "xl/sharedStrings.xml" in names:
            texts = ["".join(t.text or "" for t in s.iter("{%s}t" % ns["m"])) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        sheet = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter("{%s}row" % ns["m"]):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", ns)):
                ref = re.match(r"[A-Z]+", c.get("r", ""))
                at = k
                if ref:
                    at = 0
                    for ch in ref[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                v = c.find("m:v", ns)
                text = v.text if v is not None else "".join(t.text or "" for t in c.iter("{%s}t" % ns["m"])) or None
                cells[at] = texts[int(text)] if c.get("t") == "s" and text is not None else text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return out


def table_of(rows: list[list[str | None]]) -> tuple[list[str], list[list[str | None]]]:
    """Header (the row with the most set cells among the first ten) and the rows below it."""
    top = rows[:10]
    k = max(range(len(top)), key=lambda i: (sum(v not in (None, "") for v in top[i]), -i), default=0)
    header = [str(v) if v not in (None, "") else f"column_{i + 1}" for i, v in enumerate(rows[k])] if rows else []
    return header, [(r + [None] * len(header))[: len(header)] for r in rows[k + 1 :]]


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """entity cells as long rows: file, row, column, value. Workbooks are read whole, one per task row."""

    def cells(batches):
        import pyarrow as pa

        for b in batches:
            f, r, c, v = [], [], [], []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                header, body = table_of(sheet_rows(data))
                for i, row in enumerate(body):
                    for h, x in zip(header, row):
                        if x not in (None, ""):
                            f.append(name), r.append(i), c.append(h), v.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.string()), pa.array(v, pa.string())], ["file", "row", "column", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cells, "file string, row int, column string, value string")


def expand(spark: SparkSession, archive: str, folder: str | None = None) -> list[str]:
    """Paths of an archive's files, written by their names alone to a folder that all executors share (the application's own
    unless one is given), whatever its file system."""
    folder = folder or f"{own_dir(spark)}/unpacked-{uuid.uuid4().hex}"
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    out = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = os.path.basename(info.filename)
            if name and not info.is_dir():
                to = path(f"{folder}/{name}")
                stream = to.getFileSystem(conf).create(to, True)
                with z.open(info) as f:
                    while part := f.read(1 << 20):
                        stream.write(bytearray(part))
                stream.close()
                out.append(f"{folder}/{name}")
    return out


def inventory(spark: SparkSession, paths: list[str]) -> DataFrame:
    """unit, period, path: of several files of a unit and period the last wins."""
    rows = spark.createDataFrame(list(enumerate(paths)), "k int, path string")
    named = with_units(rows.withColumn("file", F.regexp_extract("path", r"([^/\\]+)$", 1)), "file")
    return named.where("unit is not null").groupBy("unit", "period").agg(F.max_by("path", "k").alias("path"))


def scan_unit(spark: SparkSession, found: DataFrame, unit: str) -> DataFrame:
    """period, row, column, value: the cells of one unit's files. found: an inventory, of which only this unit's few paths
    are read; the files of other units are never opened."""
    out = None
    for r in found.where(F.col("unit") == unit).select("period", "path").orderBy("period").collect():
        if r.path.lower().endswith(".csv"):
            df = tables.read_indicators(spark, r.path).withColumn("row", F.monotonically_increasing_id())
            names = [c for c in df.columns if c != "row"]
            cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in names])).alias("c")
            rows = df.select("row", cells).select(F.lit(r.period).alias("period"), "row", "c.column", "c.value").where("value is not null")
        else:
            rows = read_workbook(spark, r.path).select(F.lit(r.period).alias("period"), F.col("row").cast("long").alias("row"), "column", "value")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no unit {unit!r} in the inventory")
    return out
