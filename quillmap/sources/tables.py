"""Delimited exports: sniffing on the first lines, then a distributed scan with fixed rules.

Only the first lines of one file are looked at by the driver. All columns are read as texts; lists,
numbers and years follow the rules of `functions.text`. Missing columns give nulls.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Tag of a field to the column of a Scopus-like export.
SCOPUS_COLUMNS = {"AU": "Authors", "TI": "Title", "PY": "Year", "SO": "Source title", "DE": "Author Keywords", "ID": "Index Keywords", "AB": "Abstract", "DI": "DOI", "TC": "Cited by", "UT": "EID", "C1": "Affiliations"}


def head_bytes(spark: SparkSession, path: str, most: int = 65_536) -> bytes:
    """The first bytes of a file, or of the first file of a folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isDirectory():
        found = sorted((f.getPath() for f in fs.listStatus(p) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda q: q.getName())
        if not found:
            return b""
        p = found[0]
    stream = fs.open(p)
    try:
        size = min(most, fs.getFileStatus(p).getLen())
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
    finally:
        stream.close()


def encoding_of(data: bytes) -> str:
    """UTF-8 where the bytes are that (but for a character cut off at their end), else the western single-byte one."""
    try:
        data[: max(data.rfind(b"\n"), 0) or len(data)].decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError:
        return "ISO-8859-1"


def head_text(spark: SparkSession, path: str) -> str:
    data = head_bytes(spark, path)
    return data.decode(encoding_of(data), "replace")


def head(spark: SparkSession, path: str, n: int = 15) -> list[str]:
    """The first lines of a file (or of the first file of a folder), byte-order mark included."""
    return head_text(spark, path).replace("\r\n", "\n").split("\n")[:n]


def fields(line: str, sep: str = ",") -> list[str]:
    return next(csv.reader(io.StringIO(line.lstrip("﻿")), delimiter=sep), [])


def is_scopus(lines: list[str]) -> bool:
    """A byte-order mark and a header with Authors and Title."""
    return bool(lines) and lines[0].startswith("﻿") and {"Authors", "Title"} <= set(fields(lines[0]))


def is_dimensions(lines: list[str]) -> bool:
    joined = "\n".join(lines[:3])
    return "Publication Title" in joined and ("Times cited" in joined or "Dimensions" in joined) or "Fields of Research" in joined


def is_lens(lines: list[str]) -> bool:
    return bool(lines) and "Lens ID" in lines[0]


def read_delimited(spark: SparkSession, path: str, sep: str = ",", skip: int = 0, encoding: str | None = None) -> DataFrame:
    """All columns as texts; quoted fields may hold line ends; malformed rows are dropped. skip: lines before the header; in
    such a file a row is a line, and lines equal to those before the header or to it are left out. The encoding is found
    from the first bytes unless given."""
    encoding = encoding or encoding_of(head_bytes(spark, path))
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding).option("mode", "DROPMALFORMED")
    if not skip:
        df = reader.csv(path)
    else:
        top = head(spark, path, skip + 1)
        names = [c or f"_c{i}" for i, c in enumerate(fields(top[skip], sep))]
        schema = ", ".join(f"`{c}` string" for c in [*names, "__bad"])
        line = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "\r$", "")
        rows = spark.read.text(path).select(line.alias("line")).where((F.col("line") != "") & ~F.regexp_replace("line", "^\ufeff", "").isin([x.lstrip("\ufeff") for x in top]))
        how = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
        df = rows.select(F.from_csv("line", schema, how).alias("r")).select("r.*").where("__bad is null").drop("__bad")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _col(df: DataFrame, *names: str) -> Column:
    """The first of the columns that exists, else a null."""
    return next((F.col(f"`{n}`") for n in names if n in df.columns), F.lit(None).cast("string"))


def _list(c: Column) -> Column:
    return F.coalesce(T.split_list(c, lower=False), F.array().cast("array<string>"))


def scopus_field(df: DataFrame, tag: str) -> Column:
    """A field by its tag; an unknown tag is a column name."""
    return _col(df, SCOPUS_COLUMNS.get(tag, tag))


def read_scopus(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path)
    low = lambda t: F.coalesce(T.split_list(scopus_field(df, t)), F.array().cast("array<string>"))
    return df.select(scopus_field(df, "UT").alias("record_id"), scopus_field(df, "TI").alias("title"), T.year4(scopus_field(df, "PY")).alias("year"), scopus_field(df, "SO").alias("source"), scopus_field(df, "AB").alias("abstract"), scopus_field(df, "DI").alias("doi"), T.safe_number(scopus_field(df, "TC")).alias("citations"), low("AU").alias("authors"), low("DE").alias("keywords"), low("ID").alias("index_keywords"), scopus_field(df, "C1").alias("affiliations"), T.countries(scopus_field(df, "C1")).alias("countries"))


def read_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """Lines before the header are skipped; untitled rows are dropped."""
    lines = head(spark, path)
    skip = next((i for i, x in enumerate(lines) if len(fields(x)) > 2 and any("Title" in f for f in fields(x))), 0)
    df = read_delimited(spark, path, skip=skip)
    return df.select(_col(df, "Title", "Publication Title").alias("title"), _col(df, "Abstract").alias("abstract"), T.year4(_col(df, "Publication Year", "Year")).alias("year"), T.safe_number(_col(df, "Times cited", "Citations")).alias("citations"), _list(_col(df, "Authors")).alias("authors"), F.concat(_list(_col(df, "MeSH terms")), _list(_col(df, "Fields of Research (ANZSRC 2020)"))).alias("keywords"), _col(df, "Source title", "Journal").alias("source"), _col(df, "DOI").alias("doi")).where(F.trim("title") != "")


def read_lens(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path)
    return df.select(_col(df, "Lens ID").alias("record_id"), _col(df, "Title").alias("title"), _col(df, "Abstract").alias("abstract"), T.year4(_col(df, "Publication Year")).alias("year"), T.safe_number(_col(df, "Citing Works Count")).alias("citations"), _list(_col(df, "Authors", "Author/s")).alias("authors"), F.array_distinct(F.concat(_list(_col(df, "Keywords")), _list(_col(df, "Mesh Terms", "MeSH Terms")))).alias("keywords"), _col(df, "Source Title").alias("source"), _col(df, "DOI").alias("doi")).where(F.trim("title") != "")


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """label, replace_by: tab-separated if a tab stands in the first 2048 characters, else by commas; a header is optional."""
    lines = head(spark, path, 50)
    sep = "\t" if "\t" in "\n".join(lines)[:2048] else ","
    df = spark.read.option("sep", sep).option("header", False).schema("label string, replace_by string").csv(path)
    header = bool(lines) and fields(lines[0], sep)[:1] and fields(lines[0], sep)[0].strip().lower() in ("label", "term")
    return df.where(F.lower(F.trim("label")) != fields(lines[0], sep)[0].strip().lower()) if header else df


def read_matrix(spark: SparkSession, path: str, label: str | None = None, ignore: tuple[str, ...] = (), sep: str = ",") -> DataFrame:
    """row, label, feature, value (long): unreadable cells are 0; the label is the first column unless named."""
    df = read_delimited(spark, path, sep)
    label = label or df.columns[0]
    cols = [c for c in df.columns if c != label and c not in ignore]
    rows = df.withColumn("row", F.monotonically_increasing_id())
    return rows.select("row", F.col(f"`{label}`").alias("label"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.trim(f"`{c}`").try_cast("double"), F.lit(0.0)).alias("value")) for c in cols])).alias("x")).select("row", "label", "x.feature", "x.value")


def read_numbers(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """row, vec: a numeric matrix, empty lines left out; a first line that isn't all numbers is a header; cells that are no
    numbers elsewhere are 0. Lines equal to the header are headers (of the files of a folder)."""
    first = next((x for x in head(spark, path, 1)), "").rstrip("\r")
    number = lambda x: F.when(F.trim(x) == "", F.lit(0.0)).otherwise(F.trim(x).try_cast("double"))
    rows = spark.read.text(path).withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.trim("value") != "").withColumn("row", F.monotonically_increasing_id())
    vec = F.transform(F.split("value", re.escape(sep)), number)
    head_row = F.exists(vec, lambda v: v.isNull()) & (F.col("value") == F.lit(first))
    return rows.where(~head_row).select("row", F.transform(vec, lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0))).alias("vec"))


def header_line(lines: list[str]) -> tuple[int, str]:
    """Index of the line with the most separators among the first 15, and the separator (tab or comma)."""
    best = max(((max(x.count("\t"), x.count(",")), -i) for i, x in enumerate(lines[:15])), default=(0, 0))
    line = lines[-best[1]] if lines else ""
    return -best[1], "\t" if line.count("\t") > line.count(",") else ","


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    """An indicator table with its header found; columns as texts (see matrices.coerce_numbers)."""
    skip, sep = header_line(head(spark, path))
    return read_delimited(spark, path, sep, skip)
