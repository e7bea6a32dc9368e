"""Tagged records: RIS, two-letter (PT ... ER) and four-column (PMID- ...) formats, as text columns.

Input: a column that holds texts (stored ones, or the records of a file, see `router.read`); one text may
hold many records. Lines are cut and grouped inside the row with array functions, in time that grows with
the text: no shuffle, no Python. A record ends at its ER line (RIS, two-letter) or at a blank line before
the next PMID (four-column); the last one also counts without an end. In RIS lines without a tag are left
out; in the other formats they go on with the value before them, in fields of one value a line (authors,
references, addresses) as a further value. Nulls, empty texts and texts without tags give no records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a line end inside a value.
MORE = "\x01"
#: Tags of each field, in the order in which they are looked up.
RIS = {"title": ["TI", "T1"], "year": ["PY", "Y1"], "journal": ["JO", "T2", "J2", "JF"], "abstract": ["AB"], "doi": ["DO"], "doc_type": ["TY"]}
RIS_LISTS = {"authors": ["AU"], "keywords": ["KW"]}
TWO_LETTER = {"title": ["TI"], "source": ["SO"], "abstract": ["AB"], "year": ["PY"], "doi": ["DI"], "cited": ["TC"]}
TWO_LETTER_LISTS = {"authors": ["AU"], "keywords": ["DE"], "keywords_plus": ["ID"], "references": ["CR"], "addresses": ["C1"], "record_id": ["UT"]}
FOUR = {"title": ["TI"], "abstract": ["AB"], "year": ["DP"], "source": ["JT", "TA"], "record_id": ["PMID"]}
FOUR_LISTS = {"authors": ["FAU", "AU"], "mesh": ["MH"], "keywords": ["OT"]}


def _records(text: Column, end: str) -> Column:
    return F.filter(F.split(F.regexp_replace(text, "\r\n?", "\n"), end), lambda r: F.trim(r) != "")


def _entries(record: Column, pattern: str, tag_line: str, go_on: bool) -> Column:
    """[(tag, value)] of a record. go_on: lines without a tag are joined to the line before them by MORE."""
    if go_on:
        record = F.regexp_replace(record, rf"[ \t]*\n(?!{tag_line})[ \t]*", MORE)
    lines = F.transform(F.split(record, "\n"), lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("tag"), F.regexp_extract(x, pattern, 2).alias("value")))
    return F.filter(lines, lambda e: e["tag"] != "")


def _text(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, f" *(?:{MORE})+ *", " "))


def _values(entries: Column, tags: list[str], each_line: bool = False) -> Column:
    found = F.transform(F.filter(entries, lambda e: e["tag"].isin(tags)), lambda e: e["value"])
    found = F.transform(F.flatten(F.transform(found, lambda v: F.split(v, MORE))), lambda v: F.trim(v)) if each_line else F.transform(found, _text)
    return F.filter(found, lambda v: v != "")


def _first(entries: Column, tags: list[str], in_order: bool) -> Column:
    """First value among the tags: of the first tag that has one, or (in_order) the first in the record."""
    return F.get(_values(entries, tags), F.lit(0)) if in_order else F.coalesce(*[F.get(_values(entries, [t]), F.lit(0)) for t in tags])


def _parse(df: DataFrame, keep: list[str], text: str, end: str, pattern: str, tag_line: str, scalars: dict, lists: dict, least: str | None, go_on: bool = True, each_line: tuple[str, ...] = ()) -> DataFrame:
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(_records(F.col(text), end)).alias("record_no", "record"))
    rows = rows.withColumn("e", _entries(F.col("record"), pattern, tag_line, go_on)).where(F.exists("e", lambda e: e["tag"] == least) if least else F.size("e") > 0)
    return rows.select(*keep, "record_no", *[_first(F.col("e"), t, not go_on).alias(n) for n, t in scalars.items()], *[_values(F.col("e"), t, n in each_line).alias(n) for n, t in lists.items()])


def parse_ris(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, record_no, title, year (four characters), journal, abstract, doi, doc_type, authors, keywords; the first value of a scalar wins."""
    out = _parse(df, keep, text, r"(?m)^\s*ER[^\n]*$", r"^([A-Z][A-Z0-9])  - (.*)$", "", RIS, RIS_LISTS, None, go_on=False)
    return out.withColumn("year", F.substring("year", 1, 4))


def parse_two_letter(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, record_no and fields; authors, references and addresses one a line, keyword fields split at semicolons."""
    out = _parse(df, keep, text, r"(?m)^ER\s*$", r"^([A-Z][A-Z0-9])(?: (.*))?$", r"[A-Z][A-Z0-9](?: |\n|$)", TWO_LETTER, TWO_LETTER_LISTS, "TI", each_line=("authors", "references", "addresses"))
    parts = lambda c: F.filter(F.flatten(F.transform(c, lambda x: F.transform(F.split(x, ";"), lambda y: F.trim(y)))), lambda x: x != "")
    return out.withColumn("keywords", parts("keywords")).withColumn("keywords_plus", parts("keywords_plus")).withColumn("record_id", F.get("record_id", F.lit(0)))


def parse_four_column(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep, record_no and fields of PMID- ... records; the year is the first 19xx or 20xx of the date."""
    out = _parse(df, keep, text, r"\n\n+(?=PMID)", r"^([A-Z]{2,4}) *- ?(.*)$", r"[A-Z]{2,4} *-", FOUR, FOUR_LISTS, "PMID")
    return out.withColumn("year", clean_date(F.col("year")))


def clean_date(c: Column) -> Column:
    """The first 19xx or 20xx that stands alone; the text itself where there is none."""
    y = F.regexp_extract(c, r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:[^0-9A-Za-z_]|$)", 1)
    return F.when(y != "", y).otherwise(c)


def clean_dates(df: DataFrame, line: str) -> DataFrame:
    """Date lines (DP, PY, PD) reduced to their year; the input isn't changed."""
    tag = F.regexp_extract(line, r"^((?:DP|PY|PD)(?:  ?- | ))", 1)
    return df.withColumn(line, F.when(tag != "", F.concat(tag, clean_date(F.substring(F.col(line), F.length(tag) + 1, F.length(line))))).otherwise(F.col(line)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
