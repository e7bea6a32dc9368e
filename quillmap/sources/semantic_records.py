"""Tagged texts to records for embedding: key, title, abstract, keywords, extras and one labelled text.

The key is the doi of its tag, else the first doi that stands in any value, else PMID_ and the identifier, else
ID_ and the record's number. Keywords are the subject headings of a four-column record (where it has headings or
keywords and `use_mesh`), else the author keywords. Defined results: missing fields are empty texts and lists;
extras hold only fields that have a value; a record without any text is 'Unknown document content'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_markup
from . import tagged

#: Tags in the order in which they are looked up, and the form of a doi.
DOI_TAGS, TITLE_TAGS, ABSTRACT_TAGS = ("DI", "DO"), ("TI", "T1"), ("AB",)
AUTHOR_TAGS, YEAR_TAGS, SOURCE_TAGS = ("AU", "FAU", "AF"), ("PY", "DP", "Y1"), ("SO", "JT", "JO", "T2")
DOI = r"(?i)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9]*[A-Z0-9])"
#: (record end, tag of a line, its pattern, whether lines without a tag go on) by format.
FORMATS = {
    "ris": (r"(?m)^\s*ER[^\n]*$", "", r"^([A-Z][A-Z0-9])  - (.*)$", False),
    "two_letter": (r"(?m)^ER\s*$", r"[A-Z][A-Z0-9](?: |\n|$)", r"^([A-Z][A-Z0-9])(?: (.*))?$", True),
    "four_column": (r"\n\n+(?=PMID)", r"[A-Z]{2,4} *-", r"^([A-Z]{2,4}) *- ?(.*)$", True),
}


def _first(e: Column, tags: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.get(tagged._values(e, [t]), F.lit(0)) for t in tags])


def semantic_records(df: DataFrame, keep: list[str], text: str, kind: str, use_mesh: bool = True) -> DataFrame:
    """keep, record_no, record_key, title, abstract, keywords, extras (AU, PY, SO), concatenated_text of each record of the texts."""
    end, tag_line, pattern, go_on = FORMATS[kind]
    rows = df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(tagged._records(F.col(text), end)).alias("record_no", "record"))
    rows = rows.withColumn("e", tagged._entries(F.col("record"), pattern, tag_line, go_on)).where(F.size("e") > 0)
    e = F.col("e")
    values = lambda *t: tagged._values(e, list(t), kind == "two_letter" and t[0] in ("AU", "AF"))
    clean = lambda c: strip_markup(F.coalesce(c, F.lit("")))
    scanned = F.get(F.filter(F.transform("e", lambda x: F.regexp_extract(tagged._text(x["value"]), DOI, 1)), lambda x: x != ""), F.lit(0))
    pmid = F.concat(F.lit("PMID_"), _first(e, ("PMID",)))
    key = F.coalesce(_first(e, DOI_TAGS), scanned, pmid, F.concat(F.lit("ID_"), (F.col("record_no") + 1).cast("string")))
    parts = lambda c: F.flatten(F.transform(c, lambda x: F.split(x, ";")))
    own = values("KW") if kind == "ris" else F.when(F.size(values("DE")) > 0, parts(values("DE"))).when(F.size(values("OT")) > 0, values("OT")).otherwise(parts(values("ID")))
    words = F.when(F.exists("e", lambda x: x["tag"].isin("MH", "OT")), values("MH")).otherwise(own) if use_mesh else own
    words = F.filter(F.transform(words, lambda k: strip_markup(k)), lambda k: k != "")
    authors = F.coalesce(*[F.nullif(F.array_join(values(t), ", "), F.lit("")) for t in AUTHOR_TAGS])
    extras = F.array(F.struct(F.lit("AU").alias("k"), clean(authors).alias("v")), F.struct(F.lit("PY").alias("k"), F.substring(clean(_first(e, YEAR_TAGS)), 1, 4).alias("v")), F.struct(F.lit("SO").alias("k"), clean(_first(e, SOURCE_TAGS)).alias("v")))
    title = clean(F.nullif(F.array_join(values("TI"), " "), F.lit(""))) if kind != "ris" else clean(_first(e, TITLE_TAGS))
    out = rows.select(*keep, "record_no", key.alias("record_key"), title.alias("title"), clean(F.array_join(values("AB"), " ")).alias("abstract"), words.alias("keywords"), F.map_from_entries(F.filter(extras, lambda x: x["v"] != "")).alias("extras"))
    labelled = lambda name, c: F.when(c != "", F.concat(F.lit(f"{name}: "), c))
    whole = F.concat_ws(" | ", labelled("Title", F.col("title")), labelled("Abstract", F.col("abstract")), labelled("Keywords", F.array_join("keywords", ", ")), labelled("Journal", F.coalesce(F.try_element_at("extras", F.lit("SO")), F.lit(""))))
    return out.withColumn("concatenated_text", F.when(whole == "", F.lit("Unknown document content")).otherwise(whole))
