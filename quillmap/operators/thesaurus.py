"""Thesaurus: replace, drop or keep terms; matched without case.

A thesaurus row (label, replace_by) drops its label where replace_by is null, blank or a drop word.
One pass: a replacement isn't looked up again. Null terms are dropped; a null thesaurus label never
matches; of repeated labels the last in order of replace_by wins (a defined tie).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Replacements that mean "drop this term".
DROP = ["", "<ignore>", "<delete>", "<remove>", "null", "none", "-"]


def prepare(thesaurus: DataFrame, label: str = "label", replace_by: str = "replace_by") -> DataFrame:
    """low, new (null: drop), one row per label."""
    rows = thesaurus.select(F.lower(F.trim(label)).alias("low"), F.trim(replace_by).alias("new")).where("low <> ''")
    rows = rows.groupBy("low").agg(F.max("new").alias("new"))
    return rows.select("low", F.when(F.lower(F.coalesce("new", F.lit(""))).isin(DROP), None).otherwise(F.col("new")).alias("new"), F.lit(True).alias("hit"))


def apply_terms(terms: DataFrame, rec: str, pos: str, term: str, thesaurus: DataFrame) -> DataFrame:
    """rec, pos, term: replaced terms, of those equal without case in a record the first."""
    joined = terms.where(F.col(term).isNotNull()).join(thesaurus, F.lower(F.trim(term)) == F.col("low"), "left")
    kept = joined.select(rec, pos, F.when(F.col("hit"), F.col("new")).otherwise(F.trim(term)).alias("term")).where("term is not null and term <> ''")
    first = kept.groupBy(F.col(rec), F.lower("term").alias("low")).agg(F.min(F.struct(F.col(pos).alias("pos"), "term")).alias("first"))
    return first.select(rec, F.col("first.pos").alias("pos"), F.col("first.term").alias("term"))
