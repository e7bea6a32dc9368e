from ..operators import packed_fields
from ..runtime import table
from .registry import query


@query("p1_found")
def p1_found(spark, d):
    return packed_fields.split_packed_scopus(table(spark, d, "scopus_records"))
