"""Import queries: stored texts of tagged records, tables written as exports and read back, names of indicator files, windows
of a stream's batch form."""

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import WS
from ..operators import indicators, matrices
from ..runtime import own_dir, table
from ..sources import tables, tagged, units, works
from ..sources.semantic_records import semantic_records
from ..streaming import term_counts as tc
from .registry import query

#: Lines of the stored texts of one kind, with their place.
def _lines(where: str) -> str:
    return rf"""t AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents WHERE {where}),
      l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM t)"""


#: The fixed tag layouts again, as SQL: a line's tag and value, and lines that go on joined to the line before them.
_RIS = f"""{_lines("doc_kind = 'tagged_record'")}, e AS (SELECT doc_id, n, regexp_extract(line, '^([A-Z][A-Z0-9])  - (.*)$', 1) AS tag, trim(regexp_extract(line, '^([A-Z][A-Z0-9])  - (.*)$', 2)) AS value FROM l), v AS (SELECT * FROM e WHERE tag <> '')"""


def _joined(where: str, pattern: str, tag_line: str) -> str:
    return f"""{_lines(where)}, m AS (SELECT *, regexp_matches(line, '{tag_line}') AS own FROM l), g AS (SELECT *, sum(own::INT) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM m),
      e AS (SELECT doc_id, k, min(n) AS n, arg_min(regexp_extract(line, '{pattern}', 1), n) AS tag, trim(string_agg(trim(CASE WHEN own THEN regexp_extract(line, '{pattern}', 2) ELSE line END, ' ' || chr(9)), ' ' ORDER BY n)) AS value FROM g WHERE k > 0 GROUP BY ALL), v AS (SELECT * FROM e WHERE tag <> '')"""


_pick = lambda tags, name: f"arg_min(value, n) FILTER (tag IN ({tags}) AND value <> '') AS {name}"
_list = lambda tags, name: f"coalesce(string_agg(value, '|' ORDER BY n) FILTER (tag IN ({tags}) AND value <> ''), '') AS {name}"


@query(
    "ris_records",
    f"""WITH {_RIS} SELECT doc_id, {_pick("'TI', 'T1'", "title")}, substr({_pick("'PY', 'Y1'", "x")[:-5]}, 1, 4) AS year, {_pick("'JO', 'T2', 'J2', 'JF'", "journal")}, {_pick("'AB'", "abstract")}, {_pick("'DO'", "doi")}, {_pick("'TY'", "doc_type")}, {_list("'AU'", "authors")}, {_list("'KW'", "keywords")} FROM v GROUP BY doc_id""",
)
def ris_records(spark, d):
    """RIS records among the documents, lists as joined texts."""
    rows = tagged.parse_ris(table(spark, d, "documents").where("doc_kind = 'tagged_record'"), ["doc_id"], "text").drop("record_no")
    return rows.withColumns({c: F.array_join(c, "|") for c in ("authors", "keywords")})


@query("ris_keywords", f"WITH {_RIS} SELECT doc_id, value AS keyword, count(*) AS n FROM v WHERE tag = 'KW' AND value <> '' GROUP BY ALL")
def ris_keywords(spark, d):
    rows = tagged.parse_ris(table(spark, d, "documents").where("doc_kind = 'tagged_record'"), ["doc_id"], "text")
    return rows.select("doc_id", F.explode("keywords").alias("keyword")).groupBy("doc_id", "keyword").agg(F.count(F.lit(1)).alias("n"))


@query(
    "two_letter_records",
    f"""WITH {_joined("doc_kind = 'tagged_record' AND starts_with(text, 'PT ')", "^([A-Z][A-Z0-9])(?: (.*))?$", "^[A-Z][A-Z0-9]( |$)")} SELECT doc_id, {_pick("'TI'", "title")}, {_pick("'SO'", "source")}, {_pick("'AB'", "abstract")}, {_pick("'PY'", "year")}, {_pick("'DI'", "doi")}, {_pick("'TC'", "cited")},
      coalesce(array_to_string([trim(x) for x in string_split(string_agg(value, ';' ORDER BY n) FILTER (tag = 'DE' AND value <> ''), ';') if trim(x) <> ''], '|'), '') AS keywords FROM v WHERE tag <> 'ER' GROUP BY doc_id HAVING bool_or(tag = 'TI')""",
)
def two_letter_records(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'tagged_record' and startswith(text, 'PT ')")
    return tagged.parse_two_letter(docs, ["doc_id"], "text").select("doc_id", "title", "source", "abstract", "year", "doi", "cited", F.array_join("keywords", "|").alias("keywords"))


_FOUR = r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:[^0-9A-Za-z_]|$)"


@query(
    "four_column_records",
    f"""WITH {_joined("doc_kind = 'tagged_record' AND starts_with(text, 'PMID')", "^([A-Z]{2,4}) *- ?(.*)$", "^[A-Z]{2,4} *-")}, r AS (SELECT doc_id, {_pick("'TI'", "title")}, {_pick("'AB'", "abstract")}, {_pick("'DP'", "y")}, {_pick("'PMID'", "record_id")}, {_list("'MH'", "mesh")}, {_list("'OT'", "keywords")} FROM v GROUP BY doc_id)
      SELECT doc_id, title, abstract, CASE WHEN regexp_matches(y, '{_FOUR}') THEN regexp_extract(y, '{_FOUR}', 1) ELSE y END AS year, record_id, mesh, keywords FROM r WHERE record_id IS NOT NULL""".replace("{2,4}", "{2,4}"),
)
def four_column_records(spark, d):
    docs = table(spark, d, "documents").where("doc_kind = 'tagged_record' and startswith(text, 'PMID')")
    return tagged.parse_four_column(docs, ["doc_id"], "text").select("doc_id", "title", "abstract", "year", "record_id", F.array_join("mesh", "|").alias("mesh"), F.array_join("keywords", "|").alias("keywords"))


_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace({c}, '<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g'))"


@query(
    "semantic_parse",
    rf"""WITH {_RIS}, r AS (SELECT doc_id, coalesce({_pick("'DO'", "x")[:-5]}, min(regexp_extract(value, '(?i)\b(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]*[A-Z0-9])', 1)) FILTER (regexp_matches(value, '(?i)\b(10\.[0-9]{{4,9}}/[-._;()/:A-Z0-9]*[A-Z0-9])')), 'ID_1') AS record_key,
      {_CLEAN("coalesce(" + _pick("'TI', 'T1'", "x")[:-5] + ", '')")} AS title, {_CLEAN("coalesce(string_agg(value, ' ' ORDER BY n) FILTER (tag = 'AB' AND value <> ''), '')")} AS abstract,
      coalesce(string_agg({_CLEAN("value")}, ', ' ORDER BY n) FILTER (tag = 'KW' AND {_CLEAN("value")} <> ''), '') AS keywords, {_CLEAN("coalesce(" + _pick("'SO'", "x")[:-5] + "," + _pick("'JT'", "x")[:-5] + "," + _pick("'JO'", "x")[:-5] + "," + _pick("'T2'", "x")[:-5] + ", '')")} AS source FROM v GROUP BY doc_id)
      SELECT doc_id, record_key, title, keywords, coalesce(nullif(array_to_string([x for x in [CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN abstract <> '' THEN 'Abstract: ' || abstract END, CASE WHEN keywords <> '' THEN 'Keywords: ' || keywords END, CASE WHEN source <> '' THEN 'Journal: ' || source END] if x IS NOT NULL], ' | '), ''), 'Unknown document content') AS concatenated_text FROM r""",
)
def semantic_parse(spark, d):
    """The RIS texts among the documents as records for embedding."""
    docs = table(spark, d, "documents").where("doc_kind = 'tagged_record'")
    return semantic_records(docs, ["doc_id"], "text", "ris").select("doc_id", "record_key", "title", F.array_join("keywords", ", ").alias("keywords"), "concatenated_text")


def _written(spark, df, sep=",", bom=False) -> str:
    """Path of df as quoted delimited text with a header, in the application's own folder: what the readers are given."""
    path = f"{own_dir(spark)}/export-{uuid.uuid4().hex}"
    columns = [F.col(f"`{c}`").alias(("﻿" if bom and i == 0 else "") + c) for i, c in enumerate(df.columns)]
    w = df.select(*columns).write.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("quoteAll", True)
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


#: A field as a text file holds it: line ends are one character.
_cell = lambda c: F.regexp_replace(F.regexp_replace(c, "\r\n?", "\n"), "^$", "-")
_CELL = lambda c: f"regexp_replace(regexp_replace({c}, '\\r\\n?', chr(10), 'g'), '^$', '-')"
_LIST = lambda c, low=True: f"coalesce(array_to_string([trim(x) for x in string_split({'lower(' + c + ')' if low else c}, ';') if trim(x) <> ''], '|'), '')"
_YEAR = lambda c: rf"CASE WHEN regexp_matches(trim({c}), '^\d{{4}}') THEN CAST(substr(trim({c}), 1, 4) AS INTEGER) END"
_NUM = lambda c: f"coalesce(TRY_CAST(trim(regexp_replace({c}, '[%,]', '', 'g')) AS DOUBLE), 0.0)"


@query("scopus_scan", f"SELECT eid AS record_id, {_CELL('title')} AS title, {_YEAR(_CELL('pub_year'))} AS year, {_CELL('source_title')} AS source, {_NUM(_CELL('cited_by'))} AS citations, {_LIST(_CELL('author_keywords'))} AS keywords FROM scopus_records WHERE eid IS NOT NULL")
def scopus_scan(spark, d):
    """scopus_records written as an export and read back by its reader."""
    names = {"authors": "Authors", "title": "Title", "pub_year": "Year", "source_title": "Source title", "author_keywords": "Author Keywords", "index_keywords": "Index Keywords", "doi": "DOI", "cited_by": "Cited by", "eid": "EID", "affiliations": "Affiliations"}
    rows = table(spark, d, "scopus_records").where("eid is not null").select(*[_cell(F.col(c)).alias(n) for c, n in names.items()])
    got = tables.read_scopus(spark, _written(spark, rows, bom=True))
    return got.select("record_id", "title", "year", "source", "citations", F.array_join("keywords", "|").alias("keywords"))


@query("lens_scan", f"SELECT CAST(rec_id AS VARCHAR) AS record_id, {_CELL('title')} AS title, {_YEAR(_CELL('pub_year'))} AS year, {_NUM(_CELL('cited_by'))} AS citations, coalesce(array_to_string(list_filter(k, lambda x, i: list_position(k, x) = i), '|'), '') AS keywords FROM (SELECT *, [trim(x) for x in string_split({_CELL('author_keywords')}, ';') if trim(x) <> ''] AS k FROM scopus_records) WHERE trim({_CELL('title')}) <> ''")
def lens_scan(spark, d):
    c = F.col
    rows = table(spark, d, "scopus_records").select(c("rec_id").cast("string").alias("Lens ID"), _cell(c("title")).alias("Title"), _cell(c("pub_year")).alias("Publication Year"), _cell(c("cited_by")).alias("Citing Works Count"), _cell(c("author_keywords")).alias("Keywords"))
    got = tables.read_lens(spark, _written(spark, rows))
    return got.select("record_id", "title", "year", "citations", F.array_join("keywords", "|").alias("keywords"))


@query("dimensions_scan", f"SELECT {_CELL('title')} AS title, {_YEAR(_CELL('pub_year'))} AS year, {_NUM(_CELL('cited_by'))} AS citations, {_CELL('source_title')} AS source, count(*) AS n FROM scopus_records WHERE trim({_CELL('title')}) <> '' GROUP BY ALL")
def dimensions_scan(spark, d):
    c = F.col
    rows = table(spark, d, "scopus_records").select(_cell(c("title")).alias("Title"), _cell(c("pub_year")).alias("Publication Year"), _cell(c("cited_by")).alias("Times cited"), _cell(c("source_title")).alias("Source title"))
    return tables.read_dimensions(spark, _written(spark, rows)).groupBy("title", "year", "citations", "source").agg(F.count(F.lit(1)).alias("n"))


@query("thesaurus_scan", "SELECT p_name AS label, p_brand AS replace_by, count(*) AS n FROM part GROUP BY ALL")
def thesaurus_scan(spark, d):
    rows = table(spark, d, "part").select(F.col("p_name").alias("label"), F.col("p_brand").alias("replace by"))
    return tables.read_thesaurus(spark, _written(spark, rows, "\t")).groupBy("label", "replace_by").agg(F.count(F.lit(1)).alias("n"))


@query("matrix_scan", "SELECT c_name AS label, feature, value FROM (SELECT c_name, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey, 0.0::DOUBLE AS c_mktsegment FROM customer) UNPIVOT (value FOR feature IN (c_acctbal, c_nationkey, c_mktsegment))")
def matrix_scan(spark, d):
    """customer as a matrix file; the texts of a column that holds none are 0."""
    rows = table(spark, d, "customer").select("c_name", "c_acctbal", "c_nationkey", "c_mktsegment")
    return tables.read_matrix(spark, _written(spark, rows)).select("label", "feature", "value")


@query("indicator_scan", "SELECT n_name AS name, CAST(n_regionkey AS DOUBLE) AS region FROM nation")
def indicator_scan(spark, d):
    """An indicator file whose header isn't its first line."""
    lines = table(spark, d, "nation").select(F.concat_ws(",", "n_name", F.col("n_regionkey").cast("string"), F.lit("x")).alias("value"))
    top = spark.createDataFrame([(0, "Dataset updated in spring."), (1, "name,region,note")], "k int, value string")
    path = f"{own_dir(spark)}/export-{uuid.uuid4().hex}"
    top.unionByName(lines.withColumn("k", F.lit(2))).repartition(1).sortWithinPartitions("k").select("value").write.text(path)
    return matrices.coerce_numbers(tables.read_indicators(spark, path).select("name", "region"), ["region"])


@query("open_works_scan", f"SELECT rec_id, title, {_YEAR('pub_year')} AS year, {_NUM('cited_by')} AS citations, source_title AS source, doi FROM scopus_records")
def open_works_scan(spark, d):
    """scopus_records as pages of a works interface, a record a page."""
    c = F.col
    work = F.struct("title", T.year4(c("pub_year")).alias("publication_year"), T.safe_number(c("cited_by")).alias("cited_by_count"), "doi", F.struct(F.struct(c("source_title").alias("display_name")).alias("source")).alias("primary_location"))
    pages = table(spark, d, "scopus_records").select("rec_id", F.to_json(F.struct(F.array(work).alias("results"))).alias("j"))
    return works.open_works(pages, "j", "rec_id").select("rec_id", "title", "year", "citations", "source", "doi")


@query("cross_works_scan", f"SELECT rec_id, title, {_YEAR('pub_year')} AS year, {_NUM('cited_by')} AS citations, source_title AS source, doi FROM scopus_records")
def cross_works_scan(spark, d):
    c = F.col
    item = F.struct(F.array("title").alias("title"), F.struct(F.array(F.array(T.year4(c("pub_year")))).alias("date-parts")).alias("created"), T.safe_number(c("cited_by")).alias("is-referenced-by-count"), F.array("source_title").alias("container-title"), c("doi").alias("DOI"))
    pages = table(spark, d, "scopus_records").select("rec_id", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))).alias("j"))
    return works.cross_works(pages, "j", "rec_id").select("rec_id", "title", "year", "citations", "source", "doi")


@query("ui_numbers", r"SELECT rec_id, coalesce(TRY_CAST(regexp_extract(trim(regexp_replace(replace_first, '^([^,]*),', '\1.')), '^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][+-]?[0-9]+)?)', 1) AS DOUBLE), 0.0) AS cited FROM (SELECT rec_id, regexp_replace(cited_by, '^([^%]*)%', '\1') AS replace_first FROM scopus_records)")
def ui_numbers(spark, d):
    return table(spark, d, "scopus_records").select("rec_id", T.ui_number(F.col("cited_by")).alias("cited"))


@query(
    "level_names",
    """WITH t AS (SELECT p_partkey, CAST(p_partkey % 4 AS VARCHAR) AS macro, CAST(p_partkey % 12 AS VARCHAR) AS meso, p_name FROM part)
    SELECT p_partkey, macro, macro || '.' || meso AS code, p_name AS micro_name, CASE WHEN macro = '3' THEN 'Macro 3' ELSE 'Area ' || macro END AS macro_name, CASE WHEN meso IN ('5', '10') THEN 'Meso ' || meso ELSE 'Field ' || meso END AS meso_name FROM t""",
)
def level_names(spark, d):
    """Names of the upper levels of topic codes, with the fallback where a table has none."""
    c = F.col
    part = lambda n: (c("p_partkey") % n).cast("string")
    rows = table(spark, d, "part").select("p_partkey", F.concat(part(4), F.lit("."), part(12), F.lit("."), c("p_partkey").cast("string"), F.lit(" "), "p_name").alias("topic"))
    names = lambda n, label, skip: spark.range(n).where(~c("id").isin(skip)).select(F.concat(F.lit("0.") if n == 12 else c("id").cast("string"), c("id").cast("string") if n == 12 else F.lit(".0"), F.lit(".0 "), F.lit(label), c("id").cast("string")).alias("code"))
    out = indicators.named_levels(rows, "topic", names(4, "Area ", [3]), names(12, "Field ", [5, 10]))
    return out.select("p_partkey", "macro", F.concat_ws(".", "macro", "meso").alias("code"), "micro_name", "macro_name", "meso_name")


_DATE = r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(?:[^0-9A-Za-z_]|$)"


@query("date_clean", rf"SELECT rec_id, CASE WHEN regexp_matches(pub_year, '{_DATE}') THEN regexp_extract(pub_year, '{_DATE}', 1) ELSE pub_year END AS year FROM ris_records")
def date_clean(spark, d):
    return table(spark, d, "ris_records").select("rec_id", tagged.clean_date(F.col("pub_year")).alias("year"))


_FILES = ["Incites Organizations Colab 2021-2025.xlsx", "up_a1b2_InCites Locations Trend.csv", "Research Areas 2024.xls", "Research_Areas ESI.csv", "Funding_Agencies.xlsx", "notes.txt", "incites_publication sources 2019 - 2023.csv", "Trend.csv", "Researchers.xlsb"]
_NAMES = ", ".join(f"('{f}')" for f in _FILES)
_STANDARD = ", ".join(f"'{u}'" for u in units.UNITS)


@query(
    "unit_names",
    rf"""WITH f AS (SELECT file, regexp_replace(regexp_replace(file, '[.][^.]*$', ''), '^up_[a-zA-Z0-9]+_', '') AS b FROM (VALUES {_NAMES}) v(file)),
    k AS (SELECT *, CASE WHEN regexp_matches(b, '(?i)trend') THEN 1 WHEN regexp_matches(b, '\d{{4}}\s*-\s*\d{{4}}') THEN 2 WHEN regexp_matches(b, '\b(19|20)\d{{2}}\b') THEN 3 ELSE 0 END AS k FROM f),
    r AS (SELECT *, CASE k WHEN 1 THEN regexp_replace(b, '(?i)[\s_]*trend[\s_]*', ' ', 'g') WHEN 2 THEN regexp_replace(b, '[\s_]*\d{{4}}\s*-\s*\d{{4}}[\s_]*', ' ', 'g') WHEN 3 THEN regexp_replace(b, '[\s_]*\b(19|20)\d{{2}}\b[\s_]*', ' ', 'g') ELSE b END AS r FROM k),
    i AS (SELECT *, regexp_replace(r, '(?i)^(incites|in_cites)[\s_]*', '') AS i FROM r),
    a AS (SELECT *, CASE WHEN regexp_matches(i, '(?i)^Research[\s_]*Areas[\s_]+(ESI|SDG|Macro|Meso|Micro|WoS)') THEN regexp_replace(i, '(?i)^Research[\s_]*Areas[\s_]+', '') ELSE regexp_replace(i, '(?i)^Research[\s_]*Areas', 'WoS Categories') END AS a FROM i),
    u AS (SELECT *, trim(regexp_replace(a, '\s+', ' ', 'g')) AS u FROM a),
    s AS (SELECT *, (SELECT max(x) FROM (SELECT unnest([{_STANDARD}]) AS x) WHERE regexp_replace(lower(x), '[\s_]', '', 'g') = regexp_replace(lower(u), '[\s_]', '', 'g')) AS s FROM u)
    SELECT file, CASE WHEN regexp_matches(lower(file), '[.](csv|xlsx|xls|xlsb)$') THEN coalesce(s, CASE WHEN u = '' THEN 'Dataset Unit' ELSE u END) END AS unit,
      CASE WHEN regexp_matches(lower(file), '[.](csv|xlsx|xls|xlsb)$') THEN ['Whole', 'Trend', '5Years', '5Years'][k + 1] END AS period FROM s""",
)
def unit_names(spark, d):
    """Units and periods of file names."""
    return units.with_units(spark.createDataFrame([(f,) for f in _FILES], "file string"), "file")


@query("event_windows", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type AS term, count(*) AS count FROM events GROUP BY ALL")
def event_windows(spark, d):
    """Daily counts of event types; the same plan runs on a stream."""
    rows = tc.windowed_counts(table(spark, d, "events"), "ts", F.array("event_type"), "1 day", "1 day")
    return rows.withColumn("start", F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
