"""Text, list and thesaurus queries."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import thesaurus as th
from ..runtime import spread, table
from .registry import query

_SPLIT = "[trim(x) for x in string_split(lower({c}), ';') if trim(x) <> '']"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS + T.GENERAL)
_HEADING = rf"(?i)(^|[^A-Za-z0-9_])(?:{T.HEADINGS})\s*:\s*"


def sql_clean(c: str) -> str:
    out = rf"regexp_replace({c}, '{_HEADING}', '\1 ', 'g')"
    for p in T.NOTICES:
        out = f"regexp_replace({out}, '(?i){p}', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{T.WS}', ' ', 'g'))"


def sql_singular(c: str) -> str:
    last = f"regexp_extract({c}, '([^ ]*)$', 1)"
    head = f"substr({c}, 1, length({c}) - length({last}))"
    irregular = " ".join(f"WHEN {last} = '{a}' THEN '{b}'" for a, b in T.IRREGULAR.items())
    cut = lambda n: f"substr({last}, 1, length({last}) - {n})"
    return f"""({head} || CASE {irregular} WHEN length({last}) <= 4 THEN {last}
      WHEN regexp_matches({last}, 'ies$') AND NOT regexp_matches({last}, 'eies$') THEN {cut(3)} || 'y'
      WHEN regexp_matches({last}, 'ses$') AND NOT regexp_matches({last}, 'sses$') THEN {cut(2)}
      WHEN regexp_matches({last}, '(ches|shes|xes|zes)$') THEN {cut(2)}
      WHEN regexp_matches({last}, 's$') AND NOT regexp_matches({last}, '(ss|us|is|as)$') THEN {cut(1)} ELSE {last} END)"""


@query("list_split", f"SELECT rec_id, unnest({_SPLIT.format(c='author_keywords')}) AS term FROM scopus_records")
def list_split(spark, d):
    return table(spark, d, "scopus_records").select("rec_id", F.explode(T.split_list(F.col("author_keywords"))).alias("term"))


@query(
    "affiliation_countries",
    """SELECT DISTINCT rec_id, c AS country FROM (SELECT rec_id, lower(trim(list_extract(string_split(a, ','), -1))) AS c
    FROM (SELECT rec_id, unnest(string_split(affiliations, ';')) AS a FROM scopus_records)) WHERE length(c) > 2""",
)
def affiliation_countries(spark, d):
    return table(spark, d, "scopus_records").select("rec_id", F.explode(T.countries(F.col("affiliations"))).alias("country"))


@query("markup_strip", f"SELECT sem_id, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '{T.WS}', ' ', 'g')) AS title FROM semantic_records")
def markup_strip(spark, d):
    return table(spark, d, "semantic_records").select("sem_id", T.strip_markup(F.col("title")).alias("title"))


@query("text_clean", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def text_clean(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", T.clean_scientific(F.col("text")).alias("text"))


@query("singularize", f"SELECT term, {sql_singular('term')} AS singular FROM (SELECT DISTINCT unnest({_SPLIT.format(c='author_keywords')}) AS term FROM scopus_records)")
def singularize(spark, d):
    terms = table(spark, d, "scopus_records").select(F.explode(T.split_list(F.col("author_keywords"))).alias("term")).distinct()
    return terms.select("term", T.singular(F.col("term")).alias("singular"))


PHRASES_SQL = rf"""
  sentences AS (SELECT id, unnest(s) AS sentence, generate_subscripts(s, 1) AS sn FROM (SELECT id, string_split_regex({sql_clean('text')}, '[.!?;\n]+') AS s FROM texts)),
  tokens AS (SELECT id, sn, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (SELECT id, sn, [x for x in regexp_extract_all(sentence, '{T._TOKEN}', 1) if x <> ''] AS t FROM sentences)),
  marked AS (SELECT *, lower(tok) AS low, (lower(tok) IN ({_STOP}) OR (length(tok) = 1 AND tok = lower(tok))) AS stop FROM tokens),
  runs AS (SELECT *, sum(CASE WHEN stop OR length(tok) = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id, sn ORDER BY pos) AS run FROM marked),
  placed AS (SELECT *, (row_number() OVER (PARTITION BY id, sn, run ORDER BY pos) - 1) // 3 AS chunk FROM runs WHERE NOT stop),
  raw AS (SELECT id, sn, run, chunk, string_agg(low, ' ' ORDER BY pos) AS p FROM placed GROUP BY id, sn, run, chunk),
  phrases AS (SELECT id, term FROM (SELECT id, {sql_singular('p')} AS term FROM raw) WHERE length(term) > 2 AND term NOT IN ({_STOP}))"""


@query("noun_phrases", f"WITH texts AS (SELECT sem_id AS id, abstract AS text FROM semantic_records), {PHRASES_SQL} SELECT id AS sem_id, term, count(*) AS n FROM phrases GROUP BY id, term")
def noun_phrases(spark, d):
    rows = spread(table(spark, d, "semantic_records").select("sem_id", "abstract")).select("sem_id", F.explode(T.noun_phrases(F.col("abstract"))).alias("term"))
    return rows.groupBy("sem_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "year_normalize",
    r"SELECT rec_id, CASE WHEN regexp_matches(trim(pub_year), '^\d{4}') THEN CAST(substr(trim(pub_year), 1, 4) AS INTEGER) END AS year FROM ris_records",
)
def year_normalize(spark, d):
    return table(spark, d, "ris_records").select("rec_id", T.year4(F.col("pub_year")).alias("year"))


@query("safe_number", "SELECT rec_id, coalesce(TRY_CAST(trim(regexp_replace(cited_by, '[%,]', '', 'g')) AS DOUBLE), 0.0) AS cited FROM scopus_records")
def safe_number(spark, d):
    return table(spark, d, "scopus_records").select("rec_id", T.safe_number(F.col("cited_by")).alias("cited"))


_AZ = "a-zA-ZÀ-ÿ"


@query(
    "title_case",
    rf"""WITH t AS (SELECT DISTINCT lower(source_title) AS s FROM scopus_records WHERE source_title IS NOT NULL)
    SELECT s AS source, array_to_string([regexp_extract(w, '^([^{_AZ}]*)', 1)
      || upper(regexp_extract(w, '^[^{_AZ}]*([{_AZ}]?)', 1)) || regexp_extract(w, '^[^{_AZ}]*[{_AZ}]?(.*)$', 1) for w in regexp_extract_all(s, '([^{_AZ}]*[{_AZ}]*)', 1)], '') AS label FROM t""",
)
def title_case(spark, d):
    low = table(spark, d, "scopus_records").select(F.lower("source_title").alias("source")).where("source is not null").distinct()
    return low.select("source", T.title_case(F.col("source")).alias("label"))


@query(
    "topic_codes",
    r"""WITH n AS (SELECT DISTINCT (o_orderkey % 7) || '.' || (o_custkey % 11) || '.' || (o_orderkey % 13) || ' ' || o_orderpriority AS name FROM orders)
    SELECT name, split_part(split_part(name, ' ', 1), '.', 1) AS macro, split_part(split_part(name, ' ', 1), '.', 2) AS meso,
      split_part(split_part(name, ' ', 1), '.', 3) AS micro, trim(regexp_extract(name, '^[^ ]* (.*)$', 1)) AS short FROM n""",
)
def topic_codes(spark, d):
    o = table(spark, d, "orders")
    names = o.select(F.concat((F.col("o_orderkey") % 7).cast("string"), F.lit("."), (F.col("o_custkey") % 11).cast("string"), F.lit("."), (F.col("o_orderkey") % 13).cast("string"), F.lit(" "), F.col("o_orderpriority")).alias("name")).distinct()
    return names.select("name", T.topic_code(F.col("name")).alias("t")).select("name", "t.macro", "t.meso", "t.micro", "t.short")


@query(
    "trajectory_labels",
    """WITH l AS (SELECT DISTINCT unnest(mapped_labels) AS label FROM som_neurons), p AS (SELECT label, string_split(label, '_') AS s FROM l)
    SELECT label, CASE WHEN len(s) < 2 THEN label WHEN TRY_CAST(s[-1] AS DOUBLE) IS NOT NULL AND TRY_CAST(s[1] AS DOUBLE) IS NULL THEN array_to_string(s[1:len(s)-1], '_') ELSE array_to_string(s[2:len(s)], '_') END AS entity,
      CASE WHEN len(s) < 2 THEN '' WHEN TRY_CAST(s[-1] AS DOUBLE) IS NOT NULL AND TRY_CAST(s[1] AS DOUBLE) IS NULL THEN s[-1] ELSE s[1] END AS time, len(s) >= 2 AS temporal FROM p""",
)
def trajectory_labels(spark, d):
    labels = table(spark, d, "som_neurons").select(F.explode("mapped_labels").alias("label")).distinct()
    return labels.select("label", T.trajectory(F.col("label")).alias("t")).select("label", "t.entity", "t.time", "t.temporal")


# a thesaurus over keywords: replacements, a chain that must not be followed, and drops
THESAURUS = [("coral reef", "reef"), ("reef", "barrier reef"), ("Food Web", "trophic network"), ("steel alloy", "<ignore>"), ("quantum state", " "), ("SOIL MOISTURE", "soil water"), ("student debt", None), ("trade guild", "none")]
_TH = ", ".join("({}, {})".format(*("NULL" if x is None else f"'{x}'" for x in r)) for r in THESAURUS)


@query(
    "thesaurus_apply",
    f"""WITH th AS (SELECT lower(trim(l)) AS low, trim(r) AS new FROM (VALUES {_TH}) v(l, r)),
    t AS (SELECT rec_id, unnest(keywords) AS term, generate_subscripts(keywords, 1) - 1 AS pos FROM ris_records),
    j AS (SELECT rec_id, pos, CASE WHEN low IS NULL THEN trim(term) WHEN lower(coalesce(new, '')) IN ('', '<ignore>', '<delete>', '<remove>', 'null', 'none', '-') THEN NULL ELSE new END AS term
      FROM t LEFT JOIN th ON lower(trim(t.term)) = th.low WHERE term IS NOT NULL)
    SELECT rec_id, pos, term FROM (SELECT *, row_number() OVER (PARTITION BY rec_id, lower(term) ORDER BY pos) AS k FROM j WHERE term IS NOT NULL AND term <> '') WHERE k = 1""",
)
def thesaurus_apply(spark, d):
    thesaurus = th.prepare(spark.createDataFrame(THESAURUS, "label string, replace_by string"))
    terms = table(spark, d, "ris_records").select("rec_id", F.posexplode("keywords").alias("pos", "term"))
    return th.apply_terms(terms, "rec_id", "pos", "term", thesaurus)


@query(
    "record_search",
    """SELECT sem_id FROM semantic_records WHERE contains(lower(title), 'map') OR contains(lower(abstract), 'map') OR contains(lower(doi), 'map')
    OR len([k for k in coalesce(keywords, []) if contains(lower(k), 'map')]) > 0""",
)
def record_search(spark, d):
    q = F.lit("map")
    has = lambda c: F.coalesce(F.contains(F.lower(c), q), F.lit(False))
    found = has(F.col("title")) | has(F.col("abstract")) | has(F.col("doi")) | F.coalesce(F.exists("keywords", lambda k: has(k)), F.lit(False))
    return table(spark, d, "semantic_records").where(found).select("sem_id")


@query(
    "record_concat",
    r"""SELECT sem_id, array_to_string([x for x in [CASE WHEN trim(title) <> '' THEN 'Title: ' || title END, CASE WHEN trim(abstract) <> '' THEN 'Abstract: ' || abstract END,
      CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string([k for k in keywords if k IS NOT NULL], ', ') END] if x IS NOT NULL], ' | ') AS joined,
      CASE WHEN regexp_matches(lower(doi), '10\.\d{4,9}/[-._;()/:a-z0-9]+') THEN regexp_extract(lower(doi), '10\.\d{4,9}/[-._;()/:a-z0-9]+') ELSE 'ID_' || sem_id END AS record_key FROM semantic_records""",
)
def record_concat(spark, d):
    c = F.col
    part = lambda name, body, ok: F.when(ok, F.concat(F.lit(name), body))
    kw = F.array_join(F.filter("keywords", lambda k: k.isNotNull()), ", ")
    doi = r"10\.\d{4,9}/[-._;()/:a-z0-9]+"
    return table(spark, d, "semantic_records").select(
        "sem_id",
        F.concat_ws(" | ", part("Title: ", c("title"), F.trim("title") != ""), part("Abstract: ", c("abstract"), F.trim("abstract") != ""), part("Keywords: ", kw, F.size("keywords") > 0)).alias("joined"),
        F.when(F.lower("doi").rlike(doi), F.regexp_extract(F.lower("doi"), doi, 0)).otherwise(F.concat(F.lit("ID_"), c("sem_id").cast("string"))).alias("record_key"),
    )
