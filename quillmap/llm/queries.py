"""Queries and SQL of this subpackage: pN_... over the tables of TESTDATA.md."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packed_fields import packed_names
from ..runtime import table
from . import cooccurrence as co
from . import clusters, leakage, matching, names, neighbours, subjects, tokenization


def p2_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Both fields with counts, lift and odds ratio."""
    authors = co.cooccurrence(co.record_items(packed_names(table(spark, d, "scopus_records"), "rec_id", "authors"), "rec_id", "items"))
    keywords = co.cooccurrence(co.record_items(table(spark, d, "semantic_records"), "sem_id", "keywords"))
    return authors.select(F.lit("authors").alias("field_name"), "*").unionByName(keywords.select(F.lit("keywords").alias("field_name"), "*"))


def p2_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The keywords field with counts, lift and odds ratio."""
    return co.cooccurrence(co.record_items(table(spark, d, "semantic_records"), "sem_id", "keywords"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_cooccurrence(spark, d).select("field_name", "item_a", "item_b")


def _p3_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = F.col
    sem = table(spark, d, "semantic_records")
    left = matching.fields(sem, "sem_id", 0, c("title"), c("doi"), c("extras")["PY"], c("extras")["AU"], c("extras")["SO"], F.array_join("keywords", ";"))
    scopus = matching.fields(table(spark, d, "scopus_records"), "rec_id", 1, c("title"), c("doi"), c("pub_year"), c("authors"), c("source_title"), c("author_keywords"))
    ris = matching.fields(table(spark, d, "ris_records"), "rec_id", 1, c("title"), c("doi"), c("pub_year"), F.array_join("authors", ";"), c("journal"), F.array_join("keywords", ";"))
    return left, scopus.unionByName(ris)


def p3_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of rows of one work with cosine, evidence and confidence."""
    c = F.col
    return matching.match_records(*_p3_sides(spark, d)).select(c("a").alias("sem_id"), c("b").alias("rec_id"), F.round("cosine", 6).alias("cosine"), F.round("evidence", 6).alias("evidence"), "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_pairs(*_p3_sides(spark, d)).select(F.col("a").alias("sem_id"), F.col("b").alias("rec_id"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "author_names")
    return names.person_pairs(names.link_names(rows, "name_id", "author_name", "affiliation", "top_keyword", "first_year", "last_year"))


#: Lengths of the vectors of intrinsic_vectors and som_neurons.
VECTOR_DIM, NEURON_DIM = 24, 12


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest others of each usable vector, with distances."""
    vectors = neighbours.nearest_ids(table(spark, d, "intrinsic_vectors"), "vec_id", "intrinsic_data", VECTOR_DIM)
    neurons = neighbours.nearest_ids(table(spark, d, "som_neurons"), "neuron_id", "weights", NEURON_DIM)
    return vectors.select(F.lit("vectors").alias("coll"), "*").unionByName(neurons.select(F.lit("neurons").alias("coll"), "*"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_neighbours(spark, d).select("coll", "vec_id", "near_id")


#: Collection, table, id, vector, its length, and what its groups lie within.
COLLECTIONS = (("vectors", "intrinsic_vectors", "vec_id", "intrinsic_data", VECTOR_DIM, None), ("neurons", "som_neurons", "neuron_id", "weights", NEURON_DIM, "run_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    vectors, neurons = (clusters.groups(table(spark, d, t), i, v, n, within).select(F.lit(coll).alias("coll"), "*") for coll, t, i, v, n, within in COLLECTIONS)
    return vectors.unionByName(neurons).where(F.col("id") != F.col("head")).select("coll", F.col("head").alias("head_id"), F.col("id").alias("member_id"))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each group of intrinsic_vectors and, within each run, of som_neurons."""

    def described(coll, t, i, v, n, within):
        rows = table(spark, d, t)
        return clusters.describe(rows, i, v, clusters.groups(rows, i, v, n, within), n).select(F.lit(coll).alias("coll"), "*")

    vectors, neurons = (described(*c) for c in COLLECTIONS)
    return vectors.unionByName(neurons)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenization.encode(table(spark, d, "documents"), "doc_id", "text")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "item_text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "subject_labels"), table(spark, d, "subjects"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_subjects(spark, d).select("doc_id", "subject")


def p9_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subjects.makeup(p9_subjects(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ITEM = f"trim(regexp_replace(lower(k), '{_WS}', ' ', 'g'))"
_OK = "{v} IS NOT NULL AND len({v}) = {n} AND len([x for x in {v} if x IS NULL OR isnan(x)]) = 0"

#: Brute force over the same tables, where SQL can say it.
SQL: dict[str, str] = {
    "p2_keywords": f"""WITH t AS (SELECT DISTINCT sem_id AS rec, {_ITEM} AS item FROM (SELECT sem_id, unnest(keywords) AS k FROM semantic_records) WHERE k IS NOT NULL AND {_ITEM} <> ''),
      n AS (SELECT count(DISTINCT rec) AS n FROM t), c AS (SELECT item, count(*) AS k FROM t GROUP BY item),
      p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM t a JOIN t b ON a.rec = b.rec AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5),
      q AS (SELECT item_a, item_b, n_ab, x.k AS n_a, y.k AS n_b, n.n FROM p JOIN c x ON x.item = item_a JOIN c y ON y.item = item_b CROSS JOIN n)
      SELECT *, round(n_ab * n / CAST(n_a * n_b AS DOUBLE), 6) AS lift, round((n_ab + 0.5::DOUBLE) * (n - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE)), 6) AS odds_ratio
      FROM q WHERE n_ab * n >= 10 * n_a * n_b""",
    "p5_found": f"""WITH v AS (SELECT 'vectors' AS coll, vec_id AS id, [CAST(x AS DOUBLE) for x in intrinsic_data] AS v FROM intrinsic_vectors WHERE {_OK.format(v="intrinsic_data", n=VECTOR_DIM)}
        UNION ALL SELECT 'neurons', neuron_id, weights FROM som_neurons WHERE {_OK.format(v="weights", n=NEURON_DIM)}),
      u AS (SELECT coll, id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
      d AS (SELECT a.coll, a.id, b.id AS other, round(sum((a.x - b.x) * (a.x - b.x)), 9) AS d FROM u a JOIN u b ON a.coll = b.coll AND a.i = b.i AND a.id <> b.id GROUP BY ALL)
      SELECT coll, id AS vec_id, other AS near_id FROM (SELECT *, row_number() OVER (PARTITION BY coll, id ORDER BY d, other) AS k FROM d) WHERE k <= 5""",
}
