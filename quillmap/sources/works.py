"""Saved pages of two public works interfaces, and network files, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse

OPEN_SCHEMA = """results array<struct<title:string, abstract_inverted_index:map<string,array<int>>, publication_year:int, cited_by_count:double, doi:string,
authorships:array<struct<author:struct<display_name:string>>>, concepts:array<struct<display_name:string, score:double>>, keywords:array<struct<display_name:string>>,
primary_location:struct<source:struct<display_name:string>>>>"""
_PARTS = "struct<`date-parts`:array<array<int>>>"
CROSS_SCHEMA = f"""message struct<items:array<struct<title:array<string>, abstract:string, `published-print`:{_PARTS}, `published-online`:{_PARTS}, created:{_PARTS},
`is-referenced-by-count`:double, author:array<struct<given:string, family:string>>, subject:array<string>, `container-title`:array<string>, DOI:string>>>"""
NETWORK_SCHEMA = """network struct<items:array<struct<id:long, label:string, x:double, y:double, cluster:int, weights:map<string,double>, scores:map<string,double>>>,
links:array<struct<source_id:long, target_id:long, strength:double>>>"""


def abstract_text(inverted: Column) -> Column:
    """Words of an inverted index in their order."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def open_works(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """keep, title, abstract, year, citations, authors, keywords (concepts above 0.3, then new keywords), source, doi."""
    w = df.select(*keep, F.explode(F.from_json(json, OPEN_SCHEMA)["results"]).alias("w")).select(*keep, "w.*")
    names = lambda c: F.filter(F.transform(c, lambda x: x["display_name"]), lambda x: x.isNotNull())
    concepts = F.coalesce(names(F.filter("concepts", lambda c: c["score"] > 0.3)), F.array().cast("array<string>"))
    more = F.filter(F.coalesce(names(F.col("keywords")), F.array().cast("array<string>")), lambda k: ~F.array_contains(concepts, k))
    authors = F.filter(F.transform("authorships", lambda a: a["author"]["display_name"]), lambda x: x.isNotNull())
    return w.select(*keep, "title", abstract_text(F.col("abstract_inverted_index")).alias("abstract"), F.col("publication_year").alias("year"), F.coalesce("cited_by_count", F.lit(0.0)).alias("citations"), authors.alias("authors"), F.concat(concepts, more).alias("keywords"), F.col("primary_location.source.display_name").alias("source"), "doi")


def cross_works(df: DataFrame, json: str, *keep: str) -> DataFrame:
    """The same fields; markup leaves the abstract, the year is that of print, else online, else creation."""
    w = df.select(*keep, F.explode(F.from_json(json, CROSS_SCHEMA)["message"]["items"]).alias("w")).select(*keep, "w.*")
    year = F.coalesce(*[F.get(F.get(F.col(f"`{c}`")["date-parts"], F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "created")])
    name = F.transform("author", lambda a: F.concat_ws(", ", a["family"], a["given"]))
    return w.select(*keep, F.get("title", F.lit(0)).alias("title"), collapse(F.regexp_replace("abstract", "<[^>]+>", " ")).alias("abstract"), year.alias("year"), F.coalesce("is-referenced-by-count", F.lit(0.0)).alias("citations"), F.filter(name, lambda x: x != "").alias("authors"), F.coalesce("subject", F.array().cast("array<string>")).alias("keywords"), F.get(F.col("`container-title`"), F.lit(0)).alias("source"), F.col("DOI").alias("doi"))


def network_items(df: DataFrame, json: str) -> DataFrame:
    """id (its place from 1 where missing), label, x, y, cluster (1), count (1)."""
    items = df.select(F.posexplode(F.from_json(json, NETWORK_SCHEMA)["network"]["items"]).alias("p", "i"))
    return items.select(F.coalesce("i.id", F.col("p") + 1).cast("long").alias("id"), "i.label", F.coalesce("i.x", F.lit(0.0)).alias("x"), F.coalesce("i.y", F.lit(0.0)).alias("y"), F.coalesce("i.cluster", F.lit(1)).alias("cluster"), F.coalesce(F.try_element_at("i.weights", F.lit("Occurrences")), F.lit(1.0)).alias("count"))


def network_links(df: DataFrame, json: str) -> DataFrame:
    links = df.select(F.explode(F.from_json(json, NETWORK_SCHEMA)["network"]["links"]).alias("l"))
    return links.select(F.col("l.source_id").alias("src"), F.col("l.target_id").alias("dst"), F.coalesce("l.strength", F.lit(1.0)).alias("weight"))


def read_json_texts(spark: SparkSession, path: str) -> DataFrame:
    """value: whole files, one document each."""
    return spark.read.text(path, wholetext=True)
