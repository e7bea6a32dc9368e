"""Relevance of terms and keywords of groups of texts.

Relevance: how far a term's companions differ from what term frequencies alone would give,
sum over w2 of p(w2|w1) ln(p(w2|w1) / p(w2)), rounded to 4. Terms without companions score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import global_rank, with_group, with_total
from . import network as N

# Words that are no keyword of a title, English and Spanish.
TITLE_STOPWORDS = """a about after all also among an and are as at based be been between both but by can do does each for from has have how if in into is it its
may more most no not of on only or other our over s such than that the their them then there these they this those through to under up use using was we were
what when which while who will with within without de la el en y a los del se las por un para con no una su al lo como mas pero sus le ya o este si porque esta
entre cuando muy sin sobre tambien me hasta hay donde""".split()


def relevance(docs: DataFrame, least: int = 1) -> DataFrame:
    """term, score of the terms of at least `least` records."""
    docs = N.keep_frequent(docs, least) if least > 1 else docs
    nodes = N.node_counts(docs)
    half = N.pairs(docs).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c"))
    both = half.unionAll(half.select("dst", "src", "c"))
    q = with_total(nodes, total=F.sum("count")).select(F.col("term").alias("dst"), (F.col("count") / F.col("total")).alias("q"))
    p = with_group(both, ["src"], total=F.sum("c")).withColumn("p", F.col("c") / F.col("total")).join(q, "dst")
    score = p.groupBy(F.col("src").alias("term")).agg(F.round(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 4).alias("score"))
    return nodes.select("term", "count").join(score, "term", "left").select("term", "count", F.coalesce("score", F.lit(0.0)).alias("score"))


def select_terms(scored: DataFrame, least: int, ratio: float) -> DataFrame:
    """The best floor(n ratio), at least one, of the n terms of `least` records or more; ties by term.
    Where no term is frequent enough all are kept."""
    eligible = scored.where(F.col("count") >= least)
    ranked = with_total(global_rank(eligible, F.desc("score"), "term", name="k"), n=F.count(F.lit(1)))
    best = ranked.where(F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("n") * ratio))).drop("n", "k")
    none = eligible.limit(1).agg((F.count(F.lit(1)) == 0).alias("none"))
    return best.unionByName(scored.crossJoin(F.broadcast(none)).where("none").drop("none"))


def title_terms(df: DataFrame, group: str, doc: str, title: str) -> DataFrame:
    """group, doc, terms: words of two letters or more without stopwords, and pairs of neighbours among them."""
    words = F.filter(F.regexp_extract_all(F.lower(title), F.lit(r"([a-z0-9_]{2,})"), 1), lambda w: ~w.isin(TITLE_STOPWORDS))
    w = df.where(F.col(group).isNotNull() & F.col(title).isNotNull()).select(group, doc, words.alias("w"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get("w", i + 1)))
    return w.select(group, doc, F.concat("w", pairs).alias("terms"))


def group_keywords(df: DataFrame, group: str, doc: str, title: str, features: int = 1000, top: int = 20) -> DataFrame:
    """group, term, score, rank: summed TF-IDF (smoothed idf, L2 per title) of each group's titles; terms of more than
    three letters among the group's `features` most frequent ones; ties by term."""
    each = title_terms(df, group, doc, title).select(group, doc, F.explode("terms").alias("term"))
    tf = each.groupBy(group, doc, "term").agg(F.count(F.lit(1)).alias("tf"))
    stat = tf.groupBy(group, "term").agg(F.sum("tf").alias("all"), F.count(F.lit(1)).alias("df"))
    kept = stat.withColumn("f", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("all"), "term"))).where(F.col("f") <= features)
    n = df.where(F.col(group).isNotNull() & F.col(title).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    w = tf.join(kept.select(group, "term", "df"), [group, "term"]).join(n, group).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    unit = w.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(group, doc))))
    score = unit.groupBy(group, "term").agg(F.round(F.sum("w"), 6).alias("score")).where(F.length("term") > 3)
    return score.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= top)


def labels(keywords: DataFrame, group: str, words: int = 2) -> DataFrame:
    """group, label: the first `words` keywords that neither hold nor stand in one before them, joined by ' / ';
    'Topic g' without keywords, 'Noise' for group -1."""
    ordered = keywords.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("t"))
    empty = F.array().cast("array<string>")
    pick = F.aggregate("t", empty, lambda s, t: F.when((F.size(s) < words) & ~F.exists(s, lambda o: F.contains(o, t) | F.contains(t, o)), F.array_append(s, t)).otherwise(s))
    label = F.when(F.col(group) == -1, F.lit("Noise")).when(F.size("p") > 0, F.array_join("p", " / ")).otherwise(F.concat(F.lit("Topic "), F.col(group).cast("string")))
    return ordered.withColumn("p", pick).select(group, label.alias("label"))
