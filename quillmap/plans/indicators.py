"""Indicator and series queries: nations by order year as entities, lines as citations."""

from pyspark.sql import functions as F

from ..operators import indicators as I
from ..operators import series as S
from ..runtime import global_rank, table
from .registry import query

LINES = "lines AS (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey)"
IND = f"""{LINES}, ind AS (SELECT n_name AS entity, year(o_orderdate) AS year, count(*) AS docs, coalesce(sum(q), 0) AS cited, coalesce(sum(n), 0) AS patents
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY ALL),
  base AS (SELECT year, sum(docs) AS base, sum(cited) AS cited FROM ind GROUP BY year)"""
_R = lambda a, b: f"coalesce({a} / nullif(CAST({b} AS DOUBLE), 0), 0)"


def orders_by_nation(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"), "o_orderpriority")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, d, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def indicator_table(spark, d):
    rows = orders_by_nation(spark, d)
    return rows.groupBy(F.col("n_name").alias("entity"), "year").agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("cited"), F.coalesce(F.sum("n"), F.lit(0)).alias("patents"))


def baseline(ind):
    return ind.groupBy("year").agg(F.sum("docs").alias("docs"), F.sum("cited").alias("cited"))


@query(
    "profile_derived",
    f"""WITH {IND} SELECT entity, year, docs, round({_R('docs', 'base')} * 100, 6) AS share, round({_R('ind.cited', 'docs')}, 6) AS impact, round({_R('patents', 'docs')}, 6) AS patents_per_paper
    FROM ind LEFT JOIN base USING (year)""",
)
def profile_derived(spark, d):
    ind = indicator_table(spark, d).cache()
    return I.derive(ind, "docs", "cited", "patents", baseline(ind), "year").select("entity", "year", "docs", "share", "impact", "patents_per_paper")


@query("profile_top", "SELECT s_name AS entity, coalesce(CAST(n AS DOUBLE), 0) AS docs, coalesce(q, 0) AS cited FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey ORDER BY 2 DESC, 1 LIMIT 1500")
def profile_top(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("docs"), F.sum("l_quantity").alias("cited"))
    rows = table(spark, d, "supplier").join(n, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(F.col("s_name").alias("entity"), "docs", "cited")
    return I.profile(rows, "entity", "docs", ["docs", "cited"])


@query("quartiles", """SELECT s_name AS entity, CAST(q1 AS DOUBLE) AS "Q1", CAST(q2 AS DOUBLE) AS "Q2", CAST(q3 AS DOUBLE) AS "Q3", CAST(q4 AS DOUBLE) AS "Q4" FROM supplier JOIN (SELECT l_suppkey,
  count(*) FILTER (l_linenumber = 1) AS q1, count(*) FILTER (l_linenumber = 2) AS q2, count(*) FILTER (l_linenumber = 3) AS q3, count(*) FILTER (l_linenumber = 4) AS q4 FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey
  WHERE greatest(q1, q2, q3, q4) > 0""")
def quartiles(spark, d):
    counts = table(spark, d, "lineitem").groupBy("l_suppkey").agg(*(F.count_if(F.col("l_linenumber") == k).alias(f"Documents in Q{k} Journals") for k in range(1, 5)))
    rows = table(spark, d, "supplier").join(counts, F.col("s_suppkey") == F.col("l_suppkey")).withColumnRenamed("s_name", "entity")
    return I.quartile_profile(rows, "entity", counts.columns)


@query("baseline_split", "SELECT source_title AS entity, contains(lower(source_title), 'annals') AS is_baseline FROM (SELECT DISTINCT source_title FROM scopus_records) WHERE source_title IS NOT NULL")
def baseline_split(spark, d):
    """The baseline test of entities, on titles in which 'annals' stands for 'baseline'."""
    titles = table(spark, d, "scopus_records").select(F.col("source_title").alias("entity")).where("entity is not null").distinct()
    return titles.select("entity", I.is_baseline(F.regexp_replace(F.lower("entity"), "annals", "baseline")).alias("is_baseline"))


@query("baseline_trend", f"WITH {IND} SELECT year, CAST(base AS BIGINT) AS docs, cited FROM base")
def baseline_trend(spark, d):
    return baseline(indicator_table(spark, d))


@query("baseline_compare", f"WITH {IND}, one AS (SELECT year, sum(docs) FILTER (entity = 'CANADA') AS ds, sum(docs) AS alls FROM ind GROUP BY year) SELECT year, CASE WHEN alls > 0 THEN alls ELSE coalesce(ds, 0) END AS reference FROM one")
def baseline_compare(spark, d):
    g = indicator_table(spark, d).groupBy("year").agg(F.sum(F.when(F.col("entity") == "CANADA", F.col("docs"))).alias("ds"), F.sum("docs").alias("alls"))
    return g.select("year", F.when(F.col("alls") > 0, F.col("alls")).otherwise(F.coalesce("ds", F.lit(0))).alias("reference"))


_HIER = f"""{LINES}, leaf AS (SELECT r_name AS macro, n_name AS meso, c_mktsegment AS micro, count(*) AS docs, coalesce(sum(q), 0) AS cited FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query(
    "rollup_hierarchy",
    f"""WITH {_HIER} SELECT CASE WHEN grouping(micro) = 0 THEN 3 WHEN grouping(meso) = 0 THEN 2 ELSE 1 END AS level, macro, meso, micro, count(*) AS n, round(sum(cited), 4) AS cited_sum,
    round(sum(cited * CASE WHEN docs = 0 THEN 1 ELSE docs END) / sum(CASE WHEN docs = 0 THEN 1 ELSE docs END), 4) AS cited_mean FROM leaf GROUP BY GROUPING SETS ((macro, meso, micro), (macro, meso), (macro))""",
)
def rollup_hierarchy(spark, d):
    return I.rollup(leaves(spark, d), ("macro", "meso", "micro"), "docs", ["cited"])


def leaves(spark, d):
    rows = orders_by_nation(spark, d).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("macro"), F.col("n_name").alias("meso"), F.col("c_mktsegment").alias("micro")).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("cited"))


@query(
    "sunburst_layout",
    f"""WITH {_HIER}, m AS (SELECT macro, meso, sum(cited) AS size FROM leaf GROUP BY ALL), w AS (SELECT *, sum(size) OVER (PARTITION BY macro ORDER BY size DESC, meso ROWS UNBOUNDED PRECEDING) AS run, sum(size) OVER (PARTITION BY macro) AS total FROM m)
    SELECT macro, meso, size, round(2 * pi() * run / total, 6) AS x1, round(2 * pi() * (run - size) / total, 6) AS x0 FROM w""",
)
def sunburst_layout(spark, d):
    return I.angles(leaves(spark, d).groupBy("macro", "meso").agg(F.sum("cited").alias("size")), "macro", "meso", "size")


@query("cagr", f"""WITH {IND}, g AS (SELECT entity, arg_min(docs, year) AS first, arg_max(docs, year) AS last, count(*) AS n FROM ind GROUP BY entity)
  SELECT entity, first, last, n, round(coalesce((pow(last / (CASE WHEN first = 0 THEN 0.0001 ELSE first::DOUBLE END), 1.0::DOUBLE / nullif(n - 1, 0)) - 1) * 100, 0), 6) AS cagr FROM g""")
def cagr(spark, d):
    return I.growth(indicator_table(spark, d), "entity", "year", "docs")


@query("growth_median", f"""WITH {IND}, t AS (SELECT entity, sum(docs) AS docs FROM ind GROUP BY entity), k AS (SELECT docs, row_number() OVER (ORDER BY docs) - 1 AS k, count(*) OVER () AS n FROM t) SELECT CAST(docs AS BIGINT) AS median FROM k WHERE k = n // 2""")
def growth_median(spark, d):
    return I.upper_median(indicator_table(spark, d).groupBy("entity").agg(F.sum("docs").alias("docs")), "docs")


@query("stacked_share", f"WITH {IND} SELECT entity, year, docs, round(docs / sum(docs) OVER (PARTITION BY year) * 100, 6) AS percent FROM ind")
def stacked_share(spark, d):
    return I.stacked_share(indicator_table(spark, d).select("entity", "year", "docs"), "year", "docs")


@query("ts_top20", f"""WITH {IND}, l AS (SELECT entity, arg_max(docs, year) AS docs, arg_max(cited, year) AS cited FROM ind GROUP BY entity), u AS (SELECT 'docs' AS indicator, entity, CAST(docs AS DOUBLE) AS latest FROM l UNION ALL SELECT 'cited', entity, cited FROM l)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY indicator ORDER BY latest DESC, entity) AS INTEGER) AS rank FROM u) WHERE rank <= 20""")
def ts_top20(spark, d):
    ind = indicator_table(spark, d).select("entity", "year", F.col("docs").cast("double").alias("docs"), "cited")
    long = ind.unpivot(["entity", "year"], ["docs", "cited"], "indicator", "value")
    return I.top_entities(long, "indicator", "entity", "year", "value")


_EWM = """ord AS (SELECT entity, t, v, row_number() OVER (PARTITION BY entity ORDER BY t) AS k FROM s),
  e AS (SELECT entity, t, k, v AS raw, v AS e3, v AS e5 FROM ord WHERE k = 1 UNION ALL SELECT o.entity, o.t, o.k, o.v, 0.5 * o.v + 0.5 * e.e3, (2.0::DOUBLE / 6) * o.v + (1 - 2.0::DOUBLE / 6) * e.e5 FROM ord o JOIN e ON o.entity = e.entity AND o.k = e.k + 1)"""


@query("ts_smooth", f"WITH RECURSIVE {IND}, s AS (SELECT entity, year AS t, CAST(docs AS DOUBLE) AS v FROM ind), {_EWM} SELECT entity, t AS year, round(raw, 6) AS raw, round(e3, 6) AS ecma3, round(e5, 6) AS ecma5 FROM e")
def ts_smooth(spark, d):
    return S.smoothed(indicator_table(spark, d), ["entity"], "year", "docs")


@query(
    "evolution_profile",
    f"""WITH RECURSIVE {IND}, s AS (SELECT entity, year AS t, CAST(docs AS DOUBLE) AS v FROM ind WHERE entity IN (SELECT entity FROM ind GROUP BY entity HAVING sum(docs) > 0)), {_EWM}
    SELECT t || '_' || entity AS label, round(raw, 6) AS raw, round(e3, 6) AS ecma3, round(e5, 6) AS ecma5, row_number() OVER (ORDER BY t DESC, raw DESC, entity) AS place FROM e""",
)
def evolution_profile(spark, d):
    ind = indicator_table(spark, d)
    alive = ind.groupBy("entity").agg(F.sum("docs").alias("n")).where("n > 0")
    rows = S.smoothed(ind.join(alive.select("entity"), "entity", "left_semi"), ["entity"], "year", "docs")
    ranked = global_rank(rows, F.desc("year"), F.desc("raw"), "entity", name="place")
    return ranked.select(F.concat(F.col("year").cast("string"), F.lit("_"), "entity").alias("label"), "raw", "ecma3", "ecma5", "place")


@query("cma_smooth", f"""WITH {IND}, s AS (SELECT entity, year, CAST(docs AS DOUBLE) AS v, row_number() OVER (PARTITION BY entity ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM ind)
  SELECT a.entity, a.year, round(a.v, 6) AS raw, round(avg(b.v), 6) AS mean FROM s a JOIN s b ON a.entity = b.entity AND abs(a.i - b.i) <= least(2, a.i, a.n - 1 - a.i) GROUP BY a.entity, a.year, a.v""")
def cma_smooth(spark, d):
    return S.moving(indicator_table(spark, d), ["entity"], "year", "docs", 5)


@query("wide_to_long", f"WITH {IND} SELECT entity, year, docs FROM ind WHERE year BETWEEN 1995 AND 1998")
def wide_to_long(spark, d):
    years = ["1995", "1996", "1997", "1998"]
    wide = indicator_table(spark, d).where(F.col("year").between(1995, 1998)).groupBy("entity").pivot("year", years).agg(F.first("docs"))
    return wide.unpivot("entity", years, "year", "docs").where("docs is not null").select("entity", F.col("year").cast("int").alias("year"), "docs")


@query("series_pivot", f"""WITH {IND} SELECT year, coalesce(sum(docs) FILTER (entity = 'CANADA'), 0) AS "CANADA", coalesce(sum(docs) FILTER (entity = 'FRANCE'), 0) AS "FRANCE", coalesce(sum(docs) FILTER (entity = 'PERU'), 0) AS "PERU" FROM ind GROUP BY year""")
def series_pivot(spark, d):
    names = ["CANADA", "FRANCE", "PERU"]
    return indicator_table(spark, d).groupBy("year").pivot("entity", names).agg(F.sum("docs")).na.fill(0, names)


@query("bar_ranking", f"WITH {IND} SELECT entity, docs, row_number() OVER (ORDER BY docs DESC, entity) AS place FROM ind WHERE year = 1997 AND docs > 0")
def bar_ranking(spark, d):
    rows = indicator_table(spark, d).where("year = 1997 and docs > 0").select("entity", "docs")
    return global_rank(rows, F.desc("docs"), "entity", name="place")


@query("entity_limit", f"WITH {IND} SELECT entity, sum(cited) AS cited FROM ind GROUP BY entity ORDER BY cited DESC, entity LIMIT 10")
def entity_limit(spark, d):
    return indicator_table(spark, d).groupBy("entity").agg(F.sum("cited").alias("cited")).orderBy(F.desc("cited"), "entity").limit(10)


@query("unit_order", "SELECT r_name AS unit, row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 999 END, r_name) AS place FROM region")
def unit_order(spark, d):
    return I.prefer(table(spark, d, "region").select(F.col("r_name").alias("unit")), "unit", ["EUROPE", "ASIA"])


@query("zero_row_filter", f"WITH {IND}, w AS (SELECT entity, count(*) FILTER (docs > 30) AS a, count(*) FILTER (docs > 60) AS b FROM ind GROUP BY entity) SELECT * FROM w WHERE a <> 0 OR b <> 0")
def zero_row_filter(spark, d):
    rows = indicator_table(spark, d).groupBy("entity").agg(F.count_if(F.col("docs") > 30).alias("a"), F.count_if(F.col("docs") > 60).alias("b"))
    return I.non_zero(rows, ["a", "b"])


@query("unit_fallback", f"WITH {IND} SELECT entity, year, docs FROM ind WHERE year >= 1998 UNION ALL SELECT entity, year, docs FROM ind i WHERE year = 1997 AND NOT EXISTS (SELECT 1 FROM ind j WHERE j.year >= 1998 AND j.entity = i.entity AND j.docs > 1000000)")
def unit_fallback(spark, d):
    """Rows of the first unit, and those of the second that the first lacks."""
    ind = indicator_table(spark, d).select("entity", "year", "docs").cache()
    return I.fallback(ind.where("year >= 1998"), ind.where("year = 1997"), ["entity", "year"])


@query("event_series", f"""WITH RECURSIVE s AS (SELECT event_type AS entity, CAST(ts AS DATE) AS t, round(sum(value), 6) AS v FROM events GROUP BY ALL), {_EWM} SELECT entity, t AS day, round(raw, 2) AS raw, round(e3, 2) AS ecma3, round(e5, 2) AS ecma5 FROM e""")
def event_series(spark, d):
    daily = table(spark, d, "events").groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 6).alias("v"))
    rows = S.smoothed(daily, ["entity"], "day", "v")
    return rows.select("entity", "day", *(F.round(c, 2).alias(c) for c in ("raw", "ecma3", "ecma5")))


@query("trajectories", """WITH t AS (SELECT run_id, neuron_idx, unnest(mapped_labels) AS label FROM som_neurons), p AS (SELECT DISTINCT run_id || ':' || substr(label, 6) AS entity, CAST(substr(label, 1, 4) AS INTEGER) AS year, neuron_idx FROM t WHERE regexp_matches(label, '^[0-9]{4}_'))
  SELECT entity, list(neuron_idx ORDER BY year, neuron_idx) AS path FROM p GROUP BY entity""")
def trajectories(spark, d):
    t = table(spark, d, "som_neurons").select("run_id", "neuron_idx", F.explode("mapped_labels").alias("label")).where(F.col("label").rlike("^[0-9]{4}_"))
    rows = t.select(F.concat("run_id", F.lit(":"), F.substring("label", F.lit(6), F.length("label"))).alias("entity"), F.substring("label", 1, 4).cast("int").alias("year"), "neuron_idx").distinct()
    return S.paths(rows, "entity", "year", "neuron_idx")
