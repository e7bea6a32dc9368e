"""Normalisation, scaling and box queries: nation by order priority as a matrix, keywords as a co-occurrence matrix."""

from pyspark.sql import functions as F

from ..operators import matrices as M
from ..operators import network as N
from ..runtime import table
from .networks import DT, FULL, NODES, PAIRS, TOP, keywords
from .registry import query

MAT = """mat AS (SELECT n_name AS row, o_orderpriority AS feature, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
COOC = f"""{DT}, {NODES}, {PAIRS}, {FULL}, {TOP.format(n=30)}, e AS (SELECT * FROM edges WHERE src IN (SELECT term FROM top) AND dst IN (SELECT term FROM top)),
  adj AS (SELECT src AS row, dst AS feature, weight AS value FROM e UNION ALL SELECT dst, src, weight FROM e UNION ALL SELECT term, term, CAST(count AS DOUBLE) FROM top),
  d AS (SELECT a.row, a.feature, a.value, i.value AS di, j.value AS dj FROM adj a LEFT JOIN adj i ON i.row = a.row AND i.feature = a.row LEFT JOIN adj j ON j.row = a.feature AND j.feature = a.feature)"""


def matrix(spark, d):
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("n_name").alias("row"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))


def cooc_matrix(spark, d):
    docs = keywords(spark, d).cache()
    top = N.top_nodes(N.node_counts(docs), 30)
    return N.adjacency(N.induced(N.cooccurrence(docs), top), top).withColumnRenamed("col", "feature")


_W = "OVER (PARTITION BY feature)"


@query("norm_div_max", f"WITH {MAT}, m AS (SELECT *, CASE WHEN max(value) {_W} = 0 THEN 1 ELSE max(value) {_W} END AS p1 FROM mat) SELECT row, feature, round(value / p1, 6) AS value, p1 FROM m")
def norm_div_max(spark, d):
    return M.normalize(matrix(spark, d), "div_max")


@query(
    "norm_by_year",
    """WITH mat AS (SELECT year(o_orderdate) AS year, n_name AS row, o_orderpriority AS feature, CAST(count(*) AS DOUBLE) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    m AS (SELECT *, max(value) OVER (PARTITION BY year, feature) AS p1 FROM mat) SELECT year || '_' || row AS label, feature, round(value / p1, 6) AS value FROM m""",
)
def norm_by_year(spark, d):
    """The stack of yearly matrices, each normalised by itself, with year_entity labels."""
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("year"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy("year", F.col("n_name").alias("row"), F.col("o_orderpriority").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return M.normalize(cells, "div_max", "year").select(F.concat(F.col("year").cast("string"), F.lit("_"), "row").alias("label"), "feature", "value")


@query("norm_min_max", f"WITH {MAT}, m AS (SELECT *, min(value) {_W} AS p1, max(value) {_W} - min(value) {_W} AS r FROM mat) SELECT row, feature, round((value - p1) / CASE WHEN r = 0 THEN 1 ELSE r END, 6) AS value, p1, CASE WHEN r = 0 THEN 1 ELSE r END AS p2 FROM m")
def norm_min_max(spark, d):
    return M.normalize(matrix(spark, d), "min_max")


@query("norm_z_score", f"WITH {MAT}, m AS (SELECT *, avg(value) {_W} AS a, round(stddev_pop(value) {_W}, 9) AS s FROM mat) SELECT row, feature, round((value - a) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS value, round(a, 6) AS p1, round(CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS p2 FROM m")
def norm_z_score(spark, d):
    return M.normalize(matrix(spark, d), "z_score")


@query("norm_revert", f"WITH {MAT} SELECT row, feature, value FROM mat")
def norm_revert(spark, d):
    """Back from a z-score: the matrix itself."""
    return M.revert(M.normalize(matrix(spark, d), "z_score"), "z_score").withColumn("value", F.round("value", 0))


def _sql_cooc(denominator: str) -> str:
    return f"WITH {COOC} SELECT row, feature, round(CASE WHEN row = feature THEN 1.0 ELSE coalesce(value / nullif({denominator}, 0), 0) END, 6) AS value FROM d"


@query("norm_cooc_cosine", _sql_cooc("sqrt(di * dj)"))
def norm_cooc_cosine(spark, d):
    return M.normalize(cooc_matrix(spark, d), "cooc_cosine")


@query("norm_cooc_association", _sql_cooc("di * dj"))
def norm_cooc_association(spark, d):
    return M.normalize(cooc_matrix(spark, d), "cooc_association")


@query("norm_cooc_jaccard", _sql_cooc("di + dj - value"))
def norm_cooc_jaccard(spark, d):
    return M.normalize(cooc_matrix(spark, d), "cooc_jaccard")


@query("norm_cooc_inclusion", _sql_cooc("least(di, dj)"))
def norm_cooc_inclusion(spark, d):
    return M.normalize(cooc_matrix(spark, d), "cooc_inclusion")


@query("norm_bipartite_row", f"WITH {MAT} SELECT row, feature, round(value / nullif(sum(value) OVER (PARTITION BY row), 0), 6) AS value FROM mat")
def norm_bipartite_row(spark, d):
    return M.normalize(matrix(spark, d), "bipartite_row")


@query("norm_bipartite_col", f"WITH {MAT} SELECT row, feature, round(value / nullif(sum(value) {_W}, 0), 6) AS value FROM mat")
def norm_bipartite_col(spark, d):
    return M.normalize(matrix(spark, d), "bipartite_col")


@query("norm_bipartite_sym", f"WITH {MAT} SELECT row, feature, round(value / sqrt(sum(value) OVER (PARTITION BY row) * sum(value) {_W}), 6) AS value FROM mat")
def norm_bipartite_sym(spark, d):
    return M.normalize(matrix(spark, d), "bipartite_sym")


@query("radar_scale", f"WITH {MAT} SELECT row, feature, CAST(floor(value / max(value) {_W} * 100 + 0.5) AS DOUBLE) AS value FROM mat")
def radar_scale(spark, d):
    return M.radar(matrix(spark, d))


@query("heatmap_scale", f"WITH {MAT} SELECT feature, min(value) AS low, CASE WHEN max(value) = min(value) THEN min(value) + 1 ELSE max(value) END AS high FROM mat GROUP BY feature")
def heatmap_scale(spark, d):
    return M.heat(matrix(spark, d))


@query("bubble_radius", "SELECT n_name AS entity, count(*) AS n, round(6 + sqrt(count(*) / CAST(max(count(*)) OVER () AS DOUBLE)) * 20, 6) AS radius FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def bubble_radius(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    return M.bubble(rows, "n")


@query("box_plot", """WITH r AS (SELECT o_orderpriority AS key, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
  SELECT key, min(v) AS low, max(v) FILTER (k = floor(n * 0.25)) AS q1, max(v) FILTER (k = floor(n * 0.5)) AS median, max(v) FILTER (k = floor(n * 0.75)) AS q3, max(v) AS high FROM r GROUP BY key""")
def box_plot(spark, d):
    return M.box(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "key"), "key", "o_totalprice")


@query("color_clip", "WITH r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events WHERE value IS NOT NULL) SELECT max(v) FILTER (k = floor(n * 0.02)) AS low, max(v) FILTER (k = floor(n * 0.98)) AS high FROM r")
def color_clip(spark, d):
    return M.clip_bounds(table(spark, d, "events"), "value")


@query("label_tiers", "WITH s AS (SELECT source_title AS name, count(*) AS n FROM scopus_records WHERE source_title IS NOT NULL GROUP BY 1), k AS (SELECT name, row_number() OVER (ORDER BY n DESC, name) AS k FROM s) SELECT name, CASE WHEN k <= 16 THEN 1 WHEN k <= 46 THEN 2 WHEN k <= 101 THEN 3 ELSE 4 END AS tier FROM k")
def label_tiers(spark, d):
    sizes = table(spark, d, "scopus_records").where("source_title is not null").groupBy(F.col("source_title").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return M.tiers(sizes, "name", "n")


@query("finite_filter", "SELECT neuron_id, quantization_error FROM som_neurons WHERE quantization_error IS NOT NULL AND NOT isnan(quantization_error) AND NOT isinf(quantization_error)")
def finite_filter(spark, d):
    q = F.col("quantization_error")
    return table(spark, d, "som_neurons").where(q.isNotNull() & ~F.isnan(q) & (F.abs(q) != float("inf"))).select("neuron_id", "quantization_error")


@query("splat_grid", """WITH p AS (SELECT hex_x AS x, hex_y AS y, CAST(frequency AS DOUBLE) AS v FROM som_neurons WHERE hex_x IS NOT NULL AND hex_y IS NOT NULL AND frequency IS NOT NULL),
  c AS (SELECT x, y, v, unnest(range(greatest(CAST(floor(x) AS INTEGER) - 5, 0), least(CAST(floor(x) AS INTEGER) + 5, 23) + 1)) AS px FROM p), g AS (SELECT x, y, v, px, unnest(range(greatest(CAST(floor(y) AS INTEGER) - 5, 0), least(CAST(floor(y) AS INTEGER) + 5, 23) + 1)) AS py FROM c),
  w AS (SELECT px, py, v, exp(-(pow(px - x, 2) + pow(py - y, 2)) / (2 * 1.5 * 1.5)) AS w FROM g WHERE pow(px - x, 2) + pow(py - y, 2) <= 9 * 1.5 * 1.5)
  SELECT CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, round(sum(w), 4) AS density, round(sum(w * v) / sum(w), 4) AS mean FROM w GROUP BY ALL""")
def splat_grid(spark, d):
    return M.splat(table(spark, d, "som_neurons").withColumn("v", F.col("frequency").cast("double")), "hex_x", "hex_y", "v", 24, 24, 1.5)


@query("map_bounds", """WITH b AS (SELECT *, min(hex_x) OVER () AS lx, min(hex_y) OVER () AS ly, greatest(max(hex_x) OVER () - min(hex_x) OVER (), max(hex_y) OVER () - min(hex_y) OVER ()) AS s FROM som_neurons) SELECT neuron_id, round((hex_x - lx) / s, 6) AS hex_x, round((hex_y - ly) / s, 6) AS hex_y FROM b""")
def map_bounds(spark, d):
    return M.bounds(table(spark, d, "som_neurons").select("neuron_id", "hex_x", "hex_y"), "hex_x", "hex_y").select("neuron_id", "hex_x", "hex_y")


@query("numeric_coercion", "SELECT rec_id, TRY_CAST(trim(regexp_replace(cited_by, '[,%]', '', 'g')) AS DOUBLE) AS cited_by, source_title FROM scopus_records WHERE cited_by IS NOT NULL OR source_title IS NOT NULL OR rec_id IS NOT NULL")
def numeric_coercion(spark, d):
    rows = table(spark, d, "scopus_records").select("rec_id", "cited_by", "source_title").withColumn("empty", F.lit(None).cast("string"))
    return M.coerce_numbers(M.drop_empty(rows), ["cited_by", "source_title"])
