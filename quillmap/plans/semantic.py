"""Relevance, keyword, neighbour, dimension and grouping queries."""

from pyspark.sql import functions as F

from ..operators import relevance as R
from ..operators import semantic as S
from ..operators import som
from ..runtime import table
from .networks import DT, NODES, PAIRS, keywords
from .registry import query

_SCORE = f"""{DT}, {NODES}, {PAIRS}, half AS (SELECT src, dst, count(*) AS c FROM pairs GROUP BY ALL), two AS (SELECT src, dst, c FROM half UNION ALL SELECT dst, src, c FROM half),
  p AS (SELECT src, dst, c / CAST(sum(c) OVER (PARTITION BY src) AS DOUBLE) AS p FROM two), q AS (SELECT term, count / CAST(sum(count) OVER () AS DOUBLE) AS q FROM nodes),
  sc AS (SELECT src AS term, round(sum(p * ln(p / q)), 4) AS score FROM p JOIN q ON q.term = p.dst GROUP BY src), scored AS (SELECT term, count, coalesce(score, 0) AS score FROM nodes LEFT JOIN sc USING (term))"""


@query("relevance_scores", f"WITH {_SCORE} SELECT * FROM scored")
def relevance_scores(spark, d):
    return R.relevance(keywords(spark, d))


@query("relevance_filter", f"WITH {_SCORE}, e AS (SELECT *, row_number() OVER (ORDER BY score DESC, term) AS k, count(*) OVER () AS n FROM scored WHERE count >= 3) SELECT term, count, score FROM e WHERE k <= greatest(1, floor(n * 0.6::DOUBLE))")
def relevance_filter(spark, d):
    return R.select_terms(R.relevance(keywords(spark, d)), 3, 0.6)


_STOP = ", ".join(f"'{w}'" for w in R.TITLE_STOPWORDS)
_TF = f"""src AS (SELECT v.clustering AS grp, v.vec_id AS doc, title FROM intrinsic_vectors v JOIN semantic_records USING (sem_id) WHERE v.clustering IS NOT NULL AND title IS NOT NULL),
  w AS (SELECT grp, doc, [x for x in regexp_extract_all(lower(title), '([a-z0-9_]{{2,}})', 1) if x NOT IN ({_STOP})] AS w FROM src),
  t AS (SELECT grp, doc, unnest(w) AS term FROM w UNION ALL SELECT grp, doc, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w),
  tf AS (SELECT grp, doc, term, count(*) AS tf FROM t GROUP BY ALL), st AS (SELECT grp, term, sum(tf) AS a, count(*) AS df FROM tf GROUP BY ALL),
  kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY a DESC, term) AS f FROM st) WHERE f <= 1000), n AS (SELECT grp, count(*) AS n FROM src GROUP BY grp),
  ww AS (SELECT grp, doc, term, tf * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS w FROM tf JOIN kept USING (grp, term) JOIN n USING (grp)),
  u AS (SELECT grp, term, w / sqrt(sum(w * w) OVER (PARTITION BY grp, doc)) AS w FROM ww), s AS (SELECT grp, term, round(sum(w), 6) AS score FROM u GROUP BY ALL HAVING length(term) > 3)"""


def titled(spark, d):
    v = table(spark, d, "intrinsic_vectors").select("vec_id", "sem_id", F.col("clustering").alias("grp"))
    return v.join(table(spark, d, "semantic_records").select("sem_id", "title"), "sem_id")


@query("tfidf_keywords", f"WITH {_TF} SELECT grp, term, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 20")
def tfidf_keywords(spark, d):
    return R.group_keywords(titled(spark, d), "grp", "vec_id", "title")


@query("topic_labels")
def topic_labels(spark, d):
    return R.labels(tfidf_keywords(spark, d), "grp")


OKV = "intrinsic_data IS NOT NULL AND len(intrinsic_data) = 24 AND len([v for v in intrinsic_data if v IS NULL OR isnan(v)]) = 0"
VEC = f"vecs AS (SELECT vec_id AS id, [CAST(v AS DOUBLE) for v in intrinsic_data] AS v, clustering AS grp FROM intrinsic_vectors WHERE {OKV})"
KNN = f"""{VEC}, u AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs), dist AS (SELECT a.id, b.id AS other, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM u a JOIN u b ON a.i = b.i AND a.id <> b.id GROUP BY ALL),
  near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS k FROM dist) WHERE k <= 20)"""


def vectors(spark, d):
    return som.clean(table(spark, d, "intrinsic_vectors"), "vec_id", "intrinsic_data", 24)


@query("knn", f"WITH {KNN} SELECT id, other, round(d, 6) AS d FROM near WHERE k <= 10")
def knn(spark, d):
    near = S.neighbours(vectors(spark, d), 10)
    return near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"), F.round("n.d", 6).alias("d"))


_MLE = f"""{KNN}, pos AS (SELECT id, d, max(d) OVER (PARTITION BY id) AS t, row_number() OVER (PARTITION BY id ORDER BY k) AS r, count(*) OVER (PARTITION BY id) AS n FROM near WHERE d > 0),
  mle AS (SELECT id, 1 / nullif(avg(ln(t / d)), 0) AS dim FROM pos WHERE r < n GROUP BY id)"""


@query("mle_dimension", f"WITH {_MLE} SELECT round(avg(dim), 4) AS mean, round(quantile_cont(dim, 0.5), 4) AS p50, round(quantile_cont(dim, 0.9), 4) AS p90, round(quantile_cont(dim, 0.95), 4) AS p95, round(max(dim), 4) AS high FROM mle WHERE dim IS NOT NULL")
def mle_dimension(spark, d):
    return S.percentiles(S.local_mle(S.neighbours(vectors(spark, d), 20)))


@query("two_nn", f"WITH {KNN}, r AS (SELECT id, max(d) FILTER (k = 1) AS r1, max(d) FILTER (k = 2) AS r2 FROM near GROUP BY id) SELECT 'TwoNN' AS estimator, round(count(*) / sum(ln(r2 / r1)), 4) AS dim FROM r WHERE r1 > 0")
def two_nn(spark, d):
    return S.dimensions(S.neighbours(vectors(spark, d), 20)).where("estimator = 'TwoNN'")


@query("dimension_estimates")
def dimension_estimates(spark, d):
    data = vectors(spark, d)
    return S.dimensions(S.neighbours(data, 20)).union(S.global_pca(data))


@query("linear_reduction")
def linear_reduction(spark, d):
    return S.reduce_linear(vectors(spark, d), 2)


@query("manifold_layout")
def manifold_layout(spark, d):
    data = vectors(spark, d)
    return S.manifold(data, S.neighbours(data, 15), epochs=60)


@query("density_clusters")
def density_clusters(spark, d):
    return S.density_clusters(vectors(spark, d), 10)


@query("sub_clusters")
def sub_clusters(spark, d):
    n = table(spark, d, "som_neurons").where("clustering is not null")
    return S.sub_clusters(n.select(F.col("clustering").alias("grp"), F.col("neuron_id").alias("id"), F.col("hex_x").alias("x"), F.col("hex_y").alias("y")), "grp")


@query("cluster_medians", "SELECT clustering AS grp, round(quantile_cont(hex_x, 0.5), 6) AS x, round(quantile_cont(hex_y, 0.5), 6) AS y FROM som_neurons WHERE clustering IS NOT NULL GROUP BY 1")
def cluster_medians(spark, d):
    return S.medians(table(spark, d, "som_neurons").select(F.col("clustering").alias("grp"), F.col("hex_x").alias("x"), F.col("hex_y").alias("y")), "grp")


@query("centroid_titles", f"""WITH {VEC}, u AS (SELECT id, grp, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs WHERE grp IS NOT NULL), c AS (SELECT grp, i, avg(x) AS m FROM u GROUP BY ALL),
  s AS (SELECT u.grp, u.id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 6) AS cosine FROM u JOIN c ON u.grp = c.grp AND u.i = c.i GROUP BY ALL)
  SELECT grp, id, cosine, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cosine DESC, id) AS rank FROM s) WHERE rank <= 10""")
def centroid_titles(spark, d):
    v = table(spark, d, "intrinsic_vectors").select(F.col("vec_id").alias("id"), F.col("clustering").alias("grp")).where("grp is not null")
    return S.nearest_titles(vectors(spark, d).join(v, "id"), "grp")


@query("embed_titles")
def embed_titles(spark, d):
    return S.embed_texts(table(spark, d, "semantic_records"), "sem_id", "title")
