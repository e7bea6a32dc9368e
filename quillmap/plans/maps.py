"""Map queries over som_neurons: each run_id is a trained map of few neurons."""

from pyspark.sql import functions as F

from ..operators import som
from ..runtime import table
from .registry import query

DIM = 12
OK = "weights IS NOT NULL AND len(weights) = 12 AND len([v for v in weights if v IS NULL OR isnan(v)]) = 0"
NEU = f"neu AS (SELECT run_id AS run, neuron_idx AS idx, row_idx AS row, col_idx AS col, hex_x AS x, hex_y AS y, weights AS w, clustering AS cluster, frequency, mapped_labels AS labels, neuron_id FROM som_neurons WHERE {OK})"
ONE = "one AS (SELECT * FROM neu WHERE run = (SELECT min(run) FROM neu))"
L2 = "sqrt(list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) for i in range(1, 13)]))"


def neurons(spark, d):
    v = F.col("weights")
    ok = v.isNotNull() & (F.size(v) == DIM) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    c = F.col
    return table(spark, d, "som_neurons").where(ok).select(c("run_id").alias("run"), c("neuron_idx").alias("idx"), c("row_idx").alias("row"), c("col_idx").alias("col"), c("hex_x").alias("x"), c("hex_y").alias("y"), v.alias("w"), c("clustering").alias("cluster"), "frequency", c("mapped_labels").alias("labels"), "neuron_id")


def one_run(spark, d):
    n = neurons(spark, d)
    first = n.agg(F.min("run").alias("run"))
    return n.join(F.broadcast(first), "run", "left_semi")


def weights_of(spark, d):
    """Weights of the first run in the order of idx (a map is bounded)."""
    import numpy as np

    rows = one_run(spark, d).select("idx", "w").orderBy("idx").collect()
    return [r["idx"] for r in rows], np.array([r["w"] for r in rows])


def assigned(spark, d, metric="euclidean"):
    ids, w = weights_of(spark, d)
    found = som.assign(som.clean(table(spark, d, "som_neurons"), "neuron_id", "weights", DIM), w, metric)
    names = spark.createDataFrame(list(enumerate(ids)), "bmu int, idx int")
    return found.join(F.broadcast(names), "bmu").select("id", F.col("idx").alias("bmu"), "distance")


@query("hex_grid", "SELECT CAST(i AS INTEGER) AS idx, CAST(i // 7 AS INTEGER) AS row, CAST(i % 7 AS INTEGER) AS col, round(1.5 * (i % 7), 6)::DOUBLE AS x, round(sqrt(3.0::DOUBLE) * (i // 7) + CASE WHEN (i % 7) % 2 = 1 THEN sqrt(3.0::DOUBLE) / 2 ELSE 0 END, 6) AS y FROM range(35) r(i)")
def hex_grid(spark, d):
    return som.hex_grid(spark, 5, 7)


def _bmu_sql(distance: str) -> str:
    return f"{NEU}, {ONE}, a AS (SELECT s.neuron_id AS id, o.idx AS bmu, {distance} AS distance FROM neu s CROSS JOIN one o), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, bmu) AS k FROM a), asg AS (SELECT id, bmu, distance FROM r WHERE k = 1)"


BMU = _bmu_sql(L2.format(a="s.w", b="o.w"))


@query("bmu_assign", f"WITH {BMU} SELECT id, bmu, round(distance, 6) AS distance FROM asg")
def bmu_assign(spark, d):
    return assigned(spark, d).select("id", "bmu", F.round("distance", 6).alias("distance"))


@query("bmu_manhattan", f"WITH {_bmu_sql('list_sum([abs(s.w[i] - o.w[i]) for i in range(1, 13)])')} SELECT id, bmu, round(distance, 6) AS distance FROM asg")
def bmu_manhattan(spark, d):
    return assigned(spark, d, "manhattan").select("id", "bmu", F.round("distance", 6).alias("distance"))


@query("bmu_canberra", f"WITH {_bmu_sql('list_sum([abs(s.w[i] - o.w[i]) / (abs(s.w[i]) + abs(o.w[i]) + 1e-15) for i in range(1, 13)])')} SELECT id, bmu, round(distance, 6) AS distance FROM asg")
def bmu_canberra(spark, d):
    return assigned(spark, d, "canberra").select("id", "bmu", F.round("distance", 6).alias("distance"))


@query("bmu_hits", f"WITH {BMU}, g AS (SELECT bmu AS idx, count(*) AS n, avg(distance) AS e FROM asg GROUP BY bmu), f AS (SELECT idx, coalesce(n, 0) AS n, coalesce(e, 0) AS e FROM one LEFT JOIN g USING (idx)) SELECT idx, round(n / CAST(max(n) OVER () AS DOUBLE), 6) AS frequency, round(coalesce(e / nullif(max(e) OVER (), 0), 0), 6) AS error FROM f")
def bmu_hits(spark, d):
    return som.hits(assigned(spark, d), one_run(spark, d))


@query("som_epoch", f"""WITH {BMU}, s AS (SELECT a.bmu AS idx, i.i AS pos, sum(n.w[i.i]) AS s, count(*) AS c FROM asg a JOIN neu n ON n.neuron_id = a.id CROSS JOIN range(1, 13) i(i) GROUP BY ALL),
  h AS (SELECT p.idx AS j, q.idx AS k, exp(-(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) / (2 * 2.0 * 2.0)) AS h FROM one p CROSS JOIN one q)
  SELECT h.j AS idx, CAST(s.pos - 1 AS INTEGER) AS pos, round(sum(h * s) / sum(h * c), 6) AS v FROM h JOIN s ON s.idx = h.k GROUP BY h.j, s.pos""")
def som_epoch(spark, d):
    """One batch epoch from fixed weights at a neighbourhood of 2."""
    import numpy as np

    from ..functions import som_math as m

    rows = one_run(spark, d).select("idx", "x", "y", "w").orderBy("idx").collect()
    w, pos = np.array([r["w"] for r in rows]), np.array([[r["x"], r["y"]] for r in rows])
    s, c, _ = som.epoch_sums(som.clean(table(spark, d, "som_neurons"), "neuron_id", "weights", DIM), w)
    new = m.batch_update(w, s, c, m.kernel(pos, 2.0))
    out = [(r["idx"], j, round(float(new[i, j]), 6)) for i, r in enumerate(rows) for j in range(DIM)]
    return spark.createDataFrame(out, "idx int, pos int, v double")


@query("umatrix", f"WITH {NEU} SELECT a.run, a.idx, round(coalesce(avg({L2.format(a='a.w', b='b.w')}) FILTER (b.idx IS NOT NULL), 0), 6) AS u FROM neu a LEFT JOIN neu b ON a.run = b.run AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) > 0 AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) < 1.85 GROUP BY a.run, a.idx")
def umatrix(spark, d):
    return som.umatrix(neurons(spark, d), "run")


@query("cluster_borders", f"""WITH {NEU}, o(parity, side, dr, dc) AS (VALUES (0,0,-1,0),(0,1,-1,1),(0,2,0,1),(0,3,1,0),(0,4,0,-1),(0,5,-1,-1),(1,0,-1,0),(1,1,0,1),(1,2,1,1),(1,3,1,0),(1,4,1,-1),(1,5,0,-1))
  SELECT a.run, a.idx, o.side, b.idx IS NULL AS outside FROM neu a JOIN o ON o.parity = a.col % 2 LEFT JOIN neu b ON b.run = a.run AND b.row = a.row + o.dr AND b.col = a.col + o.dc WHERE b.idx IS NULL OR a.cluster IS DISTINCT FROM b.cluster""")
def cluster_borders(spark, d):
    return som.borders(neurons(spark, d), "run")


CEN = f"{NEU}, cw AS (SELECT run, cluster, idx, labels, x, y, w, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS pos FROM neu WHERE cluster IS NOT NULL), cen AS (SELECT run, cluster, pos, round(avg(v), 6) AS mean FROM cw GROUP BY ALL), vec AS (SELECT run, cluster, list(mean ORDER BY pos) AS centre FROM cen GROUP BY ALL)"


@query("cluster_centroids", f"WITH {CEN} SELECT run, cluster, CAST(pos AS INTEGER) AS pos, mean FROM cen")
def cluster_centroids(spark, d):
    return som.centroids(neurons(spark, d), "run")


@query("nearest_entities", f"""WITH {CEN}, l AS (SELECT run, cluster, w, unnest(labels) AS label FROM neu WHERE cluster IS NOT NULL), e AS (SELECT run, cluster, label, min(round({L2.format(a='w', b='centre')}, 6)) AS distance FROM l JOIN vec USING (run, cluster) GROUP BY ALL)
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run, cluster ORDER BY distance, label) AS INTEGER) AS rank FROM e) WHERE rank <= 10""")
def nearest_entities(spark, d):
    return som.nearest_entities(neurons(spark, d), "labels", 10, "run")


@query("cluster_summary", f"WITH {CEN} SELECT run, cluster, CAST(pos AS INTEGER) AS pos, mean, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run, cluster ORDER BY mean DESC, pos) AS rank FROM cen) WHERE rank <= 6")
def cluster_summary(spark, d):
    return som.summary(neurons(spark, d), 6, "run")


@query("visual_centre", f"""WITH {NEU}, q AS (SELECT run, cluster, idx, round(pow(x - avg(x) OVER p, 2) + pow(y - avg(y) OVER p, 2), 6) AS d2 FROM neu WHERE cluster IS NOT NULL WINDOW p AS (PARTITION BY run, cluster))
  SELECT run, cluster, idx FROM (SELECT *, row_number() OVER (PARTITION BY run, cluster ORDER BY d2, idx) AS k FROM q) WHERE k = 1""")
def visual_centre(spark, d):
    return som.visual_centre(neurons(spark, d), "run")


@query("component_stats", f"WITH {NEU}, u AS (SELECT run, unnest(w) AS v, generate_subscripts(w, 1) - 1 AS pos FROM neu) SELECT run, CAST(pos AS INTEGER) AS pos, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM u GROUP BY ALL")
def component_stats(spark, d):
    return som.component_stats(neurons(spark, d), "run")


@query("neuron_labels", f"WITH {BMU}, l AS (SELECT neuron_id AS id, unnest(mapped_labels) AS label FROM som_neurons) SELECT bmu, list(label ORDER BY label) AS labels FROM asg JOIN l USING (id) GROUP BY bmu")
def neuron_labels(spark, d):
    labels = table(spark, d, "som_neurons").select(F.col("neuron_id").alias("id"), F.explode("mapped_labels").alias("label"))
    return som.neuron_labels(assigned(spark, d), labels)


@query("clustered_rows", f"WITH {BMU} SELECT id, bmu, o.cluster FROM asg JOIN one o ON o.idx = asg.bmu")
def clustered_rows(spark, d):
    return som.row_clusters(assigned(spark, d), one_run(spark, d))


@query("mapped_entities", f"WITH {NEU}, l AS (SELECT DISTINCT run, cluster, unnest(labels) AS label FROM neu WHERE cluster IS NOT NULL), f AS (SELECT DISTINCT run, cluster, unnest(labels) AS label FROM neu WHERE cluster IS NOT NULL AND frequency > 2) SELECT l.run, l.cluster, l.label, f.label IS NOT NULL AS mapped FROM l LEFT JOIN f USING (run, cluster, label)")
def mapped_entities(spark, d):
    """Labels of a cluster, and whether a frequent neuron bears them (intersect and except in one join)."""
    n = neurons(spark, d).where("cluster is not null")
    all_ = n.select("run", "cluster", F.explode("labels").alias("label")).distinct()
    often = n.where("frequency > 2").select("run", "cluster", F.explode("labels").alias("label")).distinct().withColumn("mapped", F.lit(True))
    return all_.join(often, ["run", "cluster", "label"], "left").select("run", "cluster", "label", F.coalesce("mapped", F.lit(False)).alias("mapped"))


@query("move_label", f"WITH {NEU}, {ONE} SELECT idx, CASE WHEN idx = 0 THEN [l for l in labels if l <> '2019_Austria'] WHEN idx = 3 AND NOT list_contains(labels, '2019_Austria') THEN list_append(labels, '2019_Austria') ELSE labels END AS labels FROM one")
def move_label(spark, d):
    return som.move_label(one_run(spark, d).select("idx", "labels"), "labels", "2019_Austria", 0, 3)


@query("reference_vectors", f"WITH {NEU} SELECT run, idx, array_to_string([printf('%.6f', v) for v in w], ';') AS line FROM neu")
def reference_vectors(spark, d):
    from ..sources.sinks import joined_lines

    return joined_lines(neurons(spark, d).select("run", "idx", "w"), "w").select("run", "idx", "line")


@query("cluster_metrics", f"""WITH {NEU}, u AS (SELECT run, cluster, unnest(w) AS v, generate_subscripts(w, 1) AS pos FROM neu WHERE cluster IS NOT NULL), c AS (SELECT run, cluster, pos, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS q FROM u GROUP BY ALL),
  t AS (SELECT run, pos, avg(v) AS m FROM u GROUP BY ALL), g AS (SELECT run, sum(q) AS w, sum(n * pow(c.m - t.m, 2)) AS b, count(DISTINCT cluster) AS k, (SELECT count(*) FROM neu x WHERE x.run = c.run AND cluster IS NOT NULL) AS n FROM c JOIN t USING (run, pos) GROUP BY run)
  SELECT run, k, round((b / nullif(k - 1, 0)) / nullif(w / nullif(n - k, 0), 0), 3) AS calinski_harabasz FROM g""")
def cluster_metrics(spark, d):
    return som.scores_of(neurons(spark, d), "run")


@query("ward_clusters")
def ward_clusters(spark, d):
    return som.cluster_runs(neurons(spark, d), "run", "ward", 4)


@query("dbscan_clusters")
def dbscan_clusters(spark, d):
    return som.cluster_runs(neurons(spark, d), "run", "dbscan", eps=1.5, least=3)


@query("evaluate_clusters")
def evaluate_clusters(spark, d):
    return som.evaluate(neurons(spark, d), "run", 10)


@query("som_train")
def som_train(spark, d):
    """An 8 x 8 map of the intrinsic vectors after 10 epochs."""
    data = som.clean(table(spark, d, "intrinsic_vectors"), "vec_id", "intrinsic_data", 24)
    w, _ = som.train_batch(data, 8, 8, 10)
    return som.neurons_frame(spark, w, 8, 8)


@query("som_errors")
def som_errors(spark, d):
    data = som.clean(table(spark, d, "intrinsic_vectors"), "vec_id", "intrinsic_data", 24)
    _, errors = som.train_batch(data, 6, 6, 8)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(errors)], "epoch int, error double")


@query("map_size")
def map_size(spark, d):
    rows, cols = som.map_size(som.clean(table(spark, d, "intrinsic_vectors"), "vec_id", "intrinsic_data", 24))
    return spark.createDataFrame([(rows, cols)], "rows int, cols int")
