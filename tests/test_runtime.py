"""Ranks, group statistics, tables in the shared folder, saved runs, network JSON, entry points."""

import json

import pytest
from pyspark.sql import functions as F

from quillmap import runtime as rt


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7 % 100).alias("v"), "id").repartition(7)
    rows = rt.global_rank(df, F.desc("v"), "id").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [*range(1, 501)]
    assert [(r.v, r.id) for r in rows] == sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert rt.global_rank(df.limit(0), "v").count() == 0


def test_group_and_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 5), (None, 6), ("b", None)], "k string, v int")
    got = {(r.k, r.v): (r.s, r.n) for r in rt.with_total(rt.with_group(df, ["k"], s=F.sum("v")), n=F.count(F.lit(1))).collect()}
    assert got == {("a", 1): (3, 5), ("a", 2): (3, 5), (None, 5): (11, 5), (None, 6): (11, 5), ("b", None): (None, 5)}


def test_materialize_and_bounds(spark):
    df = spark.createDataFrame([(1, ["x", None], {"a": 1.5})], "i long, l array<string>, m map<string,double>")
    assert rt.materialize(df).collect() == df.collect() and rt.materialize(df.limit(0)).schema == df.schema
    assert rt.rows_bounded(df, 1) and not rt.rows_bounded(df.union(df), 1)
    assert rt.spread(spark.range(10)).count() == 10


def test_runs_and_network_json(spark, tmp_path):
    from quillmap.sources import runs, sinks, works

    df = spark.createDataFrame([(1, 0.5)], "i int, v double")
    runs.save_run(str(tmp_path), "r1", {"neurons": df}, {"rows": 2})
    assert runs.load_run(spark, str(tmp_path), "r1", "neurons").collect() == df.collect()
    assert json.loads(runs.list_runs(spark, str(tmp_path)).first().config) == {"rows": 2}
    with pytest.raises(Exception):
        runs.save_run(str(tmp_path), "r1", {"neurons": df})
    items = spark.createDataFrame([(1, "A", 0.0, 0.0, 1, {"Occurrences": 2.0}, {"s": 1.0})], "id long, label string, x double, y double, cluster int, weights map<string,double>, scores map<string,double>")
    links = spark.createDataFrame([(1, 1, 3.0)], "source_id long, target_id long, strength double")
    text = sinks.network_json(items, links)
    back = works.network_items(text, "json").first()
    assert (back.id, back.label, back["count"]) == (1, "A", 2.0) and works.network_links(text, "json").first().weight == 3.0
    wide = sinks.wide(spark.createDataFrame([("r", "a", 1.0)], "row string, col string, value double"), "row", "col", "value", ["a", "b"]).first()
    assert (wide.a, wide.b) == (1.0, 0.0)


def test_entry_points():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and "p1_found" in q and len(s) > 100
