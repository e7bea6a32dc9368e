from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from quillmap.llm import cooccurrence as co


def brute(records, least, lift):
    n, one, two = 0, Counter(), Counter()
    for r in records:
        s = sorted({" ".join(x.lower().split()) for x in r or [] if x is not None} - {""})
        n += bool(s)
        one.update(s)
        two.update(combinations(s, 2))
    return {p: (k, one[p[0]], one[p[1]], n) for p, k in two.items() if k >= least and k * n >= lift * one[p[0]] * one[p[1]]}


@pytest.mark.parametrize("lift", [0.0, 3.0])
def test_against_brute_force(spark, lift):
    rng = np.random.default_rng(1)
    records = [[f"T{int(t)} x" for t in rng.zipf(1.3, rng.integers(0, 9)) % 60] + (["hot"] if rng.random() < 0.4 else []) for _ in range(600)]
    records += [None, [], [None, " "], ["T1  X ", "t1 x"]] + [records[3]] * 3
    df = spark.createDataFrame([(i, r, 1, "q") for i, r in enumerate(records)], "k long, items array<string>, rec int, item string")
    got = {(r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in co.cooccurrence(co.record_items(df, "k", "items"), 4, lift).collect()}
    assert got == brute(records, 4, lift) and len(got) > 10


def test_long_record_and_empty(spark):
    long = [f"i{i:04d}" for i in range(1300)]
    df = spark.createDataFrame([(1, long), (2, long)], "k long, items array<string>")
    ids = co.record_items(df, "k", "items").selectExpr("transform(items, x -> cast(substr(x, 2) as long)) as ids")
    got = co.pair_counts(ids)
    assert got.count() == 1300 * 1299 // 2 and got.where("n <> 2").count() == 0
    assert co.cooccurrence(co.record_items(df.limit(0), "k", "items")).count() == 0


def test_odds_ratio(spark):
    df = spark.createDataFrame([(i, ["a", "b"] if i < 5 else ["c"]) for i in range(60)], "k long, items array<string>")
    r = co.cooccurrence(co.record_items(df, "k", "items")).first()
    assert (r.item_a, r.item_b, r.n_ab, r.lift) == ("a", "b", 5, 12.0) and r.odds_ratio == round(5.5 * 55.5 / (0.5 * 0.5), 6)
