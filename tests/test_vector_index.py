import numpy as np
import pytest

from quillmap.operators import semantic as S
from quillmap.operators import vector_index as vi


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")


def brute(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {i: np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)].tolist() for i in range(len(x))}


def ids(df):
    return {r.id: [n.id for n in r.near] for r in df.collect()}


CASES = {
    "ties": np.concatenate([np.zeros((1, 24)), np.eye(24)]),
    "copies": np.repeat(np.eye(4, 6), 9, axis=0),
    "far": np.random.default_rng(1).normal(0, 1, (90, 3)) + 1e6,
    "grid": np.stack(np.meshgrid(np.arange(9.0), np.arange(9.0)), -1).reshape(-1, 2),
}


@pytest.mark.parametrize("case", CASES)
def test_ties_copies_and_far_rows(spark, case, monkeypatch):
    """The same rows whatever the tiles, parts and ties; rows at the cut go by id."""
    x = CASES[case]
    assert ids(S.neighbours(frame(spark, x), 5)) == brute(x, 5)
    monkeypatch.setattr(vi, "TILE", 20)
    assert ids(vi.neighbour_lists(frame(spark, x), 5, parts=4)) == brute(x, 5)


def test_small_tables_have_few_neighbours(spark):
    assert ids(vi.neighbour_lists(frame(spark, np.eye(3)), 5)) == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    assert {len(v) for v in ids(vi.neighbour_lists(frame(spark, np.eye(3)[:1]), 5)).values()} <= {0}
    assert vi.neighbour_lists(frame(spark, np.eye(3)).limit(0), 5).count() == 0


def test_parts_grow_with_the_rows():
    assert [vi.parts_for(n) for n in (1, 10_000, 1_000_000, 10**12)] == [1, 1, 500, vi.MOST_SAMPLE // vi.PER_PART]


def test_queries_in_turns_and_tables_removed(spark, monkeypatch):
    """Queries taken in turns give the same lists, of float vectors too; only the lists themselves stay on disk."""
    from pathlib import Path

    from quillmap import runtime

    x = np.random.default_rng(3).normal(0, 1, (400, 6)).astype(np.float32)
    df = frame(spark, x).selectExpr("id", "cast(vec as array<float>) vec")
    runtime.release(spark)
    monkeypatch.setattr(vi, "TURN", 100)
    found = vi.neighbour_lists(df, 5, parts=6)
    assert ids(found) == brute(x.astype(float), 5)
    names = [p.name.split("-")[0] for p in Path(runtime.own_dir(spark).removeprefix("file://")).iterdir()]
    assert sorted(names) == ["found"] * 4 + ["kinds"]
