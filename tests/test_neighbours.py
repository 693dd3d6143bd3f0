from __future__ import annotations

import numpy as np
import pytest

from lensaudit.operators import neighbours
from lensaudit.operators.vectors import knn_distance


def frame(spark, x, ids=None):
    return spark.createDataFrame([(i, v) for i, v in zip(ids or range(len(x)), x.tolist(), strict=True)], f"_i {'string' if ids else 'bigint'}, _v array<double>")


def plain(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) if len(x) <= 700 else np.stack([np.sqrt(((x - row) ** 2).sum(1)) for row in x])
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return order, np.take_along_axis(d, order, 1)


def clustered(n, centres, width=16, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 10, (centres, width))[rng.integers(0, centres, n)] + rng.normal(0, 1, (n, width))


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 64, "CELL": 40}, {"BLOCK": 16, "CELL": 200, "PIVOTS": 3}, {"BLOCK": 50, "PIVOTS": 1}])
@pytest.mark.parametrize("kind", ["clustered", "uniform", "copies", "line"])
def test_nearest_against_all_pairs(spark, monkeypatch, sizes, kind):
    for name, value in sizes.items():
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    x = {"clustered": clustered(500, 12), "uniform": rng.random((500, 5)), "copies": np.repeat(rng.random((25, 4)), 20, axis=0), "line": np.arange(500.0)[:, None] ** 2}[kind]
    k = 5
    got = {r["_i"]: r for r in neighbours.nearest(frame(spark, x), k).collect()}
    order, d = plain(x, k)
    assert len(got) == len(x)
    for i in range(len(x)):
        near = got[i]["near"]
        assert np.allclose([e["d"] for e in near], d[i], rtol=0, atol=1e-9)
        if kind != "copies" and len(set(np.round(d[i], 9))) == k:
            assert [e["i"] for e in near] == order[i].tolist()


def test_fewer_pairs_on_clustered_vectors(spark):
    """50,000 rows in 300 clusters: exact, with less than a fifth of all pairs looked at."""
    x = clustered(50_000, 300)
    got = neighbours.nearest(frame(spark, x).repartition(8), 6).cache()
    some = np.random.default_rng(0).integers(0, len(x), 60)
    kth = {r["_i"]: r["near"][-1]["d"] for r in got.where(got["_i"].isin(some.tolist())).collect()}
    for i in some.tolist():
        assert abs(np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))[5] - kth[i]) < 1e-9
    assert got.agg({"compared": "sum"}).first()[0] < 0.2 * len(x) ** 2
    got.unpersist()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rows = [("a", [0.0, 0.0], 1), ("b", [3.0, 4.0], 1), ("c", [0.0, 1.0], 1), ("d", None, 1), ("e", [1.0], 1), ("f", [float("nan"), 1.0], 1), ("g", [None, 1.0], 1), (None, [9.0, 9.0], 1), ("h", [9.0, 9.0], 1), ("i", [9.0, 8.0], 1)]
    df = spark.createDataFrame(rows, "name string, v array<double>, _cell int")
    got = {r[0]: r[1] for r in knn_distance(df, "name", "v", k=2).collect()}
    assert got == {"a": 1.0, "b": 18**0.5, "c": 1.0, "e": None, "f": None, "g": None, None: 0.0, "h": 0.0, "i": 1.0} or abs(got.pop("b") - 18**0.5) < 1e-12
    assert knn_distance(df.limit(0), "name", "v").collect() == []
    assert [r[1] for r in knn_distance(df.where("name IN ('a', 'b')"), "name", "v", k=6).collect()] == [5.0, 5.0]
