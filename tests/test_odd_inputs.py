"""Ids of any type, names that operators use inside, vectors that aren't sound."""

from __future__ import annotations

import numpy as np
import pytest

from lensaudit.operators import isolation, projection, relational, umap, vectors

CLASHES = "centroid double, _m_0 double, _row string, _key string, _of string, _v string, _i int, _block int, near int, x double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(f"r{i:02d}", "ab"[i % 2], v, float(i)) for i, v in enumerate(rng.normal(size=(24, 3)).tolist())]
    data += [("bad", "a", [1.0, None, 2.0], 1.0), ("nan", "a", [float("nan")] * 3, 2.0), ("short", "a", [1.0], 3.0), ("none", "b", None, 4.0), ("lost", None, [0.0, 1.0, 2.0], 5.0)]
    return spark.createDataFrame([(*r, 1.0, 2.0, "r", "k", "o", "v", 1, 2, 3, 4.0) for r in data], f"name string, label string, v array<double>, m double, {CLASHES}")


@pytest.mark.parametrize("run", [
    lambda df: projection.pca(df, "name", "v"), lambda df: projection.tsne(df, "name", "v"), lambda df: umap.umap(df, "name", "v", k=4, epochs=10), lambda df: vectors.knn_distance(df, "name", "v", k=3),
    lambda df: vectors.centroid_distance(df, "label", "v").select("name", "centroid_distance", "centroid"), lambda df: isolation.isolation_scores(df, "name", ["m"], trees=10),
    lambda df: relational.standardise(df, ["m"]).select("name", "m", "_m_0"), lambda df: relational.membership(df, "name", {"x": df.where("m < 3").select("name"), "_key": df.select("label")}).select("name", "x", "_key"),
], ids=["pca", "tsne", "umap", "knn", "centroid", "forest", "standardise", "membership"])
def test_string_ids_and_clashing_names(rows, run):
    found = run(rows).collect()
    assert {r[0] for r in found} - {"none"} == {r["name"] for r in rows.collect()} - {"none"} and all(isinstance(r[0], str) for r in found)


def test_an_unsound_vector_spoils_no_centroid(rows):
    got = {r["name"]: r["centroid_distance"] for r in vectors.centroid_distance(rows, "label", "v").collect()}
    data = {r["name"]: (r["label"], r["v"]) for r in rows.collect()}
    for name, (label, v) in data.items():
        if not name.startswith("r"):
            assert got[name] is None
            continue
        mean = np.mean([w for n, (other, w) in data.items() if other == label and n.startswith("r")], axis=0)
        assert abs(got[name] - np.linalg.norm(np.array(v) - mean)) < 1e-9


def test_forest_of_rows_without_ids(spark):
    """Rows that share an id, or have none, once fell into the same trees; now each tree still draws about as many rows as it should."""
    df = spark.createDataFrame([(None, float(i)) for i in range(3000)], "id bigint, m double")
    forest = isolation.fit_forest(df, "id", ["m"], trees=20, rows=64)
    assert len(forest) == 20 and all(32 <= t["rows"] <= 64 for t in forest)
