from __future__ import annotations

import math

import numpy as np
import pytest

from lensaudit.operators import umap as module
from lensaudit.operators.umap import descend, fuzzy_graph, umap

from .test_neighbours import clustered, plain


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id bigint, v array<double>")


def plain_graph(x, k):
    """One row and one edge at a time."""
    order, d = plain(x, k + 1)
    p = {}
    for i in range(len(x)):
        near = [(dist, j) for dist, j in zip(d[i].tolist(), order[i].tolist(), strict=True) if j != i]
        rho = min((dist for dist, _ in near if dist > 0), default=0)
        low, high, sigma = 0.0, math.inf, 1.0
        for _ in range(64):
            if sum(math.exp(-max(dist - rho, 0) / sigma) for dist, _ in near) > math.log2(len(near) + 1):
                high = sigma
                sigma = (low + high) / 2
            else:
                low = sigma
                sigma = sigma * 2 if high == math.inf else (low + high) / 2
        for dist, j in near:
            p[i, j] = math.exp(-max(dist - rho, 0) / sigma)
    return {(i, j): p.get((i, j), 0) + p.get((j, i), 0) - p.get((i, j), 0) * p.get((j, i), 0) for a, b in p for i, j in ((a, b), (b, a))}


def test_fuzzy_graph_against_plain_loops(spark):
    x = clustered(200, 5, width=6)
    points = frame(spark, x).toDF("_i", "_v")
    got = {(r["i"], r["j"]): r["w"] for r in fuzzy_graph(points, 16).collect()}
    want = plain_graph(x, 15)
    assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in got) < 1e-9 and min(got.values()) > 0 and max(got.values()) <= 1 + 1e-12


@pytest.mark.parametrize("others", [0, 10])
def test_layout_against_a_plain_loop(others):
    rng = np.random.default_rng(1)
    y, pool = rng.normal(size=(30, 2)), rng.normal(size=(others, 2))
    own, other, weight, fixed = rng.integers(0, 30, 90), rng.integers(-1, 30, 90), rng.random(90), rng.normal(size=(90, 2))
    other[:10], own[:10] = range(10), range(10)  # an edge to itself pulls nothing
    rates = np.array([1.0, 0.5, 0.25])
    got = descend(y, own, other, fixed, weight, pool, rates, np.random.default_rng(7))
    draws, now = np.random.default_rng(7), [list(p) for p in y.tolist()]
    a, b = module.CURVE_A, module.CURVE_B
    for rate in rates:
        edges = [e for e, u in enumerate(draws.random(len(own))) if u < weight[e]]
        before, everyone = [list(p) for p in now], pool.tolist() or [list(p) for p in now]
        away = draws.integers(0, len(everyone), (len(edges), module.NEGATIVES))
        step = [[0.0, 0.0] for _ in now]
        for n, e in enumerate(edges):
            i = own[e]
            for q, pulls in [(before[other[e]] if other[e] >= 0 else fixed[e], True)] + [(everyone[j], False) for j in away[n]]:
                gap = [now[i][c] - q[c] for c in (0, 1)]
                d2 = gap[0] ** 2 + gap[1] ** 2
                if d2 > 0:
                    force = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) if pulls else 2 * b / ((0.001 + d2) * (1 + a * d2**b))
                    for c in (0, 1):
                        step[i][c] += min(max(force * gap[c], -4), 4)
        now = [[p[c] + rate * s[c] for c in (0, 1)] for p, s in zip(now, step, strict=True)]
    assert np.abs(got - np.array(now)).max() < 1e-9


def kept(x, y, k=15):
    a, b = plain(x, k + 1)[0], plain(y, k + 1)[0]
    return np.mean([len(set(i) & set(j)) - 1 for i, j in zip(a.tolist(), b.tolist(), strict=True)]) / k


@pytest.mark.parametrize("block", [4096, 150])
def test_umap_keeps_neighbours_and_clusters_however_rows_are_dealt(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "ROUNDS", 8)
    x = clustered(600, 6, width=8)
    found = {r["id"]: (r["umap_x"], r["umap_y"]) for r in umap(frame(spark, x).repartition(1), "id", "v", epochs=100).collect()}
    again = {r["id"]: (r["umap_x"], r["umap_y"]) for r in umap(frame(spark, x).repartition(5, "id"), "id", "v", epochs=100).collect()}
    y = np.array([found[i] for i in range(len(x))])
    assert np.abs(y - np.array([again[i] for i in range(len(x))])).max() < 1e-6
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    ours, principal = kept(x, y), kept(x, (x - x.mean(0)) @ axes.T)
    assert ours > (1.2 if block > len(x) else 1.02) * principal and ours > 0.3, (ours, principal)


def test_umap_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", v, 1.0) for i, v in enumerate(rng.normal(size=(20, 3)).tolist())]
    rows += [("copy", rows[0][1], 1.0), (None, rows[1][1], 1.0), ("r2", rows[3][1], 1.0), ("bad", [1.0, None, 2.0], 1.0), ("nan", [float("nan")] * 3, 1.0), ("short", [1.0], 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "name string, v array<double>, x double")
    got = [tuple(r) for r in umap(df, "name", "v", k=4, epochs=20).collect()]
    by = dict(r[:1] + (r[1:],) for r in got)
    assert len(got) == 26 and by["copy"] == by["r0"] and by[None] == by["r1"] and all(by[n] == (None, None) for n in ("bad", "nan", "short"))
    assert all(np.isfinite(v).all() for n, v in by.items() if n not in ("bad", "nan", "short"))
    assert umap(df.limit(0), "name", "v").collect() == [] and {tuple(r) for r in umap(df.limit(3), "name", "v").collect()} == {(f"r{i}", None, None) for i in range(3)}
