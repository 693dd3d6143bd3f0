from __future__ import annotations

import math

import numpy as np
import pytest

from lensaudit.operators import projection
from lensaudit.operators import tsne as module
from lensaudit.operators.tsne import Cells, Tree, affinities, descend, joint, tsne

from .test_neighbours import clustered, plain
from .test_umap import frame, kept


def test_affinities_have_the_perplexity_and_edges_both_directions(spark):
    x = clustered(120, 4, width=5)
    order, d = plain(x, 31)
    p = affinities(d[:, 1:], 10.0)
    assert np.abs(p.sum(1) - 1).max() < 1e-12 and np.abs(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(1)) - 10).max() < 1e-6
    want: dict = {}
    for i in range(len(x)):
        for j, w in zip(order[i, 1:].tolist(), p[i].tolist(), strict=True):
            for e in ((i, j), (j, i)):
                want[e] = want.get(e, 0) + w / 2
    got = {(r["i"], r["j"]): r["w"] for r in joint(frame(spark, x).toDF("_i", "_v"), 10.0, 30).collect()}
    assert got.keys() == want.keys() and max(abs(got[e] - want[e]) for e in got) < 1e-9 and abs(sum(got.values()) - len(x)) < 1e-6


@pytest.mark.parametrize("width", [1e-4, 1.0, 30.0, 300.0])
@pytest.mark.parametrize("angle", [0.0, 0.5])
def test_tree_against_all_pairs(monkeypatch, width, angle):
    monkeypatch.setattr(module, "ANGLE", angle)
    rng = np.random.default_rng(3)
    at, mass = rng.normal(size=(300, 2)) * width / 4 + 5, np.append(np.ones(250), rng.integers(1, 9, 50))
    force, z = Tree(at, 250).push(at, mass, 250)
    want, total = np.zeros((250, 2)), np.zeros(250)
    for i in range(250):
        for j in range(300):
            if i != j:
                gap = at[i] - at[j]
                q = 1 / (1 + gap @ gap)
                total[i] += mass[j] * q
                want[i] += mass[j] * q * q * gap
    off = 0.04 if angle else 1e-3  # two points of one smallest cell count as its middle
    assert np.abs(force - want).max() <= off * np.abs(want).max() and np.abs(z - total).max() <= off * total.max()


def test_cells_less_a_block_are_the_other_points():
    y = np.random.default_rng(2).normal(size=(500, 2)) * 20
    cells = Cells(y.min(0), y.max(0))
    left = cells.sums(y) - cells.sums(y[:200])
    assert (left == cells.sums(y[200:])).all() and left[0].sum() == 300
    places, masses = cells.places(left)
    assert masses.sum() == 300 and np.abs((places * masses[:, None]).sum(0) - y[200:].sum(0)).max() < 1e-2


def test_steps_against_plain_loops(monkeypatch):
    monkeypatch.setattr(module, "ANGLE", 0.0)
    monkeypatch.setattr(module, "REFRESH", 1)
    monkeypatch.setattr(module, "PRECISION", np.float64)
    rng = np.random.default_rng(5)
    n = 40
    state = np.hstack((rng.normal(size=(n, 2)), rng.normal(size=(n, 2)) * 0.01, np.ones((n, 2)), np.zeros((n, 1))))
    own, other, weight, fixed = rng.integers(0, 30, 90), rng.integers(-1, 30, 90), rng.random(90), rng.normal(size=(90, 2))
    still = state[30:, :2]  # the last ten are points of other blocks
    steps = np.array([149, 150, 151])
    got = descend(state[:30], own, other, fixed, weight, n, steps, still, np.ones(10), 7.0)
    y, move, gain = (state[:30, c : c + 2].tolist() for c in (0, 2, 4))
    for step in steps:
        everyone = y + still.tolist()
        q = [[0 if i == j else 1 / (1 + math.dist(a, b) ** 2) for j, b in enumerate(everyone)] for i, a in enumerate(y)]
        total = sum(map(sum, q)) + 7
        grad = [[-4 * sum(q[i][j] ** 2 * (y[i][c] - everyone[j][c]) for j in range(n)) / total for c in (0, 1)] for i in range(30)]
        for e, i in enumerate(own):
            to = y[other[e]] if other[e] >= 0 else fixed[e]
            for c in (0, 1):
                grad[i][c] += 4 * (12 if step < 150 else 1) / n * weight[e] * (y[i][c] - to[c]) / (1 + math.dist(y[i], to) ** 2)
        for i in range(30):
            for c in (0, 1):
                gain[i][c] = max(gain[i][c] + 0.2 if np.sign(grad[i][c]) != np.sign(move[i][c]) else gain[i][c] * 0.8, 0.01)
                move[i][c] = (0.5 if step < 150 else 0.8) * move[i][c] - 50 * gain[i][c] * grad[i][c]
        y = [[y[i][c] + move[i][c] for c in (0, 1)] for i in range(30)]
    assert np.abs(got[:, :2] - np.array(y)).max() < 1e-6 and np.abs(got[:, 6] - [sum(r) for r in q]).max() < 1e-6


@pytest.mark.parametrize("block", [4096, 200])
def test_tsne_keeps_neighbours_however_rows_are_dealt(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "ROUNDS", 10)
    x = clustered(600, 6, width=8)
    found, again = ({r["id"]: (r["tsne_x"], r["tsne_y"]) for r in tsne(df, "id", "v", steps=300).collect()} for df in (frame(spark, x).repartition(1), frame(spark, x).repartition(5, "id")))
    y = np.array([found[i] for i in range(len(x))])
    assert np.abs(y - np.array([again[i] for i in range(len(x))])).max() < 1e-6 * np.abs(y).max()
    exact = kept(x, projection.tsne_layout(x, 30, steps=300))
    ours = kept(x, y)
    assert ours > 0.9 * exact and ours > 0.35, (ours, exact)


def test_tsne_of_odd_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(f"r{i}", v, 1.0) for i, v in enumerate(rng.normal(size=(20, 3)).tolist())]
    rows += [("copy", rows[0][1], 1.0), (None, rows[1][1], 1.0), ("r2", rows[3][1], 1.0), ("bad", [1.0, None, 2.0], 1.0), ("nan", [float("nan")] * 3, 1.0), ("short", [1.0], 1.0), ("none", None, 1.0)]
    df = spark.createDataFrame(rows, "name string, v array<double>, x double")
    got = [tuple(r) for r in tsne(df, "name", "v", steps=40).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 26 and by["copy"] == by["r0"] and by[None] == by["r1"] and all(by[n] == (None, None) for n in ("bad", "nan", "short"))
    assert all(np.isfinite(v).all() for n, v in by.items() if n not in ("bad", "nan", "short"))
    assert tsne(df.limit(0), "name", "v").collect() == [] and {tuple(r) for r in tsne(df.limit(3), "name", "v").collect()} == {(f"r{i}", None, None) for i in range(3)}
