"""t-SNE in two dimensions over all rows: sparse affinities from exact neighbours, repulsion by a quadtree (Barnes-Hut), layout in blocks.

Equal vectors are one point. Every point repels every other: a cell of the quadtree that is small against its distance stands for all its points,
so no matrix of pairs exists. The layout goes on in rounds. A round counts all points in the cells of one level of the tree, a table of bounded size
(in whole numbers: sums don't depend on partitions), and deals points into blocks by strips. A block takes its own points out of the
cells and builds its tree of them and of what is left of the cells; its points move for the steps of the round while all others hold still, and
neighbours elsewhere pull from where they were. Only what other blocks hold near a strip's edge is seen as cells where points would be finer.
One block does all steps in one round, with points alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import settled
from .blocks import adjacent, numbered, one_round
from .projection import principal_axes
from .umap import dealt_by_strips, weighted_neighbours
from .vectors import usable, vectors_from

#: Points of a block; rounds of more than one; steps, and how many first ones pull harder, by how much.
BLOCK, ROUNDS, STEPS, EARLY, HARDER = 4096, 25, 500, 150, 12.0
#: A cell stands for its points where its side is below ANGLE of its distance; levels of a tree; steps after which it is built anew.
ANGLE, DEPTH, REFRESH = 0.5, 14, 10
#: Cells across in which a round counts all points; a place's and a sum's units as whole numbers.
ACROSS, UNIT, UNIT_Z = 128, float(1 << 20), 1024
#: What pairs of points and cells are computed in.
PRECISION = np.float32
STATE = ("x", "y", "mx", "my", "gx", "gy", "z")


def affinities(distances: np.ndarray, perplexity: float) -> np.ndarray:
    """Of each row's distances to its neighbours: weights that add up to 1 and have the entropy log(perplexity), as far as the row's size allows."""
    d = distances * distances
    d = d - d.min(1, keepdims=True)
    low, high, beta = np.zeros(len(d)), np.full(len(d), np.inf), 1 / np.maximum(d.mean(1), 1e-300)
    goal = np.log(min(perplexity, d.shape[1]))
    for _ in range(64):
        p = np.exp(-d * beta[:, None])
        p /= p.sum(1, keepdims=True)
        wide = -(p * np.log(np.maximum(p, 1e-300))).sum(1) > goal
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), np.minimum(beta * 2, 1e300), (low + high) / 2)
    return p


def joint(points: DataFrame, perplexity: float, k: int) -> DataFrame:
    """Of points (_i, _v): (i, j, w), both directions of each edge, w the mean of the two affinities, 0 for one that isn't there."""
    directed = weighted_neighbours(points, k + 1, lambda d: affinities(d, perplexity))
    both = directed.union(directed.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    return both.repartition("i").groupBy("i", "j").agg((F.sum("p") / 2).alias("w"))


class Tree:
    """A quadtree over weighted places; which cells stand for others at each of the first `own` places is settled when it is built, what they weigh at each call."""

    def __init__(self, at: np.ndarray, own: int):
        low = at.min(0)
        side = max(float((at.max(0) - low).max()), 1e-12) * (1 + 1e-9)
        grid = np.minimum(((at - low) / side * (1 << DEPTH)).astype(np.int64), (1 << DEPTH) - 1)
        code = np.zeros(len(at), np.int64)
        for bit in range(DEPTH):
            code |= ((grid[:, 0] >> bit) & 1) << (2 * bit) | ((grid[:, 1] >> bit) & 1) << (2 * bit + 1)
        self.order = np.argsort(code, kind="stable")
        code = code[self.order]
        point, cell = np.arange(own), np.zeros(own, np.int64)
        starts, points, cells, offset = [], [], [], 0
        start = np.zeros(1, np.int64)
        sums = np.vstack((np.zeros(2), np.cumsum(at[self.order], 0)))
        for level in range(DEPTH + 1):
            end = np.append(start[1:], len(at))
            middle = (sums[end] - sums[start]) / (end - start)[:, None]
            gap = at[point] - middle[cell]
            size = side / (1 << level)
            stands = (size * size < ANGLE * ANGLE * (gap * gap).sum(1)) | (end - start == 1)[cell]
            if level == DEPTH:
                stands[:] = True
            starts.append(start)
            points.append(point[stands])
            cells.append(cell[stands] + offset)
            offset += len(start)
            point, cell = point[~stands], cell[~stands]
            if not len(point):
                break
            finer = np.flatnonzero(np.append(True, np.diff(code >> 2 * (DEPTH - level - 1)) != 0))
            first = np.searchsorted(finer, start)
            many = np.append(first[1:], len(finer)) - first
            per = many[cell]
            point = np.repeat(point, per)
            cell = np.repeat(first[cell] - np.cumsum(per) + per, per) + np.arange(len(point))
            start = finer
        self.starts, point, self.cell = starts, np.concatenate(points), np.concatenate(cells)
        by = np.argsort(point, kind="stable")  # each point's cells together: they are read, and added up, in one run
        self.cell, self.per = self.cell[by], np.bincount(point, minlength=own)
        self.first = np.cumsum(self.per) - self.per

    def push(self, at: np.ndarray, weight: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """At each of the first `own` places: the sum of q^2 times the gap and the sum of q over all others, q being 1 / (1 + d^2)."""
        each = np.column_stack((weight, at * weight[:, None]))[self.order]
        total = np.concatenate([np.add.reduceat(each, s, axis=0) for s in self.starts])
        middle, mass = total[:, 1:] / total[:, :1], total[:, 0]
        about = at.mean(0)  # keeps digits
        gx, gy = (np.repeat((at[:own, c] - about[c]).astype(PRECISION), self.per) - (middle[:, c] - about[c]).astype(PRECISION)[self.cell] for c in (0, 1))
        q = 1 / (1 + gx * gx + gy * gy)
        force = mass.astype(PRECISION)[self.cell] * q
        sums = lambda x: np.add.reduceat(x, self.first, dtype=np.float64)
        z = sums(force) - 1
        force *= q
        return np.column_stack([sums(force * g) for g in (gx, gy)]), z


class Cells:
    """Counts and places of points in cells of a square."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.side = low, max(float((high - low).max()), 1e-9)

    def sums(self, y: np.ndarray) -> np.ndarray:
        """Points, x and y (from the corner) of each cell, in whole units."""
        cell = np.clip((y - self.low) / self.side * ACROSS, 0, ACROSS - 1).astype(np.int64)
        cell = cell[:, 0] * ACROSS + cell[:, 1]
        units = np.rint((y - self.low) / self.side * UNIT)
        return np.stack([np.bincount(cell, w, ACROSS * ACROSS) for w in (None, units[:, 0], units[:, 1])])

    def places(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Middles of the cells that hold points, and how many these are."""
        some = sums[:, sums[0] > 0]
        return (some[1:] / some[0] / UNIT * self.side).T + self.low, some[0]


def pull(y: np.ndarray, own: np.ndarray, to: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The attractive part: edge e pulls y[own[e]] to the place to[e]."""
    gx, gy = (y[own, c] - to[:, c] for c in (0, 1))
    force = weight / (1 + gx * gx + gy * gy)
    return np.column_stack([np.bincount(own, force * g, len(y)) for g in (gx, gy)])


def descend(state: np.ndarray, own: np.ndarray, other: np.ndarray, fixed: np.ndarray, weight: np.ndarray, n: int, steps: np.ndarray, places: np.ndarray, masses: np.ndarray, beyond: float) -> np.ndarray:
    """State (x, y, moves, gains, z) after the numbered steps. Edge e leads from point own[e] to other[e], or to fixed[e] where other[e] is below 0.

    places, masses: where all other points are, as cells. beyond: the sum of their z, a point's z being what its q to all others add up to. n: points in all.
    """
    y, move, gain, z = state[:, :2].copy(), state[:, 2:4].copy(), state[:, 4:6].copy(), state[:, 6]
    rate = max(n / HARDER / 4, 50)
    outside = np.flatnonzero(other < 0)
    masses = np.concatenate((np.ones(len(y)), masses))
    for turn, step in enumerate(steps):
        at = np.vstack((y, places))
        if turn % REFRESH == 0:
            tree = Tree(at, len(y))
        push, z = tree.push(at, masses, len(y))
        to = y[other]
        to[outside] = fixed[outside]
        hard, keep = (HARDER, 0.5) if step < EARLY else (1.0, 0.8)
        grad = 4 * (hard / n * pull(y, own, to, weight) - push / max(z.sum() + beyond, 1e-12))
        gain = np.maximum(np.where(np.sign(grad) != np.sign(move), gain + 0.2, gain * 0.8), 0.01)
        move = keep * move - rate * gain * grad
        y += move
    return np.column_stack((y, move, gain, z))


def _steps(n: int, steps: np.ndarray, cells: Cells | None, everyone, z: int):
    """A block's points and edges to the points' new state."""

    def move(block: int, state: np.ndarray, own: np.ndarray, other: np.ndarray, fixed: np.ndarray, weight: np.ndarray) -> np.ndarray:
        places, masses, beyond = np.zeros((0, 2)), np.zeros(0), 0.0
        if cells is not None:
            places, masses = cells.places(everyone.value - cells.sums(state[:, :2]))
            beyond = max(z - np.rint(state[:, 6] * UNIT_Z).sum(), 0.0) / UNIT_Z
        return descend(state, own, other, fixed, weight, n, steps, places, masses, beyond)

    return move


def _counted(at: DataFrame, cells: Cells) -> np.ndarray:
    """Cells of all points: tasks add up their own, and at most as many rows as cells reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, ACROSS * ACROSS))
        for batch in batches:
            total += cells.sums(np.column_stack([batch.column(c).to_numpy() for c in (0, 1)]))
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(c[some].astype(np.int64)) for c in total]], ["cell", "n", "x", "y"])

    found = at.select("x", "y").mapInArrow(run, "cell bigint, n bigint, x bigint, y bigint").groupBy("cell").agg(*[F.sum(c).alias(c) for c in "nxy"]).toArrow()
    total = np.zeros((3, ACROSS * ACROSS))
    total[:, found.column("cell").to_numpy()] = [found.column(c).to_numpy() for c in "nxy"]
    return total


def tsne(df: DataFrame, index: str, vector: str, seed: int = 42, perplexity: float = 30.0, steps: int = STEPS, prefix: str = "tsne") -> DataFrame:
    """(index, x, y), the index of any type; null below 5 different vectors, and for vectors that usable() leaves out (null vectors have no row).

    Perplexity is at most a quarter of the points (2 at least), with three neighbours for each unit of it. Rows with equal vectors have one place; rows
    that repeat an id are rows of their own. The result depends on seed and vectors, not on how rows are dealt to partitions.
    """
    sound, others = usable(df, vector)
    names = [f"{prefix}_x", f"{prefix}_y"]
    nowhere = [F.lit(None).cast("double").alias(c) for c in names]
    none = others.where(F.col(vector).isNotNull()).select(F.col(index).alias(index), *nowhere)
    rows = sound.select(F.col(index).alias("_id"), F.col(vector).alias("_v"))
    points = numbered(rows, seed)
    n = points.count()
    axes = principal_axes(points, "_v") if n >= 5 else None
    if axes is None:
        return rows.select(F.col("_id").alias(index), *nowhere).union(none)
    mean, directions, _ = axes
    directions = np.vstack((directions, np.zeros_like(directions)))[:2]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, v in vectors_from(batches, 2):
            if len(v):
                at = (v - mean) @ directions.T
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(at[:, c]) for c in (0, 1)]], ["_i", "_h", "x", "y"])

    at = settled(points.mapInArrow(start, "_i int, _h bigint, x double, y double"))
    spread = at.agg(F.stddev_pop("x")).first()[0] or 1.0
    noise = [(F.pmod(F.xxhash64("_h", F.lit(c)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-6 for c in "xy"]
    first = at
    # The principal axes are sums whose last digits depend on partitions, so places start from a coarser step.
    at = at.select("_i", "_h", *[(F.round(F.col(c) / spread, 6) * 1e-4 + e).alias(c) for c, e in zip("xy", noise, strict=True)], *[F.lit(v).alias(c) for c, v in zip(STATE[2:], (0.0, 0.0, 1.0, 1.0, float(n)), strict=True)])
    at = settled(at, replaces=first)
    perplexity = max(2.0, min(perplexity, n // 4))
    edges = adjacent(joint(points.select("_i", "_v"), perplexity, min(int(3 * perplexity), n - 1)).withColumn("w", F.col("w").cast("float")))
    blocks = -(-n // BLOCK)
    context = df.sparkSession.sparkContext
    for turn, some in enumerate(np.array_split(np.arange(steps), ROUNDS if blocks > 1 else 1)):
        cells, everyone, z = None, None, 0
        if blocks > 1:
            *box, z = at.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.sum(F.round(F.col("z") * UNIT_Z).cast("bigint"))).first()
            cells = Cells(np.array(box[:2]), np.array(box[2:]))
            everyone = context.broadcast(_counted(at, cells))
        at = one_round(at, edges, blocks, dealt_by_strips(at, n, blocks, turn, seed)[1], STATE, _steps(n, some, cells, everyone, z))
        if everyone is not None:
            everyone.unpersist()
    edges.unpersist()
    found = rows.withColumn("_h", F.xxhash64("_v", F.lit(seed))).join(points.select("_h", "_i"), "_h").join(at, "_i")
    return found.select(F.col("_id").alias(index), F.col("x").alias(names[0]), F.col("y").alias(names[1])).union(none)
