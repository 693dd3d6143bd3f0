"""UMAP in two dimensions, over all rows: a fuzzy graph of exact neighbours, and a layout by sampled edges and negative samples, in blocks.

Equal vectors are one point. Each point's neighbours get weights that fall with distance, scaled so that they add up to log2(k); the two directions of an edge are
joined as a fuzzy union. The layout starts at the principal axes and goes on in rounds: points are dealt into blocks anew, by strips across the layout in another
direction each time, so that most neighbours share a block; each block gets the places of its points' other neighbours, and a task moves its points for some
epochs while all others hold still. One block does all epochs in one round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import settled
from .blocks import adjacent, numbered, one_round
from .neighbours import nearest
from .projection import principal_axes
from .vectors import usable, vectors_from

#: Fixed values of the curve 1 / (1 + a d^(2b)) for a least distance of 0.1 and a spread of 1.
CURVE_A, CURVE_B = 1.5769434603113077, 0.8950608779109733
#: Points of a block; rounds of more than one; negative samples an edge; places of all blocks that these are drawn from; strips at most, which
#: the same places cut, each dealt on to blocks by a hash where there are more.
BLOCK, ROUNDS, NEGATIVES, POOL, STRIPS = 4096, 15, 5, 2048, 256


def local_weights(distances: np.ndarray) -> np.ndarray:
    """Of each row's distances to its neighbours (without itself), ascending: weights that are 1 up to the least positive one and add up to log2 of the row's size plus 1."""
    k = distances.shape[1]
    rho = np.where(distances > 0, distances, np.inf).min(1, initial=np.inf)
    rho = np.where(np.isfinite(rho), rho, 0)
    over = np.maximum(distances - rho[:, None], 0)
    low, high, sigma = np.zeros(len(over)), np.full(len(over), np.inf), np.ones(len(over))
    for _ in range(64):
        total = np.exp(-over / sigma[:, None]).sum(1)
        wide = total > np.log2(k + 1)
        high, low = np.where(wide, sigma, high), np.where(wide, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    sigma = np.maximum(sigma, 1e-3 * np.maximum(distances.mean(1), 1e-300))
    return np.exp(-over / sigma[:, None])


def _directed(weigh: Callable[[np.ndarray], np.ndarray]):
    """Rows (id, near) to (i, j, p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1)
            size = near.value_lengths().to_numpy()
            own = np.repeat(np.arange(batch.num_rows), size)
            d, j = near.flatten().field(0).to_numpy(), near.flatten().field(1)
            other = pa.compute.not_equal(batch.column(0).take(pa.array(own)), j).to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(other)
            per = np.bincount(own[keep], minlength=batch.num_rows)
            for n in np.unique(per[per > 0]).tolist():
                at = keep[np.isin(own[keep], np.flatnonzero(per == n))]
                p = weigh(d[at].reshape(-1, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own[at])), j.take(pa.array(at)), pa.array(p.ravel())], ["i", "j", "p"])

    return run


def weighted_neighbours(points: DataFrame, k: int, weigh: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Of points (_i, _v): (i, j, p), the k nearest of each, itself among them but not given, weighed by their ascending distances."""
    kind = points.schema["_i"].dataType.simpleString()
    return nearest(points, k).select("_i", "near").mapInArrow(_directed(weigh), f"i {kind}, j {kind}, p double")


def fuzzy_graph(points: DataFrame, k: int = 15) -> DataFrame:
    """Of points (_i, _v): (i, j, w), both directions of each edge of the union of memberships p + q - p q."""
    directed = weighted_neighbours(points, k, local_weights)
    pairs = directed.groupBy(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.sum("p").alias("s"), F.min("p").alias("a"), F.max("p").alias("b"), F.count("*").alias("n"))
    edges = pairs.select("i", "j", F.when(F.col("n") > 1, F.col("s") - F.col("a") * F.col("b")).otherwise(F.col("s")).alias("w"))
    return edges.union(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))


def descend(y: np.ndarray, own: np.ndarray, other: np.ndarray, fixed: np.ndarray, weight: np.ndarray, pool: np.ndarray, rates: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """y moved for len(rates) epochs. Edge e pulls y[own[e]] to y[other[e]], or to fixed[e] where other[e] is below 0, when its weight exceeds a draw; then as many
    points as NEGATIVES, drawn from pool, or from y where pool is empty, push it away."""
    y = y.copy()
    for rate in rates:
        drawn = np.flatnonzero(rng.random(len(own)) < weight)
        at = own[drawn]
        to = np.where((other[drawn] >= 0)[:, None], y[other[drawn]], fixed[drawn])
        gap = y[at] - to
        d2 = (gap * gap).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            pull = np.where(d2 > 0, -2 * CURVE_A * CURVE_B * d2 ** (CURVE_B - 1) / (1 + CURVE_A * d2**CURVE_B), 0)
        move = np.clip(pull[:, None] * gap, -4, 4)
        step = np.column_stack([np.bincount(at, move[:, c], len(y)) for c in (0, 1)])
        everyone = pool if len(pool) else y
        away = rng.integers(0, len(everyone), (len(drawn), NEGATIVES))
        gap = y[at][:, None] - everyone[away]
        d2 = (gap * gap).sum(2)
        push = np.where(d2 > 0, 2 * CURVE_B / ((1e-3 + d2) * (1 + CURVE_A * d2**CURVE_B)), 0)
        move = np.clip(push[..., None] * gap, -4, 4).sum(1)
        step += np.column_stack([np.bincount(at, move[:, c], len(y)) for c in (0, 1)])
        y += rate * step
    return y


def _epochs(seed: int, turn: int, rates: np.ndarray, pool: np.ndarray):
    """A block's points and edges to the points' new places."""

    def move(block: int, y: np.ndarray, own: np.ndarray, other: np.ndarray, fixed: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return descend(y, own, other, fixed, weight, pool, rates, np.random.default_rng([seed, turn, block]))

    return move


def dealt_by_strips(at: DataFrame, n: int, blocks: int, turn: int, seed: int) -> tuple[np.ndarray, Column]:
    """Of n placed points (_i, _h, x, y): places drawn from all of them, none for one block, and each point's block, by strips across the layout in the turn's direction."""
    if blocks == 1:
        return np.zeros((0, 2)), F.lit(0)
    strips = min(blocks, STRIPS)
    some = at.where(F.pmod(F.xxhash64("_h", F.lit(-1 - turn)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, POOL / n))).select("_i", "x", "y").limit(2 * POOL).collect()
    pool = np.array([(r["x"], r["y"]) for r in sorted(some)], float).reshape(-1, 2)
    way = np.array([np.cos(2.4 * turn), np.sin(2.4 * turn)])
    cuts = np.quantile(pool @ way, np.arange(1, strips) / strips) if len(pool) else np.zeros(0)
    strip = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda m, c: m + (F.col("x") * float(way[0]) + F.col("y") * float(way[1]) > c).cast("int"))
    return pool, strip * -(-blocks // strips) + F.pmod(F.xxhash64("_h", F.lit(seed + turn)), F.lit(-(-blocks // strips))).cast("int")


def umap(df: DataFrame, index: str, vector: str, seed: int = 42, k: int = 15, epochs: int = 200, prefix: str = "umap") -> DataFrame:
    """(index, x, y), the index of any type; null below 5 different vectors, and for vectors that usable() leaves out (null vectors have no row).

    Rows with equal vectors have one place; rows that repeat an id are rows of their own. The result depends on seed, ids and vectors, not on how rows are dealt to partitions.
    """
    sound, others = usable(df, vector)
    x, y = f"{prefix}_x", f"{prefix}_y"
    nowhere = [F.lit(None).cast("double").alias(c) for c in (x, y)]
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
            at = (v - mean) @ directions.T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at[:, 0]), pa.array(at[:, 1])], ["_i", "_h", "x", "y"])

    at = settled(points.mapInArrow(start, "_i int, _h bigint, x double, y double"))
    widest = at.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
    noise = [(F.pmod(F.xxhash64("_h", F.lit(c)), F.lit(1 << 20)) / float(1 << 20) - 0.5) * 1e-3 for c in "xy"]
    first = at
    at = at.select("_i", "_h", *[(F.col(c) * (10 / widest) + e).alias(c) for c, e in zip("xy", noise, strict=True)])
    at = settled(at, replaces=first)
    edges = adjacent(fuzzy_graph(points.select("_i", "_v"), k + 1))
    blocks = max(1, -(-n // BLOCK))
    rounds = 1 if blocks == 1 else ROUNDS
    rates = np.array_split(1 - np.arange(epochs) / epochs, rounds)
    for turn in range(rounds):
        pool, block = dealt_by_strips(at, n, blocks, turn, seed)
        at = one_round(at, edges, blocks, block, ("x", "y"), _epochs(seed, turn, rates[turn], pool))
    edges.unpersist()
    found = rows.withColumn("_h", F.xxhash64("_v", F.lit(seed))).join(points.select("_h", "_i"), "_h").join(at, "_i")
    return found.select(F.col("_id").alias(index), F.col("x").alias(x), F.col("y").alias(y)).union(none)
