"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, is_small, materialize

#: Edges that a task contracts at once.
_HELD = 1 << 20


def star_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node) that connect what the edges (u, v) connect, a star for each component."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        if (x == y).all():
            break
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    leaf = np.flatnonzero(up != np.arange(len(nodes)))
    return nodes[leaf], nodes[up[leaf]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges before the first shuffle: each run of a partition's edges becomes stars."""
    held: list[pa.RecordBatch] = []

    def stars():
        u, v = star_forest(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        held.clear()
        for lo in range(0, len(u), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(u[lo : lo + (1 << 16)]), pa.array(v[lo : lo + (1 << 16)])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= _HELD:
            yield from stars()
    if held:
        yield from stars()


def _star(edges: DataFrame, turn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """turn's result for edges and each u's least neighbour m."""
    return turn(edges, edges.groupBy("u").agg(F.min("v").alias("m")))


def _split_star(edges: DataFrame, turn: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """_star() for large tables: the minima go into the join as a written table, so that a hot node's edges can be split."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    out = materialize(turn(edges, least))
    discard(least)
    return out


def _large_star(edges: DataFrame, star=_split_star) -> DataFrame:
    """Each node's larger neighbours are linked to the least node around it; small-star, which follows, drops repeated edges."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return star(both, lambda e, least: e.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")))


def _small_star(edges: DataFrame, star=_split_star) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these; u > v in every edge."""
    return star(edges, lambda e, least: e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct())


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars: each u has one edge, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root"))
    return seen.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("root") > 0)))).first()[0] == 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (u, v): root is the least node of its component, roots included.

    Self-links, repeated and reversed edges and nulls do no harm; an empty table gives an empty result. The hot
    node of a star is never gathered: minima are aggregated before the shuffle, and the joins that follow can be split.
    """
    least, most = F.least("u", "v"), F.greatest("u", "v")
    now = materialize(edges.where("u <> v").select(most.alias("u"), least.alias("v")).mapInArrow(_contract, "u bigint, v bigint").distinct())
    for _ in range(rounds):
        if is_small(now):
            before, now = now, materialize(_small_star(_large_star(now, _star), _star))
        else:
            before = _large_star(now)
            discard(now)
            now = _small_star(before)
        discard(before)
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
