"""Isolation forest: trees grown on small seeded samples in parallel, rows scored by the broadcast forest."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The usual forest: so many trees, each on so many rows.
TREES, ROWS = 100, 256


def _path_left(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    big = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(big - 1) + 0.5772156649015329) - 2 * (big - 1) / big))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """Nodes in order: feature (-1: leaf), cut, left child (right is the next), and for leaves depth plus what is left to go."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, child, length = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, own, depth = todo.pop()
        part = x[own]
        lo, hi = (part.min(0), part.max(0)) if len(own) else (np.zeros(x.shape[1]),) * 2
        live = np.flatnonzero(hi > lo)
        if depth >= limit or len(own) <= 1 or not len(live):
            length[node] = depth + float(_path_left(len(own)))
            continue
        j = int(rng.choice(live))
        at = float(rng.uniform(lo[j], hi[j]))
        feature[node], cut[node], child[node] = j, at, len(feature)
        for side in (part[:, j] <= at, part[:, j] > at):
            todo.append((len(feature), own[side], depth + 1))
            feature.append(-1), cut.append(0.0), child.append(0), length.append(0.0)
    return feature, cut, child, length


def _tree(columns: Sequence[str], rows: int, seed: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["_tree"].iloc[0])
        part = group.sort_values(["_draw", *columns]).head(rows)
        feature, cut, child, length = grow_tree(part[list(columns)].to_numpy(float), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], "feature": [feature], "cut": [cut], "child": [child], "length": [length], "rows": [len(part)]})

    return run


def fit_forest(df: DataFrame, index: str, columns: Sequence[str], trees: int = TREES, rows: int = ROWS, seed: int = 42) -> list[dict]:
    """Each tree draws its rows by a hash of index, values, tree and seed, so that rows which share an id or have none are drawn apart and that partitions make no difference. Rows must have all columns."""
    n = df.count()
    if not n:
        return []
    share = int((1 << 30) * min(1.0, (rows + 6 * np.sqrt(rows)) / n))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64(F.col(index), *columns, t, F.lit(seed)), F.lit(1 << 30)) < share)
    drawn = df.select(index, *columns, F.explode(numbers).alias("_tree")).withColumn("_draw", F.pmod(F.xxhash64(F.col(index), *columns, "_tree", F.lit(seed)), F.lit(1 << 30)))
    grown = drawn.groupBy("_tree").applyInPandas(_tree(columns, rows, seed), "tree int, feature array<int>, cut array<double>, child array<int>, length array<double>, rows int")
    return [r.asDict() for r in grown.orderBy("tree").collect()]


def score_forest(forest: list[dict], x: np.ndarray) -> np.ndarray:
    """Anomaly scores in 0..1, higher for rows that are set apart sooner."""
    total = np.zeros(len(x))
    for t in forest:
        feature, cut, child, length = (np.asarray(t[k]) for k in ("feature", "cut", "child", "length"))
        node = np.zeros(len(x), int)
        while True:
            inner = feature[node] >= 0
            if not inner.any():
                break
            rows = np.flatnonzero(inner)
            at = node[rows]
            node[rows] = child[at] + (x[rows, feature[at]] > cut[at])
        total += length[node]
    norm = float(_path_left(max((t["rows"] for t in forest), default=2)))
    return 2.0 ** (-total / max(len(forest), 1) / max(norm, 1e-9))


def isolation_scores(df: DataFrame, index: str, columns: Sequence[str], out: str = "isolation", trees: int = TREES, seed: int = 42) -> DataFrame:
    """(index, score) of the rows that have all columns."""
    rows = df.dropna(subset=list(columns)).select(F.col(index), *[F.col(c).cast("double").alias(c) for c in columns])
    forest = df.sparkSession.sparkContext.broadcast(fit_forest(rows, index, columns, trees, seed=seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(columns))]) if batch.num_rows else np.zeros((0, len(columns)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_forest(forest.value, x))], [index, out])

    return rows.mapInArrow(run, f"`{index}` {df.schema[index].dataType.simpleString()}, {out} double")
