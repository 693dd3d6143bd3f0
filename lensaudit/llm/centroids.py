"""Clustering by the nearest of k centroids, in whole numbers.

A vector's components become integers floor(scale * x). They are written once, as blocks of rows in the narrowest integers that hold them. Distances come
from |x|^2 - 2 x.c + |c|^2 with x.c as one product of matrices in double precision: as long as width * (max|x| + max|c|)^2 stays below 2^53, each product and
each partial sum is a whole number that a double holds, so the result is exact in any order of addition. Rows beyond that bound are computed with
64-bit integers, and those beyond 2^63 with Python's. A round is one treeAggregate over the blocks: what leaves a task is a sum and a count for each centroid.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, operator

#: Rows of a block at most, and bytes of its components in double precision: a task works on one block at a time.
BLOCK_ROWS, BLOCK_BYTES = 8192, 8 << 20
#: Whole numbers below this are exact in double precision; those below the second in 64 bits.
EXACT, WIDE = 1 << 53, 1 << 63


def _whole(x: float, scale: int) -> int:
    """floor(scale * x) for any finite double, without rounding: doubles from 2^52 are whole numbers themselves."""
    return int(x) * scale if abs(x) >= 1 << 52 else int(np.floor(x * scale))


def quantise(flat: np.ndarray, width: int, scale: int) -> np.ndarray:
    """Rows of whole numbers in the narrowest type that holds them all; object (Python's integers) beyond 62 bits. scale is a power of two."""
    with np.errstate(over="ignore"):
        scaled = np.floor(flat * scale).reshape(-1, width)
    most = np.abs(scaled).max(initial=0)
    if most < 1 << 62:
        return scaled.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))
    return np.array([_whole(x, scale) for x in flat.tolist()], object).reshape(-1, width)


def pack(rows: np.ndarray) -> bytes:
    """A block's numbers: one letter for the type, then the values."""
    return b"O" + pickle.dumps(rows) if rows.dtype == object else rows.dtype.char.encode() + rows.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    if data[:1] == b"O":
        return pickle.loads(bytes(data[1:]))
    return np.frombuffer(data, np.dtype(bytes(data[:1]).decode()), offset=1).reshape(-1, width)


@dataclass
class Centroids:
    """k rows of whole numbers of any size, with what the product of matrices needs of them."""

    rows: list[list[int]]

    def __post_init__(self):
        self.exact = np.array(self.rows, object)
        self.most = max((abs(c) for row in self.rows for c in row), default=0)
        self.rough = self.exact.astype(np.float64) if self.most < EXACT else None
        self.squares = (self.rough * self.rough).sum(1) if self.rough is not None else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each row, the first of equals, and the squared distance: int64, or object where one needs more."""
        width = max(x.shape[1], 1)
        reach = np.abs(x).max(1, initial=0)
        cluster, distance = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
        # Whole numbers on both sides of the comparisons: (bound // width) ** 0.5 rounded down, less what the centroids take.
        fits = np.zeros(len(x), bool) if self.rough is None else reach <= int((EXACT // width) ** 0.5) - 1 - self.most
        if fits.any():
            rows = x[fits].astype(np.float64)
            all_ = (rows * rows).sum(1)[:, None] - 2.0 * (rows @ self.rough.T) + self.squares
            cluster[fits] = best = all_.argmin(1)
            distance[fits] = all_[np.arange(len(best)), best].astype(np.int64)
        if fits.all():
            return cluster, distance
        whole = ~fits & (reach <= int((WIDE // width) ** 0.5) - 1 - self.most)
        for at in (np.flatnonzero(whole), np.flatnonzero(~fits & ~whole)):
            if len(at):
                kind = np.int64 if whole[at[0]] else object
                if kind is object:
                    distance = distance.astype(object)
                all_ = np.stack([((x[at].astype(kind) - c.astype(kind)) ** 2).sum(1) for c in self.exact], 1)
                cluster[at] = best = all_.argmin(1)
                distance[at] = all_[np.arange(len(best)), best]
        return cluster, distance

    def totals(self, x: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
        """Rows, summed distance and summed components of each centroid that has rows."""
        cluster, distance = self.nearest(x)
        k = len(self.rows)
        count = np.bincount(cluster, minlength=k)
        own = np.flatnonzero(count)
        most = int(np.abs(x).max(initial=0))
        if most * len(x) < EXACT:
            member = np.zeros((k, len(x)))
            member[cluster, np.arange(len(x))] = 1
            sums = (member @ x.astype(np.float64)).astype(np.int64)
        else:
            wide = x.astype(np.int64 if most * len(x) < WIDE else object)
            sums = [wide[cluster == j].sum(0) for j in range(k)]
        return {int(j): (int(count[j]), sum(distance[cluster == j].tolist()), [int(v) for v in sums[j]]) for j in own}


def _merge(a: dict, b: dict) -> dict:
    for j, (n, d, s) in b.items():
        m, e, t = a.get(j, (0, 0, [0] * len(s)))
        a[j] = (m + n, e + d, [x + y for x, y in zip(s, t, strict=True)])
    return a


def _blocks(width: int, scale: int, schema: pa.Schema):
    """Rows (ident, vec) to blocks (idents, data)."""
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                rows = quantise(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), width, scale)
                idents = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([idents.cast(schema.field("idents").type), pa.array([pack(rows)], pa.binary())], schema=schema)

    return run


def _place(centroids: Centroids, width: int, inertia: dict[int, int], digests: list[str], schema: pa.Schema):
    """Blocks to one row a vector."""
    total = _long(sum(inertia.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cluster, distance = centroids.nearest(unpack(batch.column(1)[i].as_buffer(), width))
                own = pa.array([_long(inertia.get(j, 0)) for j in range(len(digests))], pa.int64()).take(pa.array(cluster))
                long = pa.array([_long(d) for d in distance.tolist()] if distance.dtype == object else distance, pa.int64())
                columns = [batch.column(0).slice(i, 1).flatten(), pa.array(cluster), long, own, pa.array(np.full(len(cluster), total)), pa.array(digests).take(pa.array(cluster))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _long(x: int) -> int:
    """What a long holds of a sum that may be larger."""
    return min(x, WIDE - 1)


@operator
def nearest_centroids(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 16, width: int = 64, scale: int = 64, rounds: int = 3) -> DataFrame:
    """One row a kept vector: its id (of any type), cluster, distance (squared), cluster_inertia and inertia (distances summed), centroid_sha256.

    Kept are vectors of exactly width components, none null or non-finite; all others have no row. Centroids start as the k kept vectors whose ids have the least
    sha256 of `1:<id>` (a null id counts as empty; of rows that repeat an id the least vectors first), in that order; with fewer rows there are fewer. Each round gives
    every vector to the nearest (ties: the smaller number) and moves each centroid that has vectors to their mean, each component rounded down.
    Rows that repeat an id or a vector count one by one. Everything is exact; distances and sums beyond a long are given as the largest long.
    centroid_sha256: of the final components, joined by commas. An empty table gives an empty result; other columns are not looked at. scale is a power of two.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

    if scale < 1 or scale & (scale - 1):
        raise ValueError("scale is a power of two")
    vec = F.col(vector_column)
    sound = (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_column).alias("ident"), vec.cast("array<double>").alias("vec"))
    name = F.concat(F.lit("1:"), F.coalesce(F.col("ident").cast("string"), F.lit("")))
    first = kept.withColumn("place", F.sha2(name, 256)).orderBy("place", "vec").limit(k).select("vec").collect()
    id_type = vectors.schema[id_column].dataType
    placed = StructType().add("ident", id_type).add("cluster", IntegerType()).add("distance", LongType()).add("cluster_inertia", LongType()).add("inertia", LongType()).add("centroid_sha256", StringType())
    if not first:
        return vectors.sparkSession.createDataFrame([], placed).withColumnRenamed("ident", id_column)
    held = StructType().add("idents", ArrayType(id_type)).add("data", BinaryType())
    blocks = materialize(kept.mapInArrow(_blocks(width, scale, to_arrow_schema(held)), held))
    data = blocks.select("data").rdd
    now = Centroids([[_whole(x, scale) for x in row.vec] for row in first])

    def totals() -> dict[int, tuple[int, int, list[int]]]:
        sent = now  # the task's copy
        return data.treeAggregate({}, lambda acc, row: _merge(acc, sent.totals(unpack(row.data, width))), _merge)

    for _ in range(rounds):
        found = totals()
        now = Centroids([[x // found[j][0] for x in found[j][2]] if j in found else row for j, row in enumerate(now.rows)])
    inertia = {j: d for j, (_, d, _) in totals().items()}
    digests = [_digest(row) for row in now.rows]
    out = blocks.select("idents", "data").mapInArrow(_place(now, width, inertia, digests, to_arrow_schema(placed)), placed)
    return out.withColumnRenamed("ident", id_column)


def _digest(row: list[int]) -> str:
    from hashlib import sha256

    return sha256(",".join(map(str, row)).encode()).hexdigest()
