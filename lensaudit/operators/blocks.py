"""Layouts in blocks: what the rounds of umap.py and tsne.py share.

Points are numbered by their vectors' hashes, and a point's edges are two arrays in one row, partitioned once by point. A round deals points into blocks anew and
shuffles these rows to their blocks; where all other points are travels packed, once a group of blocks, and a task keeps the places its edges lead to.
Each round's shuffle files and the table before it are deleted when its own is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import settled

#: Tasks that a round's blocks are dealt to, blocks of one task at most, points whose places travel as one row.
GROUPS, BLOCKS_A_GROUP, PLACES = 36, 8, 1 << 16

#: A block's number, its points' state, and of each edge: its point's row in the block, the other's or -1, where the other is then, and the weight.
Move = Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """Of rows (_v): the distinct vectors, written, as (_i, _h, _v); _i counts from 0 in the order of their hashes _h, however rows are dealt to partitions.

    64 bits tell vectors apart but for chance, so of vectors with one hash the least makes the point.
    """
    points = rows.groupBy(F.xxhash64("_v", F.lit(seed)).alias("_h")).agg(F.min("_v").alias("_v")).withColumn("_p", F.shiftright("_h", 56).cast("int") + 128)
    points = settled(points)
    counts = np.zeros(256, np.int64)
    for r in points.groupBy("_p").count().collect():
        counts[r["_p"]] = r["count"]
    before = F.get(F.array(*[F.lit(int(c)) for c in np.cumsum(counts) - counts]), F.col("_p"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h"))
    return settled(points.select((place + before - 1).cast("int").alias("_i"), "_h", "_v"), replaces=points)


def adjacent(edges: DataFrame) -> DataFrame:
    """Edges (i, j, w) as a row a point (i, js, ws), ordered by j, kept on the executors' disks; unpersist() it after the last round."""
    lists = edges.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("e"))
    rows = lists.select("i", F.col("e.j").alias("js"), F.col("e.w").alias("ws"))
    return rows.repartition(GROUPS, "i").persist(StorageLevel.DISK_ONLY)


def _places(schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        packed = np.concatenate([table.column(c).to_numpy() for c in ("x", "y")]).astype(np.float64).tobytes()
        return pa.table([pa.array([table.column("_i")[0].as_py()], pa.int32()), pa.array([packed])], schema=schema)

    return run


def _moved(state: Sequence[str], move: Move, schema: pa.Schema):
    """Rows (group, order, block, i, h, state, js, ws, places): a group's points by block, then the places of all points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        known = None
        for batch in batches:
            points = batch.filter(pa.compute.equal(batch.column("_order"), 0))
            if points.num_rows:
                js, ws = points.column("js"), points.column("ws")
                size = pa.compute.fill_null(js.value_lengths(), 0).to_numpy()
                held.append((points.column("_block").to_numpy(), points.column("_i").to_numpy(), points.column("_h").to_numpy(), np.column_stack([points.column(c).to_numpy() for c in state]), size, js.flatten().to_numpy(), ws.flatten().to_numpy()))
            packs = batch.filter(pa.compute.equal(batch.column("_order"), 1))
            for r in range(packs.num_rows):
                if known is None:
                    known = [np.concatenate(c) for c in zip(*held, strict=True)] if held else []
                    fixed = np.zeros((len(known[5]), 2)) if held else None
                if known:
                    first, xy = packs.column("_i")[r].as_py(), np.frombuffer(packs.column("places")[r].as_buffer()).reshape(2, -1)
                    here = np.flatnonzero((known[5] >= first) & (known[5] < first + xy.shape[1]))
                    fixed[here] = xy[:, known[5][here] - first].T
        if not held:
            return
        if known is None:
            known = [np.concatenate(c) for c in zip(*held, strict=True)]
            fixed = np.zeros((len(known[5]), 2))
        blocks, ids, hashes, values, sizes, others, weights = known
        ends = np.cumsum(sizes)
        for block in np.unique(blocks).tolist():
            rows = np.flatnonzero(blocks == block)  # together, and ascending by i
            rows = slice(rows[0], rows[-1] + 1)
            edges = slice(ends[rows.start] - sizes[rows.start], ends[rows.stop - 1])
            own = np.repeat(np.arange(rows.stop - rows.start), sizes[rows])
            at = np.minimum(np.searchsorted(ids[rows], others[edges]), rows.stop - rows.start - 1)
            other = np.where(ids[rows][at] == others[edges], at, -1)
            new = move(block, values[rows], own, other, fixed[edges], weights[edges].astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(hashes[rows]), *[pa.array(c) for c in new.T]], schema=schema)

    return run


def one_round(at: DataFrame, edges: DataFrame, blocks: int, block: Column, state: Sequence[str], move: Move) -> DataFrame:
    """Points (_i, _h, state), state beginning with x and y, moved in their blocks, written; edges are adjacent() ones, at is a written table that goes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructType

    shape = StructType().add("_i", IntegerType()).add("_h", LongType())
    for c in state:
        shape = shape.add(c, DoubleType())
    groups = max(min(blocks, GROUPS), -(-blocks // BLOCKS_A_GROUP))
    group = F.floor(F.col("_block") * groups / blocks).cast("int")
    dealt = at.withColumn("_block", block).withColumn("_group", group)
    rows = dealt.join(edges.withColumnRenamed("i", "_i"), "_i", "left").select("_group", F.lit(0).alias("_order"), "_block", "_i", "_h", *state, "js", "ws", F.lit(None).cast("binary").alias("places"))
    if blocks > 1:
        pack = StructType().add("_i", IntegerType()).add("places", BinaryType())
        packs = at.select("_i", "x", "y").groupBy(F.floor(F.col("_i") / PLACES)).applyInArrow(_places(to_arrow_schema(pack)), pack)
        packs = packs.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), F.lit(1).alias("_order"), F.lit(0).alias("_block"), "_i", F.lit(None).cast("bigint").alias("_h"), *[F.lit(None).cast("double").alias(c) for c in state], F.lit(None).cast("array<int>").alias("js"), F.lit(None).cast(edges.schema["ws"].dataType).alias("ws"), "places")
        rows = rows.union(packs)
    rows = rows.repartitionById(groups, F.col("_group")).sortWithinPartitions("_order", "_block", "_i")
    return settled(rows.mapInArrow(_moved(state, move, to_arrow_schema(shape)), shape), replaces=at)
