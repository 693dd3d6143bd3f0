"""Exact nearest neighbours: vectors travel packed and a bounded number of times, and pairs that can't matter aren't measured.

Vectors belong to the nearest of a set of pivots, so space falls into cells; the rows of a cell are packed into blocks. Blocks are dealt into groups, and each group
meets every block in one task: what is shuffled is the packed table once a group, however many cells a row has to look at. A row first looks at its own block,
which bounds the distance to its k-th neighbour from above. Another cell can hold a nearer one only if the plane between the pivots, and the shell in which the
cell's rows lie around its pivot, are nearer than that bound; rows for which they aren't pass the block by. For the others a product of matrices, with its rounding
added to the bound, tells which pairs are measured. A task holds its group's rows and lists, and one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and up to which a table is one; rows a cell should hold; pivots at most.
BLOCK, CELL, PIVOTS = 4096, 256, 4096
#: Groups of a table, rows of one at least, and what its vectors and lists may take: only tables above GROUPS * HELD bytes have more groups. Tables of more than
#: a BLOCK have GROUPS of them, so that every table is shuffled as often.
GROUPS, LEAST, HELD = 12, 256, 128 << 20
#: Rows of a group whose pairs with a block are looked at together; pairs that are measured together; measured pairs that wait for each place of the group's lists.
AT_ONCE, MEASURED, WAITING = 2048, 1 << 15, 0.25


def _matrix(column) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def nearest_in(rows: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places and distances of its k nearest others (all, if there are fewer), nearest first; equal distances by place."""
    places, found = [np.zeros((0, min(k, len(others))), np.int64)], [np.zeros((0, min(k, len(others))))]
    for lo in range(0, len(rows), 512):
        part = rows[lo : lo + 512]
        rough = _squares(part, others)
        if len(others) > k + 8:
            near = np.sort(np.argpartition(rough, k + 7, axis=1)[:, : k + 8], axis=1)
        else:
            near = np.broadcast_to(np.arange(len(others)), (len(part), len(others)))
        exact = np.sqrt(((part[:, None] - others[near]) ** 2).sum(2))
        first = np.argsort(exact, axis=1, kind="stable")[:, :k]
        places.append(np.take_along_axis(near, first, 1))
        found.append(np.take_along_axis(exact, first, 1))
    return np.concatenate(places), np.concatenate(found)


def _assign(pivots: np.ndarray):
    """Rows (id, vector) to (id, vector, cell, radius)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                cell = _squares(x, pivots).argmin(1)
                radius = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(radius)], ["_i", "_v", "_cell", "_radius"])

    return run


def _packed(before: np.ndarray, parts: np.ndarray, groups: int, schema: pa.Schema):
    """A block's rows as one row. Its group comes from how many rows of the table, cell by cell, are before it."""

    def run(table: pa.Table) -> pa.Table:
        table = (table if pa.types.is_nested(table.schema.field("_i").type) else table.sort_by("_i")).combine_chunks()
        cell, part = table.column("_cell")[0].as_py(), table.column("_part")[0].as_py()
        place = before[cell] + (before[cell + 1] - before[cell]) * part / parts[cell]
        flat = table.column("_v").chunk(0).flatten()
        flat = flat.to_numpy(zero_copy_only=False).astype(np.float32 if pa.types.is_float32(flat.type) else np.float64)
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("_i").chunk(0))
        columns = [pa.array([cell]), pa.array([part]), pa.array([min(int(place * groups / before[-1]), groups - 1)]), ids, pa.array([flat.tobytes()]), pa.array([flat.itemsize])]
        return pa.table([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class Group:
    """Rows of some blocks (cell, ids, vectors) and the nearest found so far of each."""

    def __init__(self, blocks: list[tuple[int, pa.Array, np.ndarray]], k: int, pivots: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.k, self.pivots, self.low, self.high = k, pivots, low, high
        self.ids, self.x = pa.concat_arrays([ids for _, ids, _ in blocks]), np.concatenate([x for *_, x in blocks])
        sizes = [len(x) for *_, x in blocks]
        self.cells, self.cell = np.unique(np.repeat([cell for cell, *_ in blocks], sizes), return_inverse=True)
        self.squares = (self.x * self.x).sum(1)
        self.mine = ((self.x - pivots[self.cells][self.cell]) ** 2).sum(1)
        self.about = self.x.mean(0)
        self.rough = self._left(self.x).astype(np.float32)
        self.norm = np.sqrt(((self.x - self.about) ** 2).sum(1))
        self.d, self.at = np.full((len(self.x), k), np.inf), np.full((len(self.x), k), -1)
        self.pool, self.compared = self.ids, np.zeros(len(self.x), np.int64)  # what self.at counts in
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        ends = np.cumsum(sizes)
        for (*_, x), end in zip(blocks, ends.tolist(), strict=True):
            places, found = nearest_in(x, x, k)
            own = slice(end - len(x), end)
            self.d[own, : places.shape[1]], self.at[own, : places.shape[1]], self.compared[own] = found, end - len(x) + places, len(x)
        for (cell, ids, x), end in zip(blocks, ends.tolist(), strict=True):
            self.meet(cell, ids, x, slice(end - len(x), end))

    def _left(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x - self.about, np.zeros(len(x)), np.ones(len(x))))

    def _looking(self, cell: int) -> np.ndarray:
        """Whether a row's bound reaches into a cell. A row with k equal ones looks no further."""
        pivot, bound = self.pivots[cell], self.d[:, -1]
        d2 = self.squares - 2 * (self.x @ pivot) + pivot @ pivot
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            off = (len(pivot) + 16) * 2.0**-50 * (np.sqrt(self.squares) + np.sqrt(pivot @ pivot) + self.high[cell]) ** 2
            between = np.sqrt(((self.pivots[self.cells] - pivot) ** 2).sum(1))[self.cell]
            plane = np.where(between > 0, (d2 - self.mine - off) / (2 * between), 0)
            least = np.maximum(plane, np.maximum(np.sqrt(np.maximum(d2 - off, 0)) - self.high[cell], self.low[cell] - np.sqrt(np.maximum(d2, 0) + off)))
            return ~(least > bound) & (bound > 0)

    def meet(self, cell: int, ids: pa.Array, y: np.ndarray, own: slice | None = None) -> None:
        """The group looks at a block; rows `own` are the block's own and have done so."""
        see = self._looking(cell)
        if own is not None:
            see[own] = False
        rows = np.flatnonzero(see)
        if not len(rows):
            return
        self.compared[rows] += len(y)
        gap = y - self.about
        length = (gap * gap).sum(1)
        bound = self.d[rows, -1] ** 2
        scale = (self.norm[rows] + np.sqrt(length.max())) ** 2
        eps = (y.shape[1] + 16) * 2.0**-22
        found = np.isfinite(bound)
        single = scale.max() < 1e30 and (not found.any() or np.median(eps * (scale + bound)[found]) < 0.05 * np.median(bound[found]))
        kind, eps = (np.float32, eps) if single else (np.float64, eps * 2.0**-29)
        right = np.column_stack((-2 * gap, np.ones(len(y)), length)).astype(kind).T
        edge = (self.norm[rows] ** 2 - bound - eps * (scale + bound)).astype(kind)
        for lo in range(0, len(rows), AT_ONCE):
            some = rows[lo : lo + AT_ONCE]
            left = self.rough[some] if kind is np.float32 else self._left(self.x[some])
            left[:, -2] = edge[lo : lo + AT_ONCE]
            hit = np.flatnonzero(~(left @ right > 0))
            if len(hit):
                self._measure(some, hit // len(y), hit % len(y), ids, y)
        if sum(len(g) for g, *_ in self.waiting) > max(WAITING * self.d.size, MEASURED):
            self.settle()

    def _measure(self, some: np.ndarray, g: np.ndarray, h: np.ndarray, ids: pa.Array, y: np.ndarray) -> None:
        """Pairs of some[g] and y[h]; a row with many of them is compared with all of y at once."""
        crowded = np.bincount(g, minlength=len(some)) > self.k + 8
        if crowded.any():
            many = np.flatnonzero(crowded)
            places, found = nearest_in(self.x[some[many]], y, self.k)
            self._wait(np.repeat(some[many], places.shape[1]), found.ravel(), places.ravel(), ids)
            few = ~crowded[g]
            g, h = g[few], h[few]
        for lo in range(0, len(g), MEASURED):
            a, b = some[g[lo : lo + MEASURED]], h[lo : lo + MEASURED]
            self._wait(a, np.sqrt(((self.x[a] - y[b]) ** 2).sum(1)), b, ids)

    def _wait(self, rows: np.ndarray, d: np.ndarray, places: np.ndarray, ids: pa.Array) -> None:
        nearer = d < self.d[rows, -1]
        if nearer.any():
            self.waiting.append((rows[nearer], d[nearer], ids.take(pa.array(places[nearer]))))

    def settle(self) -> None:
        """Puts the pairs that wait into the lists."""
        if not self.waiting:
            return
        rows, d = (np.concatenate([w[c] for w in self.waiting]) for c in (0, 1))
        at = len(self.pool) + np.arange(len(rows))
        pool = pa.concat_arrays([self.pool, *[ids for *_, ids in self.waiting]])
        self.waiting = []
        order = np.lexsort((d, rows))
        rows, d, at = rows[order], d[order], at[order]
        which, first, line = np.unique(rows, return_index=True, return_inverse=True)
        rank = np.arange(len(rows)) - first[line]
        keep = rank < self.k
        line, rank = line[keep], rank[keep]
        more, more_at = np.full((len(which), rank.max() + 1), np.inf), np.full((len(which), rank.max() + 1), -1)
        more[line, rank], more_at[line, rank] = d[keep], at[keep]
        both, both_at = np.hstack((self.d[which], more)), np.hstack((self.at[which], more_at))
        best = np.argsort(both, axis=1, kind="stable")[:, : self.k]
        self.d[which], self.at[which] = np.take_along_axis(both, best, 1), np.take_along_axis(both_at, best, 1)
        used = self.at >= 0
        self.pool = pool.take(pa.array(self.at[used]))
        self.at[used] = np.arange(len(self.pool))

    def lists(self, lo: int, hi: int) -> list[pa.Array]:
        """Ids, lists of (d, i) and counts of compared pairs of rows lo to hi."""
        used = self.at[lo:hi] >= 0
        pairs = pa.StructArray.from_arrays([pa.array(self.d[lo:hi][used]), self.pool.take(pa.array(self.at[lo:hi][used]))], ["d", "i"])
        ends = np.append(0, np.cumsum(used.sum(1)))
        return [self.ids[lo:hi], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(self.compared[lo:hi])]


def _met(k: int, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, schema: pa.Schema):
    """Blocks (cell, part, home, ids, vectors, bytes of a number, group) of one group a partition, its own first, to its rows with their nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = [], None
        for batch in batches:
            cells, homes, wide, groups = (batch.column(c).to_pylist() for c in (0, 2, 5, 6))
            for r in range(batch.num_rows):
                ids = batch.column(3)[r].values
                x = np.frombuffer(batch.column(4)[r].as_buffer(), np.float32 if wide[r] == 4 else np.float64).astype(np.float64).reshape(len(ids), -1)
                if homes[r] == groups[r]:
                    own.append((cells[r], ids, x))
                elif own or group:  # a group without blocks has no rows to look
                    group, own = group or Group(own, k, pivots, low, high), []
                    group.meet(cells[r], ids, x)
        if own or group:
            group = group or Group(own, k, pivots, low, high)
            group.settle()
            for lo in range(0, len(group.x), 4096):
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(group.lists(lo, min(lo + 4096, len(group.x))), schema, strict=True)], schema=schema)

    return run


def nearest(rows: DataFrame, k: int, seed: int = 42, block: int | None = None) -> DataFrame:
    """Of rows (_i, _v), sound vectors of one length: (_i, near, compared), near being the k nearest rows as (d, i), nearest first, the row itself among them.

    compared: pairs that were looked at for the row. Fewer than k rows give them all. Rows that repeat an id are one row with the k nearest of all their lists. Equal distances
    of a list are by id; which rows at the last distance are in it depends on their cells. block: rows of a block (BLOCK).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructType

    kind = rows.schema["_i"].dataType
    pack_type = StructType().add("_cell", IntegerType()).add("_part", IntegerType()).add("_home", IntegerType()).add("_ids", ArrayType(kind)).add("_rows", BinaryType()).add("_wide", IntegerType())
    list_type = StructType().add("_i", kind).add("near", ArrayType(StructType().add("d", DoubleType()).add("i", kind))).add("compared", LongType())
    n, block = rows.count(), block or BLOCK
    many = 1 if n <= block else min(PIVOTS, -(-n // CELL))
    # The pivots: rows drawn by a hash, distinct ones, about as many as there should be cells; never more than twice PIVOTS.
    drawn = rows.select("_v", F.xxhash64("_v", F.lit(seed)).alias("_h")).where(F.pmod("_h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * many / max(n, 1)))).distinct().orderBy("_h").limit(many)
    pivots = np.array([r["_v"] for r in drawn.collect()], np.float64) if many > 1 else np.zeros((0, 0))
    if len(pivots) < 2:
        placed = rows.select("_i", "_v", F.lit(0).alias("_cell"))
        stats = [(0, n, 0.0, float("inf"))]
        width = (rows.select(F.size("_v")).first() or [1])[0]
        pivots = np.zeros((1, width))
    else:
        placed = rows.mapInArrow(_assign(pivots), StructType().add("_i", kind).add("_v", rows.schema["_v"].dataType).add("_cell", IntegerType()).add("_radius", DoubleType()))
        stats = [tuple(r) for r in placed.groupBy("_cell").agg(F.count("*"), F.min("_radius"), F.max("_radius")).collect()]  # a row a pivot
    counts, low, high = np.zeros(len(pivots), np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    for cell, count, a, b in stats:
        counts[cell], low[cell], high[cell] = count, a, b
    parts, before = np.maximum(-(-counts // block), 1), np.append(0, np.cumsum(counts))
    held = max(HELD // (pivots.shape[1] * 20 + k * 24), 1)
    groups = max(-(-n // held), min(GROUPS, -(-n // LEAST))) if n > block else 1
    of = F.get(F.array(*[F.lit(int(p)) for p in parts]), F.col("_cell")) if parts.max() > 1 else F.lit(1)
    placed = placed.select("_i", "_v", "_cell", F.pmod(F.xxhash64("_i", "_v"), of).cast("int").alias("_part"))
    if groups > 1:
        placed = placed.repartition(groups, "_cell", "_part")  # so that few tasks don't make all copies
    blocks = placed.groupBy("_cell", "_part").applyInArrow(_packed(before, parts, groups, to_arrow_schema(pack_type)), pack_type)
    dealt = blocks.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).repartitionById(groups, F.col("_group"))
    dealt = dealt.sortWithinPartitions(F.col("_home") != F.col("_group"), "_cell", "_part")
    return _merged(dealt.mapInArrow(_met(k, pivots, low, high, to_arrow_schema(list_type)), list_type), k)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    every = F.flatten(F.collect_list("near"))
    return lists.groupBy("_i").agg(F.slice(F.array_sort(every), 1, k).alias("near"), F.sum("compared").alias("compared"))
