"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class from the start. Each tree splits at random projections, with an overlap that sends vectors near a split both ways, until
a leaf has few rows. The top of a tree is fitted on a bounded sample; leaves that still have many rows are split further by trees of their own, fitted
on samples of them in parallel, whatever the table's size. Where no split tells rows apart (a group of near copies) the leaf stays as it is and is compared in
blocks, pair of blocks by pair of blocks, so that no task holds more than two of them. Pairs stay inside a task: what leaves it is one row a vector
with its number of links and a spanning link. A pair that meets in several leaves counts in the first of them, which both sides' lists of leaves tell.
Leaves are compared in several rounds, so that only a share of the copies of vectors is on disk at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SECOND, discard, materialize, mix, operator, splittable
from .components import components, star_forest

TREES = 4
#: Vectors that a leaf should hold; those from which it is split further; and at most a block of it.
LEAF, BIG, BLOCK = 256, 2048, 512
#: Bounds of the sample that the tops of the trees are fitted on (rows, bytes), and of the rows a leaf's own tree is fitted on.
SAMPLE_ROWS, SAMPLE_BYTES, OWN_ROWS = 32_768, 64 << 20, 4096
#: Rows of a leaf that are placed in its own tree by one task; rounds in which leaves are compared.
CHUNK, ROUNDS = 50_000, 3
#: Splits that a node chooses from; the share of its rows that either side may have, else the node stays a leaf.
CHOICES, MOST = 4, 0.8


def matrix(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded with zeros to one width, and their own lengths."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(ends)
    width = width or int(sizes.max(initial=1))
    out = np.zeros((len(sizes), width))
    if len(sizes) and sizes.min() == width:
        out[:] = flat[ends[0] : ends[-1]].reshape(len(sizes), width)
    else:
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
            out[i, : b - a] = flat[a:b][:width]
    if len(sizes):
        out /= np.abs(out).max(1, keepdims=True)
        out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out, sizes


@dataclass
class Tree:
    """Inner nodes: direction, cut and children, a child below 0 being leaf ~child. final: leaves that no split tells apart."""

    directions: np.ndarray
    cuts: np.ndarray
    children: np.ndarray
    final: np.ndarray
    overlap: float

    def leaves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the numbers of the leaves they fall into, in no order."""
        at, node = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
        if not len(self.cuts):
            return at, node
        rows, found = [], []
        while len(at):
            shown = np.empty(len(at))
            for lo in range(0, len(at), 8192):
                part = slice(lo, lo + 8192)
                shown[part] = np.einsum("ij,ij->i", vectors[at[part]], self.directions[node[part]])
            cut = self.cuts[node]
            left, right = shown <= cut + self.overlap, shown >= cut - self.overlap
            at, node = np.concatenate((at[left], at[right])), np.concatenate((self.children[node[left], 0], self.children[node[right], 1]))
            done = node < 0
            rows.append(at[done])
            found.append(~node[done])
            at, node = at[~done], node[~done]
        return np.concatenate(rows), np.concatenate(found)


def fit_tree(sample: np.ndarray, scale: float, overlap: float, seed, most: int) -> Tree:
    """A tree over sample rows that stand for scale rows each: nodes are split until they stand for so many rows at most.

    A node chooses among CHOICES random directions (every other one between two of its rows) and cuts near the median the split that sends least rows both ways.
    """
    rng = np.random.default_rng(seed)
    directions, cuts, children, final = [], [], [], []

    def leaf(stays: bool) -> int:
        final.append(stays)
        return ~(len(final) - 1)

    def split(own: np.ndarray):
        best = None
        for choice in range(CHOICES):
            d = sample[own[rng.integers(len(own))]] - sample[own[rng.integers(len(own))]] if choice % 2 else rng.standard_normal(sample.shape[1])
            length = np.linalg.norm(d)
            if length < 1e-9:
                continue
            shown = sample[own] @ (d / length)
            for cut in np.quantile(shown, (0.4, 0.45, 0.5, 0.55, 0.6)):
                left, right = shown <= cut + overlap, shown >= cut - overlap
                sides = int(left.sum()), int(right.sum())
                cost = sum(sides) + 0.2 * max(sides)
                if max(sides) <= MOST * len(own) and (best is None or cost < best[0]):
                    best = (cost, d / length, cut, own[left], own[right])
        return best

    todo = [(np.arange(len(sample)), None)]
    while todo:
        own, parent = todo.pop()
        small = len(own) * scale <= most or len(own) < 16
        best = None if small else split(own)
        if best is None:
            child = leaf(len(own) * scale > most and len(own) >= 16)
        else:
            child = len(cuts)
            directions.append(best[1])
            cuts.append(best[2])
            children.append([0, 0])
            todo += [(best[3], (child, 0)), (best[4], (child, 1))]
        if parent:
            children[parent[0]][parent[1]] = child
    return Tree(np.array(directions, np.float32).reshape(len(cuts), sample.shape[1]), np.array(cuts), np.array(children, np.int64).reshape(-1, 2), np.array(final, bool), overlap)


def _leaf_ids(tree: Tree, leaves: np.ndarray, of: int) -> np.ndarray:
    """63 bits for each leaf of a tree, odd for final ones; of: the tree's number, or the leaf it splits."""
    with np.errstate(over="ignore"):
        ids = mix(np.uint64(of & (2**64 - 1)) * np.uint64(0x9E3779B97F4A7C15) + leaves.astype(np.uint64) + np.uint64(1))
    return ((ids >> np.uint64(2)) << np.uint64(1)).astype(np.int64) | tree.final[leaves]


def _assign(forest, width: int):
    """Rows (cls, vec) to (cls, leaf), one for each leaf of each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                cls, vectors = part.column(0).to_numpy(), matrix(part.column(1), width)[0]
                for t, tree in enumerate(forest.value):
                    rows, leaves = tree.leaves(vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array(_leaf_ids(tree, leaves, t))], ["cls", "leaf"])

    return run


def _fit_own(width: int, overlap: float, most: int):
    """Sampled rows (leaf, n, vec) of one leaf to its own tree; n: the rows of the leaf."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        leaf = group.column("leaf")[0].as_py()
        sample = matrix(group.column("vec").chunk(0), width)[0]
        tree = fit_tree(sample, group.column("n")[0].as_py() / len(sample), overlap, [leaf & 0x7FFFFFFF, 11], most)
        return pa.table({"leaf": [leaf], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _assign_own(width: int):
    """A part of a leaf's rows and its tree, to (cls, leaf)."""

    def run(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"cls": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64())})
        rows = rows.combine_chunks()
        if not trees.num_rows:  # no row of the leaf was drawn
            return pa.table({"cls": rows.column("cls"), "leaf": pa.array(rows.column("leaf").to_numpy() | 1)})
        tree, leaf = pickle.loads(trees.column("tree")[0].as_py()), trees.column("leaf")[0].as_py()
        cls, vectors = rows.column("cls").to_numpy(), matrix(rows.column("vec").chunk(0), width)[0]
        at, leaves = tree.leaves(vectors)
        return pa.table({"cls": cls[at], "leaf": _leaf_ids(tree, leaves, leaf)})

    return run


def _split_further(members: DataFrame, classes: DataFrame, width: int, overlap: float) -> DataFrame:
    """members (cls, leaf) with every leaf above BIG rows split by a tree of its own, until there is none but final ones."""
    while True:
        big = materialize(members.where("leaf % 2 = 0").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > BIG))
        if not big.take(1):
            discard(big)
            return members
        rows = materialize(members.join(big, "leaf").join(classes.select("cls", "vec"), "cls"))
        drawn = rows.where(F.pmod(F.xxhash64("cls", "leaf"), F.lit(1 << 30)) < F.lit(float(OWN_ROWS << 30)) / F.col("n")).select("leaf", "n", "vec")
        trees = materialize(drawn.groupBy("leaf").applyInArrow(_fit_own(width, overlap, LEAF), "leaf bigint, tree binary"))
        chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
        dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("cls"), chunks).cast("int")).select("cls", "vec", "leaf", "chunk")
        sent = trees.join(big, "leaf").withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("leaf", "tree", "chunk")
        below = dealt.groupBy("leaf", "chunk").cogroup(sent.groupBy("leaf", "chunk")).applyInArrow(_assign_own(width), "cls bigint, leaf bigint")
        members = materialize(members.join(big.select("leaf"), "leaf", "left_anti").select("cls", "leaf").union(below))
        discard(rows)


def _padded(column: pa.Array) -> np.ndarray:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(ends)
    out = np.full((len(size), int(size.max(initial=1))), -1, np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], size)] = flat[ends[0] : ends[-1]]
    return out


def _met_before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of a and b (lists of the leaves before this one, padded with -1) share a leaf."""
    b = np.where(b < 0, -2, b)
    out = np.zeros(len(a), bool)
    for column in range(a.shape[1]):
        out |= (b == a[:, column : column + 1]).any(1)
    return out


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda name: group.column(name).chunk(0)
        cls, copies, side = (column(n).to_numpy() for n in ("cls", "copies", "side"))
        vectors, sizes = matrix(column("vec"))
        rough = vectors.astype(np.float32)
        lists = _padded(column("leaves"))
        a = np.flatnonzero(side <= 0)
        b = a if side[0] == 0 else np.flatnonzero(side > 0)
        us, vs = [], []
        for lo in range(0, len(a), 256):
            own, rest = a[lo : lo + 256], b[lo:] if side[0] == 0 else b
            i, j = np.nonzero(rough[own] @ rough[rest].T >= np.float32(threshold - 1e-4))
            i, j = own[i], rest[j]
            good = (sizes[i] == sizes[j]) & ((i < j) if side[0] == 0 else True)
            i, j = i[good], j[good]
            for k in range(0, len(i), 8192):  # what is near enough in single precision, in double precision
                x, y = i[k : k + 8192], j[k : k + 8192]
                near = np.einsum("ij,ij->i", vectors[x], vectors[y]) >= threshold
                near[near] = ~_met_before(lists[x[near]], lists[y[near]])
                us.append(x[near])
                vs.append(y[near])
        i, j = (np.concatenate(x) if x else a[:0] for x in (us, vs))
        links = np.bincount(i, copies[j], len(cls)) + np.bincount(j, copies[i], len(cls))
        label = np.arange(len(cls))
        node, root = star_forest(i, j)
        label[node] = root
        some = links > 0
        return pa.table({"cls": cls[some], "links": links[some].astype(np.int64), "root": cls[label[some]]})

    return run


def _links(classes: DataFrame, threshold: float) -> DataFrame:
    """(cls, links, root) for classes (cls, vec, copies): a few rows a class, links adding up to those with other classes."""
    spark = classes.sparkSession
    n, width = classes.agg(F.count("*"), F.max(F.size("vec"))).first()
    width = max(width or 1, 1)
    bound = max(1, min(SAMPLE_ROWS, 32 * -(-n // LEAF), SAMPLE_BYTES // (8 * width)))
    drawn = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / max(n, 1)))).select("vec").toArrow()
    sample = matrix(drawn.column(0).combine_chunks(), width)[0] if drawn.num_rows else np.zeros((0, width))
    overlap = 0.5 * np.sqrt(max(2 - 2 * threshold, 0) / width)
    forest = [fit_tree(sample, n / max(len(sample), 1), overlap, [t, 5], LEAF) for t in range(TREES)]
    members = materialize(classes.select("cls", "vec").mapInArrow(_assign(spark.sparkContext.broadcast(forest), width), "cls bigint, leaf bigint"))
    members = _split_further(members, classes, width, overlap)
    full = materialize(members.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1"))
    placed = materialize(classes.select("cls", "vec", "copies").join(members.groupBy("cls").agg(F.collect_list("leaf").alias("leaves")), "cls"))
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    found = None
    for turn in range(ROUNDS):
        some = full.where(F.pmod(F.xxhash64("leaf"), F.lit(ROUNDS)) == turn)
        rows = placed.withColumn("leaf", F.explode(F.filter("leaves", lambda x: F.pmod(F.xxhash64(x), F.lit(ROUNDS)) == turn))).join(some, "leaf")
        rows = rows.withColumn("leaves", F.filter("leaves", lambda x: x < F.col("leaf"))).withColumn("own", F.pmod(F.xxhash64("cls", "leaf"), parts).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        rows = rows.select("cls", "vec", "copies", "leaves", "leaf", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))
        met = materialize(rows.groupBy("leaf", "i", "j").applyInArrow(_compare(threshold), "cls bigint, links bigint, root bigint"))
        found = met if found is None else found.union(met)
    return found


@operator
def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row a vector: its id (of any type that has an order), n_links (other vectors linked directly), component_id (least id reachable), kept (it is its own).

    Links join vectors of one length with a cosine of at least threshold in double precision, as far as a tree brings them together.
    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing and are their own components.
    Equal vectors count one by one. A null id is never a component's id: such a vector has its group's, or null and kept if there is
    none. Rows that repeat an id are different vectors with one id. An empty table gives an empty result; other columns are not looked at.
    """
    vec = F.col(vector_column)
    sound = F.coalesce(F.size(vec) > 0, F.lit(False)) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    key = F.struct(F.xxhash64("vec").alias("a"), F.xxhash64(F.lit(_SECOND), "vec").alias("b"))
    rows = vectors.select(F.col(id_column).alias("ident"), F.when(F.coalesce(sound, F.lit(False)), vec).alias("vec")).withColumn("key", F.when(F.col("vec").isNotNull(), key))
    classes = rows.where("vec IS NOT NULL").groupBy("key", "vec").agg(F.count("*").alias("copies"), F.min("ident").alias("least"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    met = _links(classes, threshold)
    found = components(met.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    linked = met.groupBy("cls").agg(F.sum("links").alias("links"))
    of = classes.select("cls", "key", "copies", "least").join(found, F.col("cls") == F.col("node"), "left").select("cls", "key", "copies", "least", F.coalesce("root", "cls").alias("root"))
    of = materialize(of.join(linked, "cls", "left"))
    least = splittable(of.groupBy("root").agg(F.min("least").alias("component")), of)
    labels = materialize(of.join(least, "root").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"))
    out = rows.select("ident", "key").join(labels, "key", "left").select("ident", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("key").isNull(), F.col("ident")).otherwise(F.col("component")).alias("component_id"))
    return out.select(F.col("ident").alias(id_column), "n_links", "component_id", F.col("ident").eqNullSafe(F.col("component_id")).alias("kept"))
